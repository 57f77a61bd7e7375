"""Streaming operators run to the end of a log that is read as a stream."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.plans.queries_core import _log
from weblens.plans.store import fresh_path
from weblens.streaming import live


#: Columns that the streaming operators read, and rows of the log that are one batch.
COLUMNS = ["req_id", "ts", "ip", "ua", "method", "base", "status", "bytes", "ref", "ref_internal", "is_static"]
BATCH, FILE = 16_000_000, 1_000_000


def in_turn(spark, rows: DataFrame, turns: list, name: str, n: int) -> tuple[str, int]:
    """Write ``n`` rows so that a stream reads those of every condition as a batch, one after the other: the folder, and how many files are a batch.

    Files are read in the order in which they were written, an equal number a batch, so what a batch lacks is made up by empty files.
    """
    path, files = fresh_path(spark, name), spark.sparkContext.defaultParallelism if n > FILE else 1
    for k, turn in enumerate(turns, 1):
        rows.where(turn).coalesce(files).write.mode("append").parquet(path)
        for _ in range(k * files - len(spark.read.parquet(path).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path, files


def read_in_turn(spark, rows: DataFrame, path: str, files: int) -> DataFrame:
    return live.as_stream_rows(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path))


def log_streams(w, number: int = 1) -> list[DataFrame]:
    """The stored requests as streams of batches in time order, so a state holds what a batch and the watermark leave open. They are written once."""
    rows = w.rq.select(*COLUMNS)
    n = rows.count()
    parts = -(-n // BATCH) or 1
    cuts = sorted(set(rows.agg(F.percentile_approx("ts", [k / parts for k in range(1, parts)])).first()[0] or [])) if parts > 1 else []
    ts, edges = F.col("ts"), [None, *cuts, None]
    turns = [(F.lit(True) if a is None else ts >= a) & (F.lit(True) if z is None else F.coalesce(ts < z, F.lit(a is None))) for a, z in zip(edges, edges[1:])]
    path, files = in_turn(w.spark, rows, turns, "stream-source", n)
    return [read_in_turn(w.spark, rows, path, files) for _ in range(number)]


def log_stream(w) -> DataFrame:
    return log_streams(w)[0]


def run_to_end(w, stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming query over all available input into a table and read the table."""
    out = fresh_path(w.spark, name)
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", fresh_path(w.spark, name + "-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return w.spark.read.schema(stream.schema).parquet(out)


def _late(w):
    """Batches of a log whose first quarter comes last, as of a server that sends its lines late: what the watermark drops is counted. (The engine drops by the watermark of the batch before.)"""
    rows = w.rq.select("ip", "ts")
    days = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n")).first()
    border, middle = (days.a + k * (days.b - days.a) // 4 for k in (1, 2))
    turns = [F.col("ts").between(border, middle - 1), F.col("ts") >= middle, F.col("ts") < border]
    stream = read_in_turn(w.spark, rows, *in_turn(w.spark, rows, turns, "late-source", days.n))
    query = (live.sliding_burst(stream, minimum=4).writeStream.outputMode("append").format("parquet").option("path", fresh_path(w.spark, "t06"))
             .option("checkpointLocation", fresh_path(w.spark, "t06-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return live.late_report(w.spark, [json.loads(p.json) for p in query.recentProgress]).where("rows > 0")


def _recent_404(w):
    return live.recent_404(*log_streams(w, 2), 7200)


QUERIES = {
    "t01_stream_sessions": _log(lambda w: run_to_end(w, live.sessions(log_stream(w)), "t01")),
    "t02_stream_recent_404": _log(lambda w: run_to_end(w, _recent_404(w), "t02").select("req_id", "ip", "path", "ip_404").distinct()),
    "t03_stream_window_counters": _log(lambda w: run_to_end(w, live.window_counters(log_stream(w)), "t03").withColumn("window_start", F.unix_timestamp("window_start"))),
    "t04_stream_sliding_burst": _log(lambda w: run_to_end(w, live.sliding_burst(log_stream(w), minimum=4), "t04")),
    "t05_stream_minute_alerts": _log(lambda w: run_to_end(w, live.minute_alerts(log_stream(w), 2), "t05").withColumn("minute", F.unix_timestamp("minute"))),
    "t06_late_rows": _log(_late),
}
