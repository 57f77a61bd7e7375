"""Structured Streaming versions of sessions, counters, bursts, rates and the recent-404 memory.

Streams carry ``ts`` as an event-time timestamp.  Every state has a watermark, so it
is dropped when it can no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weblens.functions import columns as C


def as_stream_rows(rq: DataFrame) -> DataFrame:
    """Epoch-second requests as event-time rows."""
    return rq.withColumn("time", F.timestamp_seconds("ts"))


def sessions(stream: DataFrame, gap: int = 1800, late: str = "10 minutes") -> DataFrame:
    """Visits of a client closed by a pause; same boundary as the batch sessions."""
    return (stream.withWatermark("time", late).groupBy("ip", "ua", F.session_window("time", f"{gap} seconds").alias("w"))
            .agg(F.count(F.lit(1)).alias("n_req"), F.sum("bytes").alias("bytes"), F.min("ts").alias("start"), F.max("ts").alias("end"))
            .select("ip", "ua", "start", "end", "n_req", "bytes"))


def recent_404(stream_entries: DataFrame, stream_404: DataFrame, seconds: int = 7200, late: str = "10 minutes") -> DataFrame:
    """Requests that come from a page another IP got 404 on within the last two hours (stream-stream interval join).

    The state of a key is compared row by row, so a time block as long as the interval is part of the key: a 404 counts in its own block and in the
    next one, a request meets the copy of its block, and a popular page is as many keys as the log has blocks.
    """
    block = F.floor(F.unix_timestamp("time") / seconds)
    missing = stream_404.where("method = 'GET' AND status = 404").select(
        F.col("base").alias("path"), F.col("ip").alias("ip_404"), F.col("time").alias("time_404"),
        F.explode(F.array(block, block + 1)).alias("blk_404")).withWatermark("time_404", late)
    entries = stream_entries.where("ref_internal").select(
        "req_id", "ip", "time", C.ref_path(F.col("ref")).alias("ref_page"), block.alias("blk")).withWatermark("time", late)
    within = F.expr(f"time >= time_404 AND time <= time_404 + INTERVAL {seconds} SECONDS")
    same = (F.col("ref_page") == F.col("path")) & (F.col("blk") == F.col("blk_404"))
    return entries.join(missing, same & (F.col("ip") != F.col("ip_404")) & within).select(
        "req_id", "ip", "path", "ip_404", "time", "time_404")


def window_counters(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and distinct addresses per client and window: counted by address first, so the count is exact and a busy client's state is spread over its addresses."""
    by_address = stream.withWatermark("time", late).groupBy("ip", "base", F.window("time", width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return (by_address.groupBy("ip", F.window(F.window_time("w"), width).alias("w"))
            .agg(F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("addresses"))
            .select("ip", F.col("w.start").alias("window_start"), "requests", "addresses"))


def sliding_burst(stream: DataFrame, seconds: int = 60, minimum: int = 5, late: str = "1 minute") -> DataFrame:
    """Every second of a client from which on, ``seconds`` long and to the second, it sends at least ``minimum`` requests: ip, start, requests.

    Keyed state: the requests of each second that a window still to be judged can hold, so at most the seconds between the watermark and the latest request, and ``seconds`` more. A second is
    judged when the watermark has passed the end of its window; a timer wakes the client for that. Requests behind the watermark are dropped by the engine and counted (``late_rows``).
    """

    def go(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        judged = -1
        if state.exists:
            times, numbers, judged = state.get
            counts = dict(zip(times, numbers, strict=True))
        for batch in batches:
            for second, n in batch.groupby("ts").size().items():
                counts[int(second)] = counts.get(int(second), 0) + int(n)
        closed = state.getCurrentWatermarkMs() // 1000 - seconds  # a second before this can get no more requests into its window
        at = np.array(sorted(counts), np.int64)
        sums = np.append(0, np.cumsum([counts[t] for t in at.tolist()]))
        inside = sums[np.searchsorted(at, at + seconds, "right")] - sums[: len(at)]
        ready = (at < closed) & (at > judged)
        if ready.any():
            judged = int(at[ready][-1])
        out = ready & (inside >= minimum)
        left = at[at > judged]
        if len(left):
            state.update((left.tolist(), [counts[t] for t in left.tolist()], judged))
            state.setTimeoutTimestamp((int(left[0]) + seconds + 1) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"ip": key[0], "start": at[out], "requests": inside[out]})

    rows = stream.withWatermark("time", late).select("ip", "ts", "time")
    return rows.groupBy("ip").applyInPandasWithState(
        go, "ip string, start long, requests long", "times array<long>, numbers array<long>, judged long", "append", GroupStateTimeout.EventTimeTimeout)


def minute_alerts(stream: DataFrame, per_minute: int = 30, late: str = "1 minute") -> DataFrame:
    """Page rate per IP and minute; emitted once, when the minute is complete."""
    pages = stream.where("method IN ('GET', 'HEAD') AND NOT is_static")
    return (pages.withWatermark("time", late).groupBy("ip", F.window("time", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("pages"))
            .where(F.col("pages") >= per_minute).select("ip", F.col("w.start").alias("minute"), "pages"))


def late_rows(progress: list[dict]) -> int:
    """Rows dropped behind the watermark, summed over the state operators of a query's progress reports."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators", []))


def late_report(spark: SparkSession, progress: list[dict]) -> DataFrame:
    """A row for every batch: batch, rows that it read, rows of them behind the watermark. One row a batch, from the engine's own reports."""
    rows = [(p["batchId"], p["numInputRows"], late_rows([p])) for p in progress]
    return spark.createDataFrame(rows, "batch long, rows long, late long")
