"""Streams over files in several batches equal the batch results."""
import json
import random

from pyspark.sql import functions as F

from weblens.streaming import live
from tests.conftest import BROWSER

T0 = 1704067200


def as_stream(spark, log, tmp_path, name):
    path = str(tmp_path / name)
    log = log.withColumn("is_static", F.lit(False)).withColumn("ref_internal", F.col("ref").startswith("https://site.ru"))
    for part, cond in enumerate([f"ts < {T0 + 4000}", f"ts >= {T0 + 4000}"]):
        log.where(cond).coalesce(1).write.mode("append").parquet(path)
    return live.as_stream_rows(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path))


def finish(stream, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_sessions_rates_and_404_memory(spark, make_log, tmp_path):
    rows = [(T0, "1.1.1.1", "/a/"), (T0 + 1800, "1.1.1.1", "/b/"), (T0 + 3601, "1.1.1.1", "/c/")]
    rows += [(T0 + 10 + i, "2.2.2.2", f"/p{i}/") for i in range(6)]
    rows += [(T0 + 100, "3.3.3.3", "/gone/", {"status": 404}), (T0 + 4100, "4.4.4.4", "/", {"ref": "https://site.ru/gone/"}), (T0 + 4200, "3.3.3.3", "/", {"ref": "https://site.ru/gone/"})]
    rows += [(T0 + 90000, "9.9.9.9", "/end/")]
    log = make_log(rows)
    finish(live.sessions(as_stream(spark, log, tmp_path, "s")), "s1")
    got = {(r.ip, r.start): r.n_req for r in spark.table("s1").collect()}
    assert got[("1.1.1.1", T0)] == 2 and got[("1.1.1.1", T0 + 3601)] == 1 and got[("2.2.2.2", T0 + 10)] == 6
    finish(live.minute_alerts(as_stream(spark, log, tmp_path, "m"), 5), "m1")
    assert [(r.ip, r.pages) for r in spark.table("m1").collect()] == [("2.2.2.2", 6)]
    finish(live.sliding_burst(as_stream(spark, log, tmp_path, "b"), 60, 5), "b1")
    assert {(r.ip, r.start, r.requests) for r in spark.table("b1").collect()} == {("2.2.2.2", T0 + 10, 6), ("2.2.2.2", T0 + 11, 5)}
    finish(live.window_counters(as_stream(spark, log, tmp_path, "c")), "c1")
    assert [(r.requests, r.addresses) for r in spark.table("c1").where("ip = '2.2.2.2'").collect()] == [(6, 6)]
    finish(live.recent_404(as_stream(spark, log, tmp_path, "r1"), as_stream(spark, log, tmp_path, "r2")), "j1")
    assert [(r.ip, r.ip_404) for r in spark.table("j1").collect()] == [("4.4.4.4", "3.3.3.3")]


def test_late_rows_are_counted():
    progress = [{"stateOperators": [{"numRowsDroppedByWatermark": 2}]}, {"stateOperators": []}]
    assert live.late_rows(progress) == 2


def test_exact_bursts_with_late_rows(spark, make_log, tmp_path):
    rng = random.Random(2)
    times = {ip: sorted(T0 + rng.randint(0, 700) for _ in range(120)) for ip in ("1.1.1.1", "2.2.2.2")}
    rows = [(t, ip, "/") for ip, v in times.items() for t in v]
    batches = [[r for r in rows if r[0] < T0 + 300], [r for r in rows if r[0] >= T0 + 300]]
    batches[1].append(batches[0].pop())  # comes late, but within the minute
    batches.insert(1, [(T0 + 301, "3.3.3.3", "/")])  # rows are dropped by the watermark of the batch before
    late = max(r[0] for r in batches[0])
    batches[2] += [(late - 30, "1.1.1.1", "/"), (late - 400, "1.1.1.1", "/lost"), (late - 100, "2.2.2.2", "/lost")]
    batches.append([(T0 + 9000, "9.9.9.9", "/end")])
    path = str(tmp_path / "late")
    for batch in batches:
        make_log(batch).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    q = finish(live.sliding_burst(live.as_stream_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), 60, 9), "b2")
    kept = [r for batch in batches for r in batch if r[2] != "/lost"]
    want = {(ip, t, n) for ip in times for t in {r[0] for r in kept if r[1] == ip} if (n := sum(r[1] == ip and t <= r[0] <= t + 60 for r in kept)) >= 9}
    assert {tuple(r) for r in spark.table("b2").collect()} == want and len(want) > 20
    report = live.late_report(spark, [json.loads(p.json) for p in q.recentProgress]).collect()
    assert sum(r.late for r in report) == 2
    state = [op["numRowsTotal"] for p in q.recentProgress for op in json.loads(p.json)["stateOperators"]]
    assert state[-1] <= 1  # clients whose seconds are all judged hold no state
