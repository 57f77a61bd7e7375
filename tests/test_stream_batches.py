"""A log read as a stream: large pages, batches in time order, files of a batch."""
import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from weblens.plans import queries_streaming as Q
from weblens.streaming import live

T0 = 1704067200


def requests(spark, make_log, seed=3, n=900):
    rng, site = random.Random(seed), "https://site.ru"
    rows = [(T0 + rng.randint(0, 30000), f"1.1.1.{rng.randint(1, 9)}", f"/p{rng.randint(0, 2)}/", {"status": rng.choice([200, 404]), "ref": site + f"/p{rng.randint(0, 2)}/"}) for _ in range(n)]
    rows += [(T0 + 90000, "9.9.9.9", "/end/")]
    return make_log(rows).withColumn("is_static", F.lit(False)).withColumn("ref_internal", F.col("ref").startswith(site))


def test_404_memory_equals_all_pairs_and_its_keys_are_bounded(spark, make_log):
    rq = requests(spark, make_log)
    rows = rq.collect()
    got = Q.run_to_end(SimpleNamespace(spark=spark), stream := Q._recent_404(SimpleNamespace(spark=spark, rq=rq)), "r")
    want = sorted((e.req_id, e.ip, m.base, m.ip, e.ts, m.ts) for e in rows if e.ref_internal for m in rows
                  if m.status == 404 and e.ref == "https://site.ru" + m.base and e.ip != m.ip and m.ts <= e.ts <= m.ts + 7200)
    seconds = got.select("req_id", "ip", "path", "ip_404", F.unix_timestamp("time"), F.unix_timestamp("time_404"))
    assert sorted(tuple(r) for r in seconds.collect()) == want and len(want) > 1000
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "blk" in plan.split("Join Inner", 1)[1].split("\n")[0]  # a page is a key for every block of time


def test_batches_in_time_order_give_what_one_batch_gives(spark, make_log, monkeypatch):
    w = SimpleNamespace(spark=spark, rq=requests(spark, make_log).repartition(5).cache())
    runs = {"sessions": live.sessions, "counters": live.window_counters, "bursts": lambda s: live.sliding_burst(s, minimum=2), "alerts": lambda s: live.minute_alerts(s, 1)}
    result = lambda name: sorted(map(str, Q.run_to_end(w, Q._recent_404(w) if name == "404" else runs[name](Q.log_stream(w)), name).collect()))
    names = ["404", *runs]
    want = {name: result(name) for name in names}
    monkeypatch.setattr(Q, "BATCH", 250)
    monkeypatch.setattr(Q, "FILE", 100)  # several files a batch
    for name in names:
        assert result(name) == want[name] and want[name], name


def test_late_rows_of_batches_of_several_files(spark, make_log, monkeypatch):
    rq = requests(spark, make_log).repartition(5).cache()
    want = sorted(tuple(r) for r in Q._late(SimpleNamespace(spark=spark, rq=rq)).collect())
    monkeypatch.setattr(Q, "FILE", 100)
    asked = []
    in_turn = Q.in_turn
    monkeypatch.setattr(Q, "in_turn", lambda *a: asked.append(in_turn(*a)) or asked[-1])
    assert sorted(tuple(r) for r in Q._late(SimpleNamespace(spark=spark, rq=rq)).collect()) == want
    assert [r[0] for r in want] == [0, 1, 2][:len(want)] and sum(r[1] for r in want) == rq.count()
    path, files = asked[0]
    assert files > 1 and len(spark.read.parquet(path).inputFiles()) == 3 * files  # a batch is written by several tasks
