"""What reads a log once, and what runs on distinct values only."""
from pyspark.sql import functions as F

from weblens.marts import security
from weblens.operators import series

T0 = 1704067200


def test_outages_read_the_log_once(spark, make_log, weblog, tmp_path):
    rows = [(T0 + 60 * m + i, f"1.1.1.{i}", "/a/", {"status": 500 if 100 <= m < 104 else 200}) for m in range(200) for i in range(6)]
    log = make_log(rows).withColumn("is_page", F.lit(True)).withColumn("is_static", F.lit(False))
    path = str(tmp_path / "log")
    log.write.parquet(path)
    errors = spark.createDataFrame([(T0 + 6060, "SQLSTATE[HY000]")], "ts long, msg string")
    out = series.outages(spark.read.parquet(path), errors)
    found = [(r.degraded_from, r.degraded_to, r.pages_5xx, r.cause) for r in out.collect()]
    assert found == [(T0 + 6000, T0 + 6239, 24, "database")]
    assert not [f for f in out.inputFiles() if path in f]  # what follows the minutes reads only tables of minutes


def test_probe_patterns_do_not_run_on_requests(spark, make_log, weblog):
    w = weblog(make_log([(T0, "1.1.1.1", "/.env"), (T0 + 1, "1.1.1.1", "/a/"), (T0 + 2, "2.2.2.2", "/wp-login.php")]))
    staff = spark.createDataFrame([], "ip string")
    found = security.leaks(w.rq, w.probes, staff)
    assert {r.base for r in w.probes.collect()} == {"/.env", "/wp-login.php"}
    assert {r.base for r in found.collect()} == {"/.env", "/wp-login.php"}
    left = found._jdf.queryExecution().optimizedPlan().toString()
    assert left.count("RLIKE") == 1  # of the verdict, on one row a file; a filter of the probes would be inferred for the requests
