"""What the preparation runs once: features of requests, patterns of addresses."""
from pyspark.sql import functions as F

from weblens.plans.store import small_methods
from weblens.rules import files_only, scanners

T0 = 1704067200


def test_log_is_stored_with_its_features_in_small_methods(spark, make_log, weblog):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    with small_methods(spark):
        assert spark.conf.get(key) == "8000"
    w = weblog(make_log([(T0, "1.1.1.1", "/a/", {"ref": "https://site.ru/b/"}), (T0 + 1, "1.1.1.1", "/c.css")]))
    assert spark.conf.get(key) == before
    assert set(w.features.inputFiles()) == set(w.log.inputFiles())  # not computed again by what reads them
    assert [(r.ref_path, r.is_static) for r in w.features.orderBy("ts").collect()] == [("/b/", False), ("", True)]
    assert "ref_path" not in w.log.columns


def patterns(rows):
    """Filters and columns by a pattern above the scan of a plan."""
    return rows._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")


def test_patterns_of_files_and_backups_run_on_distinct_addresses(spark, make_log, weblog, monkeypatch):
    bot = {"ref": "-"}
    rows = [(T0 + i, "1.1.1.1", f"/backup{i}.zip", bot) for i in range(9)] + [(T0 + 5000, "2.2.2.2", "/db.sql", bot), (T0 + 9000, "3.3.3.3", "/img/a.jpg", bot), (T0 + 9001, "3.3.3.3", "/b/", bot)]
    w = weblog(make_log(rows))
    written = {}
    for module in (files_only, scanners):
        store = module.stored
        monkeypatch.setattr(module, "stored", lambda s, df, name, store=store: written.setdefault(name, (df, patterns(df))) and store(s, df, name))
    staff = spark.createDataFrame([("2.2.2.2",)], "ip string")
    out = scanners.mark_backups(w.visits, w.rq, staff, w.admin)
    files_only.mark_files_only(w.visits, w.rq, w.addresses).count()
    assert patterns(out) == 0 and written["backup-requests"][1] == 0  # requests are met by address
    assert written["file-flags"][1] == 0 and written["file-kinds"][1] > 0
    groups = {r.ip: (r.group, r.subgroup) for r in out.collect()}
    assert groups["2.2.2.2"] == ("suspects", "took a backup") and groups["1.1.1.1"] == ("bots", "took a backup") and groups["3.3.3.3"][1] != "took a backup"
