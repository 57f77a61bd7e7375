import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g").config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BROWSER = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36"


@pytest.fixture(scope="session")
def make_log(spark):
    """Requests from short tuples: (ts, ip, base[, overrides])."""
    columns = "req_id long, ts long, ip string, vhost string, ua string, method string, base string, query string, status int, bytes long, ref string, src string"

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            d = dict(req_id=i, ts=row[0], ip=row[1], vhost="site.ru", ua=BROWSER, method="GET", base=row[2], query="", status=200, bytes=1000, ref="-", src="a.log")
            d.update(row[3] if len(row) > 3 else {})
            full.append(tuple(d.values()))
        return spark.createDataFrame(full, columns)

    return build


@pytest.fixture(scope="session")
def weblog(spark):
    """Lazy tables over a hand-made log."""
    from weblens.plans.prepare import WebLog

    ranges = spark.createDataFrame([(167772160, 167837695, 13238, "YANDEX LLC", "RU"), (167903232, 167968767, 8359, "MTS PJSC", "RU")],
                                   "range_start long, range_end long, asn int, org string, cc string")
    return lambda log: WebLog(spark, log, ranges, ["site.ru"]).store()
