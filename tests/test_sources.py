"""Line formats, file kinds, overlaps, archives and sinks."""
import gzip
import zipfile

from pyspark.sql import functions as F

from weblens.sources import access_log, sinks

LINES = [
    '﻿1.2.3.4 - bob site.ru [01/Feb/2024:10:00:01 +0300] "GET /a/b.html?x=1&y=2 HTTP/1.1" 200 123 "https://ya.ru/" "UA one" "0.123" tail',
    '1.2.3.4 - - [01/Feb/2024:10:00:02 +0300] "POST /send HTTP/2.0" 302 - "-" "UA"',
    '5.6.7.8 - - [01/Feb/2024:10:00:03 +0300] "GET /common HTTP/1.0" 404 7',
    '5.6.7.8 - - [01/Feb/2024:10:00:04 +0300] "GET /twoparts" 400 0 "-" "-"',
    '5.6.7.8 - - [01/Feb/2024:10:00:05 +0300] "\\x16\\x03\\x01" 400 150 "-" "-"',
    "not a log line",
]


def test_access_variants(spark):
    lines = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "line_no long, line string")
    rows = {r.line_no: r for r in access_log.parse_access(lines).collect()}
    assert set(rows) == {0, 1, 2, 3, 4}
    assert (rows[0].ip, rows[0].user, rows[0].vhost, rows[0].base, rows[0].query, rows[0].tail) == ("1.2.3.4", "bob", "site.ru", "/a/b.html", "x=1&y=2", '"0.123" tail')
    assert (rows[1].method, rows[1].bytes, rows[1].status, rows[1].proto) == ("POST", 0, 302, "HTTP/2.0")
    assert (rows[2].base, rows[2].ref, rows[2].ua) == ("/common", "", "")
    assert (rows[3].method, rows[3].base, rows[3].proto) == ("GET", "/twoparts", "")
    assert (rows[4].method, rows[4].base) == ("-", "\\x16\\x03\\x01")
    assert rows[0].ts == 1706781601 and rows[0].tz_offset == "+0300"


def test_error_formats(spark):
    lines = [
        '2024/02/01 10:00:00 [error] 12#0: *7 upstream timed out, client: 1.1.1.1, server: site.ru, request: "GET /x HTTP/1.1", host: "site.ru"',
        "[Thu Feb 01 10:00:01.123456 2024] [php:error] PHP Fatal error: boom",
    ]
    rows = access_log.parse_error(spark.createDataFrame([(x,) for x in lines], "line string")).orderBy("ts").collect()
    assert (rows[0].level, rows[0].msg, rows[0].client, rows[0].request) == ("error", "upstream timed out", "1.1.1.1", "GET /x HTTP/1.1")
    assert (rows[1].level, rows[1].msg, rows[1].ts - rows[0].ts) == ("php:error", "PHP Fatal error: boom", 1)


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "site.ru-access.log").write_text("\n".join(LINES[1:3]) + "\n")
    with gzip.open(tmp_path / "site.ru-access.log.1.gz", "wt") as f:
        f.write(LINES[3] + "\n")
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as z:
        z.writestr("logs/a.log", LINES[4] + "\n")
        z.writestr("logs/b.log.gz", gzip.compress((LINES[0] + "\n").encode()))
        z.writestr("logs/.hidden", "junk\n")
    plain = access_log.read_lines(spark, str(tmp_path)).groupBy("src").count()
    assert {r.src: r["count"] for r in plain.collect()} == {"site.ru-access.log": 2, "site.ru-access.log.1.gz": 1}
    zipped = access_log.read_zip_lines(spark, str(tmp_path)).select("src", "line_no").collect()
    assert sorted((r.src, r.line_no) for r in zipped) == [("old.zip:logs/a.log", 0), ("old.zip:logs/b.log.gz", 0)]


def test_lines_are_numbered_across_the_splits_of_a_file(spark, tmp_path):
    texts = {"a.log": [f"{i} " + "x" * (i * 7 % 90) for i in range(400)], "b.log": ["", "only", ""], "c.log.gz": [f"z{i}" for i in range(50)], "empty.log": []}
    for name, lines in texts.items():
        with (gzip.open if name.endswith(".gz") else open)(tmp_path / name, "wt") as f:
            f.writelines(x + "\n" for x in lines)
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "1000")
        spark.conf.set(names[1], "10")
        rows = access_log.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        got = sorted((r.src, r.line_no, r.line) for r in rows.collect())
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)
    assert got == sorted((name, i, x) for name, lines in texts.items() for i, x in enumerate(lines))
    kinds = access_log.sniff(rows, 3)
    assert {r.src: r.kind for r in kinds.collect()} == {"a.log": "unknown", "b.log": "unknown", "c.log.gz": "unknown"}


def test_overlaps_keep_the_earliest_file(make_log):
    t = 1704067200
    rows = [(t + i, "1.1.1.1", "/a/") for i in range(10)] + [(t + i, "1.1.1.1", "/a/", {"src": "b.log"}) for i in range(5, 10)]
    rows += [(t + 60 + i, "1.1.1.1", "/a/") for i in range(4)] + [(t + 60 + i, "1.1.1.1", "/a/", {"src": "b.log"}) for i in range(4)]
    kept = {r.src: r["count"] for r in access_log.drop_overlaps(make_log(rows)).groupBy("src").count().collect()}
    assert kept == {"a.log": 14, "b.log": 5}
    report = access_log.overlap_report(make_log(rows)).collect()
    assert [(r.minutes_duplicate, r.minutes_partial, r.lines_duplicate) for r in report] == [(1, 1, 4)]


def test_rules_ranges_and_indicator_file(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"id": "x", "items": [{"id": "a", "pattern": "p"}, {"id": "b", "pattern": "q"}]}')
    assert sinks.read_rules(spark, str(tmp_path / "rules.json"), "items").count() == 2
    (tmp_path / "asn.csv").write_text('1,5,100,"Some, Org"\n10,20,200,Other\n')
    ranges = sinks.read_ip_ranges(spark, str(tmp_path / "asn.csv")).collect()
    assert [(r.range_start, r.asn, r.org) for r in ranges] == [(1, 100, "Some, Org"), (10, 200, "Other")]
    rows = spark.range(20).select(F.col("id").cast("string").alias("x"))
    assert sinks.write_big_csv(rows, str(tmp_path / "big"), 100) is False
    assert sinks.write_big_csv(rows, str(tmp_path / "big"), 10) is True
