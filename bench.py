"""Benchmark: seconds for the prepare stage and for the headline tables at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Every query result is fully computed (written to the noop
sink), nothing is cached in memory.
"""
import json
import os
import resource
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "w01_sessionize", "w05_p13_visits", "r01_r02_groups", "j04_requests_by_group", "a01_group_totals", "a02_daily_activity", "a03_channels",
    "a09_errors_by_day", "a10_errors_5xx", "a12_broken_links", "a20_address_codes", "a23_error_journal", "a27_load_sources", "a28_mass_requests",
    "a36_attacks", "a43_security_journal", "a44_robot_families", "a52_visit_metrics", "a53_cuts", "a60_marketing_journal", "a62_crawl",
    "w09_outages", "w11_status_history", "j09_redirect_outcome", "r03_signatures", "r11_form_spam", "r20_ip_features", "r25_signature_hits",
    "r25_rule_book",
]


def main():
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from weblens.plans import registry
    from weblens.plans.prepare import WebLog

    start = time.time()
    base = WebLog.from_events(spark, SF_DIR).store()
    timings = {"prepare": round(time.time() - start, 3)}
    t = time.time()
    log = WebLog.keep(spark, SF_DIR, base.judge())
    timings["rule_chain"] = round(time.time() - t, 3)
    t = time.time()
    WebLog.from_events(spark, SF_DIR).store()
    warm = time.time() - t  # the same work again, after the JVM has compiled it; not part of the value
    lines = log.log.count()
    queries = registry.queries()
    for name in HEADLINE:
        t = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t, 3)
    analyze = sum(v for k, v in timings.items() if k != "prepare")
    total = timings["prepare"] + analyze
    print(json.dumps({
        "metric": "prepare plus headline tables", "value": round(total, 3), "unit": "sec", "queries": timings, "sf": SF_DIR.rsplit("sf", 1)[-1],
        "lines": lines, "prepare_lines_per_sec": round(lines / timings["prepare"]), "prepare_warm_sec": round(warm, 3),
        "prepare_warm_lines_per_sec": round(lines / warm), "analyze_sec": round(analyze, 3), "analyze_lines_per_sec": round(lines / analyze),
        "peak_driver_python_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)}))
    spark.stop()


if __name__ == "__main__":
    main()
