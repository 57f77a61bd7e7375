"""Row features of requests and the dimensions built from distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv


def add_features(requests: DataFrame, site_hosts) -> DataFrame:
    """Static flag, referrer parts, site-host flag and calendar parts. One projection, no shuffle."""
    host = C.ref_host(F.col("ref"))
    return (
        requests.withColumn("ext", C.extension(F.col("base")))
        .withColumn("is_static", F.col("ext").isin(fv.STATIC_EXTENSIONS))
        .withColumn("ref_host", host)
        .withColumn("ref_internal", C.host_is_internal(F.col("ref_host"), site_hosts))
        .withColumn("ref_path", F.when(F.col("ref_internal"), C.ref_path(F.col("ref"))).otherwise(""))
        .withColumn("host_site", C.host_is_internal(F.col("vhost"), site_hosts))
        .withColumn("day", C.log_day(F.col("ts")))
        .withColumn("hour", C.log_hour(F.col("ts")))
    )


def ua_dim(clients: DataFrame) -> DataFrame:
    """One row per user agent with the declared robot family and the browser flags.

    The ordered family patterns run once per distinct user agent, not per request.
    """
    ua = F.col("ua")
    fams = [("", ""), *[(f, c) for _, f, c in fv.ROBOT_FAMILIES]]
    dim = clients.select("ua").distinct().withColumn("_no", C.robot_family_no(ua)).withColumn("ua_old", ua.rlike(fv.UA_OLD))
    return dim.select(
        "ua",
        C.pick(F.col("_no"), [f for f, _ in fams]).alias("fam"),
        C.pick(F.col("_no"), [c for _, c in fams]).alias("fam_cat"),
        (ua.rlike(fv.UA_BROWSER) & ~ua.rlike(fv.UA_NOT_BROWSER) & ~F.col("ua_old") & (F.col("_no") == 0)).alias("ua_browser"),
        "ua_old",
        ua.rlike(fv.UA_MOBILE).alias("ua_mobile"),
        ua.rlike(fv.UA_WEBVIEW).alias("ua_webview"),
        C.monitor_name(ua).alias("monitor_name"),
    )


def salted_lookup(rows: DataFrame, dim: DataFrame, key: str, spread, salts: int = 16) -> DataFrame:
    """Join rows to a dimension on ``key`` without sending a hot key to one task.

    The dimension is repeated ``salts`` times and the rows of one key are spread
    over the copies by ``spread`` (any integer column), so a key that holds a third
    of all rows ends up in ``salts`` partitions.  Small dimensions are still
    broadcast by the optimizer after their size is known.
    """
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
