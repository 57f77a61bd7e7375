"""Form goals and their success rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions.paths import simple_template
from weblens.operators.requests import salted_lookup
from weblens.operators.series import count_if

# fixed values: addresses that look like a form handler; form names in a query
FORM_HINT = r"(?i)form|callback|feedback|order|lead|request|zayav|subscribe|contact|send|submit|question|booking|zapis|anketa|quiz|calc"
FORM_NAME = r"(?i)(?:^|&)(?:form|form_id|WEB_FORM_ID|formid|form_name)=([^&]+)"
RULE_3XX, RULE_200 = "goal: success is 3xx", "goal: success not told by the code (200)"


def form_key():
    name = F.regexp_extract("query", FORM_NAME, 1)
    return F.concat(simple_template(F.col("base")), F.when(name != "", F.concat(F.lit("?form="), name)).otherwise(""))


def form_goals(rq: DataFrame, uas: DataFrame, min_posts: int = 3) -> DataFrame:
    """Addresses that browsers post to from site pages, with the rule that tells success."""
    posts = rq.where("method = 'POST' AND ref_internal").withColumn("key", form_key())
    posts = salted_lookup(posts, uas.select("ua", "ua_browser"), "ua", F.col("ts")).where("ua_browser")
    st, n = F.col("status"), F.col("posts")
    by = posts.groupBy("key").agg(
        F.count(F.lit(1)).alias("posts"), F.count_distinct("ip").alias("ips"), count_if(st.between(200, 399)).alias("_ok"),
        count_if(st.isin(302, 303)).alias("_r3"), count_if(st.isin(301, 308)).alias("_r301"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where(n >= min_posts)
    hint = F.col("key").rlike(FORM_HINT)
    script = F.col("key").endswith(".php") & (F.col("_r3") >= 0.3 * n) & (F.col("ips") >= 5)
    rule = (
        F.when(F.col("_ok") / n < 0.5, "no goal: does not accept POST").when(F.col("_r301") / n >= 0.5, "no goal: redirected (301)")
        .when((F.col("_r3") >= F.greatest(F.lit(2.0), 0.1 * n)) & (hint | script), RULE_3XX)
        .when(hint, RULE_200).otherwise("no goal: background address"))
    return by.withColumn("rule", rule).drop("_ok", "_r3", "_r301")


def mark_goals(rq: DataFrame, goals: DataFrame) -> DataFrame:
    """Add goal and goal_success. Only posts from site pages are joined; all other rows pass through."""
    st, candidate = F.col("status"), F.expr("method = 'POST' AND ref_internal AND host_site")
    rules = goals.where(F.col("rule").startswith("goal")).select("key", "rule")
    posts = rq.where(candidate).withColumn("key", form_key())
    posts = salted_lookup(posts, rules, "key", F.col("ts"))
    success = F.when(F.col("rule") == RULE_3XX, st.isin(302, 303)).when(F.col("rule").isNotNull(), st == 200).otherwise(False)
    posts = posts.withColumn("goal", F.when(F.col("rule").isNotNull(), F.col("key")).otherwise("")).withColumn("goal_success", success)
    rest = rq.where(~candidate).withColumn("goal", F.lit("")).withColumn("goal_success", F.lit(False))
    return rest.unionByName(posts.drop("key", "rule"))
