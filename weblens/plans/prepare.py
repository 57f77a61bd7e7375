"""The standard plan from requests to grouped visits, built lazily step by step."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import paths
from weblens.marts import security
from weblens.operators import addresses as registry
from weblens.operators import goals as form_goals
from weblens.operators import groups, network, requests, series, sessions
from weblens.plans.store import small_methods, stored
from weblens.rules import chain, scanners
from weblens.sources.access_log import parse_error
from weblens.sources.event_log import error_lines_from_events, requests_from_events

SITE_HOSTS = ["site.ru"]
# small network table used with the event log: (first, last, asn, owner, country)
EVENT_LOG_RANGES = [
    (167772160, 167837695, 13238, "YANDEX LLC", "RU"), (167837696, 167903231, 15169, "Google LLC", "US"),
    (167903232, 167968767, 8359, "MTS PJSC", "RU"), (167968768, 168034303, 24940, "Hetzner Online GmbH", "DE"),
    (168034304, 168034403, 15169, "Google LLC", "US"), (168034404, 168034450, 13238, "YANDEX LLC", "RU"),
]
VISIT_ATTRIBUTES = ["group", "subgroup", "channel", "fam", "fam_cat", "fam_verified", "ua_browser", "asn", "cc", "nettype"]

_PREPARED: dict = {}


class WebLog:
    """Lazy tables of one log: every property is a DataFrame, nothing runs until an action."""

    admin = r"^/admin/"
    #: What the rules are told about the site: networks of services that check it, agents of devices and apps, hosts of its own systems, official networks of robots.
    rule_inputs: dict = {}

    def __init__(self, spark: SparkSession, log: DataFrame, ranges: DataFrame, site_hosts=SITE_HOSTS, error_lines: DataFrame | None = None):
        self.spark, self.log, self.ranges, self.site_hosts, self.error_lines = spark, log, ranges, list(site_hosts), error_lines

    @classmethod
    def prepared(cls, spark: SparkSession, sf_dir: str) -> "JudgedLog":
        """The event log of a data set after the rules, with its prepared tables, built once per Spark application."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _PREPARED:
            cls.keep(spark, sf_dir, cls.from_events(spark, sf_dir).store().judge())
        return _PREPARED[key]

    @staticmethod
    def keep(spark: SparkSession, sf_dir: str, log: "JudgedLog") -> "JudgedLog":
        """Makes a stored log the one that the queries of a data set read."""
        _PREPARED[(spark.sparkContext.applicationId, sf_dir)] = log
        return log

    def store(self) -> "WebLog":
        """Write requests with their features, the dimensions, visits and requests-with-visit; later tables read them.

        The dimensions are cut too: a filter on them would otherwise be pushed below
        their distinct and run the patterns on every request.
        """
        save = lambda name, label: setattr(self, name, stored(self.spark, getattr(self, name), label))
        columns = self.log.columns
        with small_methods(self.spark):
            save("features", "log")
        self.log = self.features.select(*columns)
        with ThreadPoolExecutor(2) as side:  # independent jobs share the cluster
            waits = [side.submit(save, "ip_dim", "ips")]
            if self.error_lines is not None:
                waits.append(side.submit(save, "error_log", "errors"))
            save("ua_dim", "user-agents")
            save("goals", "goals")
            save("visits_raw", "visits-raw")
            for w in waits:
                w.result()
        save("visits", "visits")
        save("rq", "requests")
        save("addresses", "addresses")
        return self

    def judge(self) -> "JudgedLog":
        """The log after the rules, stored: every table of the result sees the final groups and confirmed forms."""
        return JudgedLog(self).store()

    @classmethod
    def from_events(cls, spark: SparkSession, sf_dir: str) -> "WebLog":
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        if len(events.inputFiles()) < spark.sparkContext.defaultParallelism:  # a few small files: use every core
            events = events.repartition(spark.sparkContext.defaultParallelism)
        ranges = spark.createDataFrame(EVENT_LOG_RANGES, "range_start long, range_end long, asn int, org string, cc string")
        log = cls(spark, requests_from_events(events), ranges, SITE_HOSTS, error_lines_from_events(events))
        log.rule_inputs = {"service_asns": [15169], "device_agents": "iPhone", "app_agents": "Telegram-Android", "own_hosts": ["other1.example"]}
        return log

    @cached_property
    def features(self) -> DataFrame:
        return requests.add_features(self.log, self.site_hosts)

    @cached_property
    def ua_dim(self) -> DataFrame:
        return requests.ua_dim(self.log)

    @cached_property
    def ip_dim(self) -> DataFrame:
        return network.ip_dim(self.log, self.ranges, self.ranges)

    @cached_property
    def marked(self) -> DataFrame:
        """Requests with cleaned page flags."""
        return sessions.mark_pages(form_goals.mark_goals(self.features, self.goals))

    @cached_property
    def goals(self) -> DataFrame:
        return form_goals.form_goals(self.features, self.ua_dim)

    @cached_property
    def visits_raw(self) -> DataFrame:
        return sessions.fold_visits(sessions.fold_slots(self.marked))

    @cached_property
    def visits_described(self) -> DataFrame:
        return groups.describe(self.visits_raw, self.ua_dim, self.ip_dim)

    @cached_property
    def visits(self) -> DataFrame:
        """Visits with base groups and monitors, utilities and impostors told apart."""
        return groups.regroup(groups.base_group(self.visits_described), groups.monitor_addresses(self.log, self.ua_dim))

    @cached_property
    def error_log(self) -> DataFrame:
        return parse_error(self.error_lines)

    @cached_property
    def rq_tpl(self) -> DataFrame:
        """Requests with the simple template of their address."""
        return self.rq.withColumn("tpl", paths.simple_template(F.col("base")))

    @cached_property
    def addresses(self) -> DataFrame:
        return registry.address_dim(self.rq)

    @cached_property
    def rq_constructs(self) -> DataFrame:
        """Requests where some addresses are glued by a broken page script."""
        glued = F.when(F.col("req_id") % 53 == 0, F.concat("base", F.lit("${marker.image}"))).when(
            F.col("req_id") % 59 == 0, F.concat("base", F.lit("item.qqq"))).otherwise(F.col("base"))
        return self.rq.withColumn("base", glued)

    @cached_property
    def probes(self) -> DataFrame:
        """Addresses that count as probes on every table. Stored, since joins by address would otherwise run their patterns on every request too."""
        return stored(self.spark, registry.probe_addresses(self.addresses), "probes")

    @cached_property
    def outages(self) -> DataFrame:
        return stored(self.spark, series.outages(self.rq, self.error_log), "outages")

    @cached_property
    def findings(self) -> DataFrame:
        from weblens.plans.queries_cases import _findings
        return stored(self.spark, _findings(self), "findings")

    @cached_property
    def cases(self) -> DataFrame:
        from weblens.plans.queries_cases import _cases
        return stored(self.spark, _cases(self), "cases")

    @cached_property
    def probe_strength(self) -> DataFrame:
        return stored(self.spark, scanners.probe_dim(self.addresses), "probe-strength")

    @cached_property
    def staff(self) -> DataFrame:
        return stored(self.spark, security.staff_ips(self.rq, self.admin), "staff")

    @cached_property
    def rq_attacks(self) -> DataFrame:
        return security.with_attack(self.rq, self.site_hosts)

    @cached_property
    def construct_addresses(self) -> DataFrame:
        return stored(self.spark, registry.address_dim(self.rq_constructs), "construct-addresses")

    @cached_property
    def people(self) -> DataFrame:
        return self.visits.where("group = 'people'")

    @cached_property
    def rq(self) -> DataFrame:
        """Requests with the attributes of their visit."""
        return sessions.with_visit(self.marked, self.visits, *VISIT_ATTRIBUTES)


class JudgedLog(WebLog):
    """A stored log after the chain of rules. ``base`` is the log before it; requests meet the final groups of their visits by (client, slot)."""

    def __init__(self, base: WebLog):
        super().__init__(base.spark, base.log, base.ranges, base.site_hosts, base.error_lines)
        self.base, self.admin, self.rule_inputs = base, base.admin, base.rule_inputs
        for name in ("features", "marked", "goals", "visits_raw", "visits_described", "ip_dim", "ua_dim", *(["error_log"] if base.error_lines is not None else [])):
            setattr(self, name, getattr(base, name))

    def store(self) -> "JudgedLog":
        save = lambda name, label: setattr(self, name, stored(self.spark, getattr(self, name), label))
        save("demoted", "demoted")
        save("visits", "visits-judged")
        save("rq", "requests-judged")
        save("addresses", "addresses-judged")
        return self

    @cached_property
    def gov_operators(self) -> DataFrame:
        return self.spark.createDataFrame([], "ip string, operator string")

    @cached_property
    def demoted(self) -> DataFrame:
        return chain.demoted(self.base.rq)

    @cached_property
    def judged(self) -> DataFrame:
        b = self.base
        return chain.apply_rules(self.spark, b.visits, b.rq, b.addresses, b.staff, self.gov_operators, self.admin, **self.rule_inputs)

    @cached_property
    def visits(self) -> DataFrame:
        return chain.confirm(self.judged, self.base.rq, self.demoted)[0]

    @cached_property
    def rq(self) -> DataFrame:
        rq = chain.confirm(self.judged, self.base.rq, self.demoted)[1]
        return sessions.with_visit(rq.drop("vid", *VISIT_ATTRIBUTES), self.visits, *VISIT_ATTRIBUTES)
