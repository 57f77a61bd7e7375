"""Declarative rules over requests, sessions and hour/day windows.

A rule is a small dictionary; its predicates become Columns and its counters conditional
aggregates. Rules with the same keys are one scan of the log, sequences of steps another.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.operators.sessions import SLOT
from weblens.plans.store import stored

COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
           "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def _cidr(column: Column, nets) -> Column:
    number = C.ip_to_long(column)
    tests = []
    for net in nets:
        base, _, bits = net.partition("/")
        start = reduce(lambda acc, p: acc * 256 + int(p), base.split("."), 0)
        size = 2 ** (32 - int(bits or 32))
        tests.append(number.between(start // size * size, start // size * size + size - 1))
    return C.any_of(tests)


def _field(column: Column, spec) -> Column:
    if isinstance(spec, list):
        return column.isin(spec)
    if not isinstance(spec, dict):
        return column == spec
    tests = {
        "eq": lambda a: column == a, "ne": lambda a: ~column.eqNullSafe(a), "in": lambda a: column.isin(a), "not_in": lambda a: ~column.isin(a),
        "re": lambda a: column.rlike(a), "not_re": lambda a: ~column.rlike(a), "cidr": lambda a: _cidr(column, a),
        "gt": lambda a: column > a, "gte": lambda a: column >= a, "lt": lambda a: column < a, "lte": lambda a: column <= a,
        "exists": lambda a: column.isNotNull() if a else column.isNull()}
    return reduce(lambda x, y: x & y, [F.coalesce(tests[k](v), F.lit(k in ("not_in", "not_re"))) for k, v in spec.items()])


def predicate(spec: dict | None, lists: dict | None = None) -> Column:
    """Predicate dictionary -> Column; 'all', 'any', 'not' nest, in_list/not_in_list read ``lists``."""
    lists = lists or {}
    parts = []
    for key, value in (spec or {}).items():
        if key == "all":
            parts.append(reduce(lambda a, b: a & b, [predicate(v, lists) for v in value]))
        elif key == "any":
            parts.append(C.any_of([predicate(v, lists) for v in value]))
        elif key == "not":
            parts.append(~predicate(value, lists))
        else:
            if isinstance(value, dict):
                value = {{"in_list": "in", "not_in_list": "not_in"}.get(k, k): (lists[v] if k in ("in_list", "not_in_list") else v) for k, v in value.items()}
            parts.append(F.coalesce(_field(F.col(key), value), F.lit(False)))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


class _Tests:
    """Predicates of many rules as numbered boolean columns; a predicate that several rules share is evaluated once a request."""

    def __init__(self, lists):
        self.lists, self.columns, self.names = lists, [], {}

    def name(self, *specs) -> str:
        """Name of the column that holds where all of the predicates hold."""
        text = json.dumps([s for s in specs if s], sort_keys=True, default=str)
        if text not in self.names:
            self.names[text] = f"_t{len(self.names)}"
            hit = reduce(lambda a, b: a & b, [predicate(s, self.lists) for s in specs])
            self.columns.append(hit.alias(self.names[text]))
        return self.names[text]


def _items(rules: list[dict], tests: _Tests) -> tuple[list[Column], dict, dict]:
    """What a request sends besides itself: for a distinct counter its value, for a burst its second, to the own time block and the one before, since a window reaches into the next block. With the item numbers by (rule, counter) and the burst lengths by item number."""
    made, numbers, bursts = [], {}, {}
    for i, rule in enumerate(rules):
        for j, req in enumerate(rule.get("require", [])):
            if req["agg"] not in ("distinct", "burst"):
                continue
            number = numbers[i, j] = len(numbers) + 1
            hit = F.col(tests.name(rule.get("where"), req.get("match")))
            if req["agg"] == "distinct":
                value = F.col(req["field"]).cast("string")
                made.append(F.when(hit & value.isNotNull(), _item(number, F.xxhash64(value), value, F.lit(None))))
                continue
            bursts[number] = req.get("window", 60)
            for back in (0, 1):
                made.append(F.when(hit, _item(number, F.floor(F.col("ts") / bursts[number]) - back, F.lit(None), F.col("ts"))))
    return made, numbers, bursts


def _item(number: int, block: Column, value: Column, at: Column) -> Column:
    return F.struct(F.lit(number).alias("item"), block.cast("long").alias("block"), value.cast("string").alias("value"), at.cast("long").alias("at"))


def scan(rq: DataFrame, keys: dict[str, Column], rules: list[dict], lists=None) -> DataFrame:
    """Rules that share their keys in one scan: one row (sig, keys, requests, start, end) per group and rule whose counters all hold.

    Counts and spans are conditional aggregates with map-side combine. Distinct values and
    seconds of bursts go along as extra rows, sent once per value or second and task, so a
    group of any size is counted in many tasks.
    """
    tests = _Tests(lists or {})
    names, whole = list(keys), [tests.name(r.get("where")) for r in rules]
    matched = {(i, j): tests.name(r.get("where"), q.get("match")) for i, r in enumerate(rules) for j, q in enumerate(r.get("require", []))}
    items, numbers, bursts = _items(rules, tests)
    fields = sorted({q["field"] for r in rules for q in r.get("require", []) if q["agg"] == "distinct"} - {"ts", *names})
    rows = rq.select(*[c.alias(n) for n, c in keys.items()], "ts", *fields, *tests.columns).where(C.any_of([F.col(w) for w in whole]))
    here = F.lit(True)
    if items:
        itself = _item(0, F.lit(0), F.lit(None), F.lit(None))
        rows = rows.withColumn("_i", F.explode(F.array_compact(F.array(itself, *items)))).select("*", "_i.*").drop("_i")
        here = F.col("item") == 0

    parts = []  # (name, expression over requests, how partial results are put together)
    for i, w in enumerate(whole):
        hit = here & F.col(w)
        parts += [(f"n{i}", F.count_if(hit), F.sum), (f"a{i}", F.min(F.when(hit, F.col("ts"))), F.min), (f"z{i}", F.max(F.when(hit, F.col("ts"))), F.max)]
    for (i, j), m in matched.items():
        hit, agg = here & F.col(m), rules[i]["require"][j]["agg"]
        if agg == "count":
            parts.append((f"c{i}_{j}", F.count_if(hit), F.sum))
        elif agg == "span":
            parts += [(f"a{i}_{j}", F.min(F.when(hit, F.col("ts"))), F.min), (f"z{i}_{j}", F.max(F.when(hit, F.col("ts"))), F.max)]
    if not items:
        out = rows.groupBy(*names).agg(*[e.alias(n) for n, e, _ in parts])
    else:
        per = rows.groupBy(*names, "item", "block", "value", "at").agg(F.count(F.lit(1)).alias("_n"), *[e.alias(n) for n, e, _ in parts])
        near = Window.partitionBy(*names, "item", "block").orderBy("at")
        per = per.select("*", *[F.sum("_n").over(near.rangeBetween(0, s)).alias(f"_d{s}") for s in sorted(set(bursts.values()))])
        more = []
        for (i, j), number in numbers.items():
            mine, seconds = F.col("item") == number, bursts.get(number)
            if seconds is None:
                more.append(F.count_if(mine).alias(f"c{i}_{j}"))
            else:
                own = mine & (F.floor(F.col("at") / seconds) == F.col("block"))
                more.append(F.coalesce(F.max(F.when(own, F.col(f"_d{seconds}"))), F.lit(0)).alias(f"c{i}_{j}"))
        out = per.groupBy(*names).agg(*[again(n).alias(n) for n, _, again in parts], *more)

    found = []
    for i, rule in enumerate(rules):
        holds = F.col(f"n{i}") > 0
        for j, req in enumerate(rule.get("require", [])):
            value = F.coalesce(F.col(f"z{i}_{j}") - F.col(f"a{i}_{j}"), F.lit(0)) if req["agg"] == "span" else F.col(f"c{i}_{j}")
            holds = holds & COMPARE[req["op"]](value, req["value"])
        found.append(F.when(holds, F.struct(F.lit(rule["id"]).alias("sig"), F.col(f"n{i}").cast("long").alias("requests"), F.col(f"a{i}").alias("start"), F.col(f"z{i}").alias("end"))))
    return out.select(*names, F.explode(F.array_compact(F.array(*found))).alias("_h")).select(*names, "_h.*")


def sequence_hits(rq: DataFrame, keys: list[str], rules: list[dict], lists=None) -> DataFrame:
    """(sig, keys) of the sessions that contain the ordered steps of a rule: within seconds, few pages between, first page as anchor.

    Time since a step and pages since a step only grow, so of all requests that reached a
    step the latest one is the best to go on from: one state a step is enough. It is the
    greatest (second, pages so far) among the earlier requests of a time slot, or else
    what the earlier slots hand on, one row a slot. All rules take their steps together;
    rows stay by (session, slot), and only requests that match a step are kept.
    """
    tests = _Tests(lists or {})
    pages = {}
    for rule in rules:
        pages.setdefault(tests.name(rule.get("where"), {"is_page": True}), f"_p{len(pages)}")
    page = [tests.name(r.get("where"), {"is_page": True}) for r in rules]
    step = [[tests.name(r.get("where"), s["match"]) for s in r["sequence"]] for r in rules]
    slot = F.floor(F.col("ts") / SLOT)
    rows = rq.select(*keys, "ts", "req_id", slot.alias("_slot"), *tests.columns).where(C.any_of([F.col(t) for t in {*page, *sum(step, [])}]))
    by = [*keys, "_slot"]
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by).orderBy("ts", "req_id").rowsBetween(Window.unboundedPreceding, -1)

    per = rows.groupBy(*by).agg(*[F.count_if(F.col(t)).alias(p) for t, p in pages.items()])
    offsets = per.select(*by, *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(p) for p in pages.values()])
    rows = rows.join(offsets, by).withColumns({p: F.col(p) + F.coalesce(F.sum(F.col(t).cast("int")).over(inside), F.lit(0)) for t, p in pages.items()})
    at = {}
    for i, rule in enumerate(rules):
        for k, s in enumerate(rule["sequence"]):
            first = F.col(page[i]) & (F.col(pages[page[i]]) == 0) if s.get("first_page_in_session") else F.lit(True)
            at[f"s{i}_{k}"] = F.col(step[i][k]) & first
    rows = rows.withColumns(at).where(C.any_of([F.col(c) for c in at])).select(*by, "ts", "req_id", *sorted(set(page)), *pages.values(), *at)
    rows = stored(rq.sparkSession, rows, "steps")

    for k in range(1, max(len(r["sequence"]) for r in rules)):
        going = [i for i, r in enumerate(rules) if len(r["sequence"]) > k]
        state = {i: F.when(F.col(f"s{i}_{k - 1}"), F.struct(F.col("ts").alias("t"), (F.col(pages[page[i]]) + F.col(page[i]).cast("int")).alias("p"))) for i in going}
        per = rows.groupBy(*by).agg(*[F.max(state[i]).alias(f"_c{i}") for i in going])
        handed = per.select(*by, *[F.max(f"_c{i}").over(earlier).alias(f"_c{i}") for i in going])
        rows = rows.join(handed, by)
        rows = rows.withColumns({f"_c{i}": F.coalesce(F.max(state[i]).over(inside), F.col(f"_c{i}")) for i in going})
        reached = {}
        for i in going:
            s, last = rules[i]["sequence"][k], F.col(f"_c{i}")
            ok = F.col(f"s{i}_{k}") & last.isNotNull()
            if s.get("within") is not None:
                ok = ok & (F.col("ts") - last["t"] <= s["within"])
            if s.get("max_pages_between") is not None:
                ok = ok & (F.col(pages[page[i]]) - last["p"] <= s["max_pages_between"])
            reached[f"s{i}_{k}"] = F.coalesce(ok, F.lit(False))
        rows = rows.withColumns(reached).drop(*[f"_c{i}" for i in going])
    done = F.array_compact(F.array(*[F.when(F.col(f"s{i}_{len(r['sequence']) - 1}"), F.lit(r["id"])) for i, r in enumerate(rules)]))
    return rows.select(*keys, F.explode(done).alias("sig")).distinct()


def sequence_sessions(rows: DataFrame, keys: list[str], steps: list[dict], lists=None) -> DataFrame:
    """Sessions that contain the ordered steps of one sequence."""
    return sequence_hits(rows, keys, [{"id": "", "sequence": steps}], lists).select(*keys)


def seen_404(rq: DataFrame) -> DataFrame:
    """(req_id, ref_seen_404_other_ip): seconds since the page a request came from was last found missing, where that was another address.

    Counted are missing pages of undeclared clients, not files, strictly before the request
    in the order of the log. As with sequences the latest one is looked up inside a time slot
    of the path, or else handed on from earlier slots, one row a slot.
    """
    missing = (F.col("method") == "GET") & (F.col("status") == 404) & (F.col("fam") == "") & ~F.col("is_static")
    came = F.col("ref_internal") & (F.col("ref_path") != "")
    both = F.array_compact(F.array(F.when(missing, F.struct(F.col("base").alias("path"), F.lit(True).alias("miss"))), F.when(came, F.struct(F.col("ref_path").alias("path"), F.lit(False).alias("miss")))))
    slot = F.floor(F.col("ts") / SLOT)
    rows = rq.where(missing | came).select("req_id", "ts", "ip", slot.alias("_slot"), F.explode(both).alias("_b")).select("*", "_b.*").drop("_b")
    rows = stored(rq.sparkSession, rows.join(rows.where("miss").select("path").distinct(), "path", "left_semi"), "referred")
    state = F.when(F.col("miss"), F.struct(F.col("ts").alias("t"), "req_id", F.col("ip").alias("who")))
    earlier = Window.partitionBy("path").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # a request's own missing page counts for later requests only
    inside = Window.partitionBy("path", "_slot").orderBy("ts", "req_id", "miss").rowsBetween(Window.unboundedPreceding, -1)
    handed = rows.groupBy("path", "_slot").agg(F.max(state).alias("_c")).select("path", "_slot", F.max("_c").over(earlier).alias("_c"))
    rows = rows.join(handed, ["path", "_slot"]).withColumn("_c", F.coalesce(F.max(state).over(inside), F.col("_c")))
    return rows.where(~F.col("miss") & (F.col("_c.who") != F.col("ip"))).select("req_id", (F.col("ts") - F.col("_c.t")).alias("ref_seen_404_other_ip"))


def with_rule_fields(rq: DataFrame, forms: str, card: str) -> DataFrame:
    """Fields that rules ask for besides those of the log; ``forms`` and ``card`` are the patterns of form handlers, whoever calls them, and of an item's page."""
    form, ua = F.col("base").rlike(forms), F.col("ua")
    click = F.regexp_extract("query", r"yclid=(\d+)", 1)
    return rq.join(seen_404(rq), "req_id", "left").withColumns({
        "path": F.when(F.col("query") == "", F.col("base")).otherwise(F.concat_ws("?", "base", "query")),
        "is_form_post": form & (F.col("method") == "POST"), "is_form_get": form & (F.col("method") == "GET"), "is_bot_ua": F.col("fam") != "",
        "yclid": F.when(click != "", click), "is_item_card": F.col("base").rlike(card),
        "is_desktop": ua.rlike("Windows NT|Macintosh|X11") & ~ua.contains("Mobile"), "is_mobile": ua.rlike("Mobile|Android|iPhone")})


def _group(rule: dict) -> str:
    """Rules of one group have the same keys and are scanned together."""
    if rule["scope"] == "session":
        return "session"
    return f"{rule.get('key') or 'ip'} {'day' if rule['scope'] == 'request' else rule.get('window') or 'day'}"


def apply_signatures(rq: DataFrame, rules: list[dict], lists: dict | None = None) -> DataFrame:
    """Hits of all rules: sig, key, ip, requests, start, end. ``rq`` has vid (session), day and hour.

    At most five groups of rules: sessions, and days or hours by ip or by ip and user agent;
    a request rule counts its requests by ip and day. Each group is one scan; sequences take
    another one, of the pages and steps only.
    """
    def plain(rule):
        if rule["scope"] != "request":
            return rule
        return {"id": rule["id"], "scope": "request", "where": {"all": [rule.get("where") or {}, rule.get("match") or {}]}}

    day, ip = F.col("day").cast("string"), F.col("ip")
    found = []
    for group in sorted({_group(r) for r in rules}):
        mine = [plain(r) for r in rules if _group(r) == group]
        if group == "session":
            hits = scan(rq, {"ip": ip, "vid": F.col("vid")}, mine, lists).withColumn("key", F.col("ip"))
            ordered = [r for r in mine if r.get("sequence")]
            if ordered:
                reached = sequence_hits(rq, ["vid"], ordered, lists).withColumn("_found", F.lit(True))
                hits = hits.join(reached, ["vid", "sig"], "left").where(F.col("_found") | ~F.col("sig").isin([r["id"] for r in ordered]))
        else:
            key, _, window = group.partition(" ")
            bucket = F.concat_ws(" ", day, F.lpad(F.col("hour").cast("string"), 2, "0")) if window == "hour" else day
            hits = scan(rq, {"ip": ip, "key": F.concat_ws("|", "ip", "ua") if key == "ip_ua" else ip, "window": bucket}, mine, lists)
        found.append(hits.select("sig", "key", "ip", "requests", "start", "end"))
    return reduce(lambda a, b: a.unionByName(b), found)


def signature_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("sig").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("ip").alias("ips"))


def signature_ips(hits: DataFrame, severities: DataFrame) -> DataFrame:
    """Worst severity and number of signatures per IP; ``severities`` has sig, rank."""
    return hits.join(severities, "sig").groupBy("ip").agg(F.max("rank").alias("max_rank"), F.count_distinct("sig").alias("signatures"), F.count(F.lit(1)).alias("hits"))
