"""The rule engine against a plain reading of the rules, request by request."""

import random

import pytest
from pyspark.sql import functions as F

from weblens.plans.queries_signatures import ADMIN, CARD, ENTRY, FORMS, LISTS
from weblens.rules import rule_book, signatures

COLUMNS = "req_id long, ts long, ip string, ua string, vid string, day date, hour int, base string, status int, method string, is_page boolean, is_static boolean, fam string, ref_internal boolean, ref_path string"

RULES = [
    {"id": "req", "scope": "request", "where": {"status": {"gte": 400}}, "match": {"any": [{"base": "/a"}, {"base": {"re": "^/b"}}]}},
    {"id": "day", "scope": "window", "window": "day", "where": {"is_page": True}, "require": [
        {"agg": "distinct", "field": "base", "op": ">=", "value": 3}, {"agg": "span", "op": ">", "value": 1000}, {"agg": "distinct", "field": "fam", "match": {"status": 200}, "op": "<", "value": 3}]},
    {"id": "hour", "scope": "window", "window": "hour", "key": "ip_ua", "require": [{"agg": "count", "match": {"status": 404}, "op": ">=", "value": 2}, {"agg": "count", "match": {"base": "/c"}, "op": "==", "value": 0}]},
    {"id": "dense", "scope": "session", "require": [{"agg": "burst", "match": {"is_page": True}, "window": 15, "op": ">=", "value": 3}, {"agg": "burst", "window": 60, "op": "<", "value": 9}]},
    {"id": "steps", "scope": "session", "where": {"base": {"ne": "/d"}}, "sequence": [
        {"match": {"base": "/a"}, "first_page_in_session": True}, {"match": {"is_page": True}, "within": 900, "max_pages_between": 1}, {"match": {"base": "/b"}, "within": 700}],
     "require": [{"agg": "count", "match": {"is_static": True}, "op": "<=", "value": 4}]},
    {"id": "far", "scope": "session", "sequence": [{"match": {"base": "/a"}}, {"match": {"base": "/b"}, "max_pages_between": 2}, {"match": {"base": "/c"}}, {"match": {"base": "/a"}, "within": 2000}]},
]


def log(seed):
    rng = random.Random(seed)
    rows = []
    for s in range(40):
        t, client = 1_700_000_000 + rng.randint(0, 200_000), f"10.0.0.{rng.randint(0, 5)}"
        for _ in range(rng.randint(1, 60 if s == 0 else 14)):
            t += rng.choice([0, 1, 4, 20, 300, 700])
            base = rng.choice(["/a", "/b", "/b2", "/c", "/d"])
            page = rng.random() < 0.6
            rows.append((len(rows), t, client, rng.choice(["u1", "u2"]), f"s{s}", t // 86400, t // 3600 % 24, base, rng.choice([200, 404, 500, None]), "GET", page, not page,
                         rng.choice(["", "", "bot", None]), rng.random() < 0.5, rng.choice(["/a", "/b", ""])))
    return rows


def frame(spark, rows):
    raw = spark.createDataFrame(rows, COLUMNS.replace("day date", "day int"))
    return raw.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")))


def holds(spec, r):
    for k, v in (spec or {}).items():
        if k == "any":
            ok = any(holds(x, r) for x in v)
        elif isinstance(v, dict):
            (op, a), x = next(iter(v.items())), r[k]
            import re
            ok = x is not None and {"gte": lambda: x >= a, "re": lambda: re.search(a, x), "ne": lambda: x != a}[op]()
        else:
            ok = r[k] == v
        if not ok:
            return False
    return True


def value(rows, req):
    hit = [r for r in rows if holds(req.get("match"), r)]
    if req["agg"] == "count":
        return len(hit)
    if req["agg"] == "distinct":
        return len({r[req["field"]] for r in hit} - {None})
    times = [r["ts"] for r in hit]
    if req["agg"] == "span":
        return max(times) - min(times) if times else 0
    return max((sum(t <= u <= t + req["window"] for u in times) for t in times), default=0)


def ordered(rows, steps):
    """All chains tried, one after the other."""
    rows = sorted(rows, key=lambda r: (r["ts"], r["req_id"]))
    anchor = next((i for i, r in enumerate(rows) if r["is_page"]), None)
    at = [i for i, r in enumerate(rows) if holds(steps[0]["match"], r) and (not steps[0].get("first_page_in_session") or i == anchor)]
    for s in steps[1:]:
        at = [j for j, r in enumerate(rows) if holds(s["match"], r) and any(
            i < j and r["ts"] - rows[i]["ts"] <= s.get("within", 10**9) and sum(x["is_page"] for x in rows[i + 1:j]) <= s.get("max_pages_between", 10**9) for i in at)]
    return bool(at)


def plain(rows, rules):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows, out = [dict(zip(names, r)) for r in rows], []
    for rule in rules:
        seen = {}
        for r in rows:
            if holds(rule.get("where"), r) and (rule["scope"] != "request" or holds(rule["match"], r)):
                key = r["ip"] + "|" + r["ua"] if rule.get("key") == "ip_ua" else r["ip"]
                window = r["vid"] if rule["scope"] == "session" else (r["day"], r["hour"] if rule.get("window") == "hour" else 0)
                seen.setdefault((key, window), []).append(r)
        for (key, _), got in seen.items():
            if all(signatures.COMPARE[q["op"]](value(got, q), q["value"]) for q in rule.get("require", [])) and (not rule.get("sequence") or ordered(got, rule["sequence"])):
                out.append((rule["id"], key, got[0]["ip"], len(got), min(r["ts"] for r in got), max(r["ts"] for r in got)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_plain_reading(spark, seed):
    rows = log(seed)
    got = sorted(tuple(r) for r in signatures.apply_signatures(frame(spark, rows), RULES).collect())
    assert got == plain(rows, RULES)
    assert {g[0] for g in got} >= {"req", "day", "hour", "dense", "far"}


def test_one_long_session_spans_slots(spark):
    """A chain whose steps lie hours apart, with other steps between them that cannot go on."""
    rows = [(i, 1_700_000_000 + t, "10.0.0.1", "u1", "s", 0, 0, b, 200, "GET", b != "/x", b == "/x", "", False, "") for i, (t, b) in enumerate(
        [(0, "/a"), (3, "/x"), (9000, "/b"), (9000, "/x"), (20000, "/c"), (41000, "/x"), (42000, "/a")])]
    far = [{"match": {"base": "/a"}}, {"match": {"base": "/b"}, "max_pages_between": 0}, {"match": {"base": "/c"}}, {"match": {"base": "/a"}, "within": 22000}]
    assert [r.vid for r in signatures.sequence_sessions(frame(spark, rows), ["vid"], far).collect()] == ["s"]
    near = far[:3] + [{"match": {"base": "/a"}, "within": 21999}]
    assert signatures.sequence_sessions(frame(spark, rows), ["vid"], near).count() == 0
    assert signatures.apply_signatures(frame(spark, rows).limit(0), RULES).count() == 0


def test_missing_referring_page(spark):
    rows, names = [r[:8] + (404 if i % 3 == 0 else 200,) + r[9:] for i, r in enumerate(log(5))], [c.split()[0] for c in COLUMNS.split(", ")]
    got = {r.req_id: r.ref_seen_404_other_ip for r in signatures.seen_404(frame(spark, rows)).collect()}
    data, last, expected = sorted((dict(zip(names, r)) for r in rows), key=lambda r: (r["ts"], r["req_id"])), {}, {}
    for r in data:
        before = last.get(r["ref_path"]) if r["ref_internal"] else None
        if before and before[1] != r["ip"]:
            expected[r["req_id"]] = r["ts"] - before[0]
        if r["status"] == 404 and r["fam"] == "" and not r["is_static"]:
            last[r["base"]] = (r["ts"], r["ip"])
    assert got == expected and expected


def test_book_of_rules_fires(spark, weblog, make_log):
    """Each kind of visit that the book describes is found, and a plain visitor is not."""
    post, dead, agent = {"method": "POST"}, {"status": 404}, "Mozilla/5.0 (X11; Linux) HeadlessChrome/120"
    t, rows = 1_700_000_000, []
    rows += [(t, "10.1.0.1", "/catalog/item-1", dead), (t + 20, "10.1.0.1", "/"), (t + 60, "10.1.0.1", "/contacts/send/", post)]
    rows += [(t, "10.1.0.2", "/contacts/send/", post)]
    rows += [(t + i, "10.1.0.3", f"/catalog/item-{i}/") for i in range(7)] + [(t + 20 + i, "10.1.0.3", "/contacts/send/", post) for i in range(2)]
    rows += [(t + i, "10.1.0.4", "/contacts/send/", {**post, "ua": f"Mozilla/5.0 (Windows NT 10.0) Chrome/9{i}.0"}) for i in range(3)]
    rows += [(t, "10.1.0.5", "/contacts/old-send/", {**post, **dead}), (t, "10.1.0.7", "/contacts/send/", post), (t, "10.1.0.8", "/old/page-1/", dead)]
    rows += [(t, "10.1.0.9", "/catalog/tel:88001234567"), (t, "10.1.0.10", "/", {"ua": agent})]
    rows += [(t + i, "10.1.0.11", p, dead) for i, p in enumerate(["/.env", "/.git/config", "/wp-login.php"])]
    rows += [(t + 100 * i, "10.1.0.12", "/search/", {"query": f"yclid={i}"}) for i in range(8)]
    rows += [(t, "10.3.0.1", "/"), (t + 1, "10.3.0.1", "/static/app.css"), (t + 30, "10.3.0.1", "/catalog/item-2/")]
    rows += [(t + i, "10.9.0.1", "/", {"ua": f"Mozilla/5.0 (compatible; {n}; +http://robot.example)"}) for i, n in enumerate(["Googlebot/2.1", "AhrefsBot/7.0", "GPTBot/1.1", "YandexBot/3.0"])]
    # the page that 10.1.0.13 says to come from was missing for 10.1.0.1
    rows += [(t + 300, "10.1.0.13", "/", {"ref": "https://site.ru/catalog/item-1"}), (t + 330, "10.1.0.13", "/contacts/send/", post)]
    log_rows = make_log(sorted(rows, key=lambda r: r[0]))
    rq = signatures.with_rule_fields(weblog(log_rows).rq, FORMS, CARD)
    got = {}
    for r in signatures.apply_signatures(rq, rule_book.rules(ENTRY, ADMIN), LISTS).collect():
        got.setdefault(r.sig, set()).add(r.ip)
    assert got["spam_dead_entry"] == {"10.1.0.1"} and got["spam_ip_switch"] == {"10.1.0.13"}
    assert {"10.1.0.2", "10.1.0.4"} <= got["form_without_pages"] and got["fast_pages_and_forms"] == {"10.1.0.3"} and got["form_agents"] == {"10.1.0.4"}
    assert got["removed_handlers"] == {"10.1.0.5"} and got["known_spam_ip"] == {"10.1.0.7"} and got["scouting"] == {"10.1.0.8", "10.1.0.11"}  # /.env is on the list too
    assert got["tel_as_page"] == {"10.1.0.9"} and got["headless"] == {"10.1.0.10"} and got["probing"] == {"10.1.0.11"} and got["ad_clicks"] == {"10.1.0.12"}
    assert got["robot_rotation"] == {"10.9.0.1"}
    assert "10.1.0.8" in got["no_browser"] and not any("10.3.0.1" in ips for ips in got.values())
