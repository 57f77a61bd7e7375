"""Address lookups, form signs and parameter companions against plain searches over all pairs."""
import ipaddress
import random

from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.marts import structure
from weblens.operators import network
from weblens.rules import forms


def test_a_range_is_its_shortest_cover(spark):
    rng = random.Random(5)
    bounds = [(0, 2**32 - 1), (0, 0), (2**32 - 1, 2**32 - 1), (10 << 24, (11 << 24) - 1), (1, 2**32 - 2), (7, 6)]
    bounds += [tuple(sorted(rng.randint(0, 1 << rng.randint(1, 32)) % 2**32 for _ in "ab")) for _ in range(60)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(bounds)], "id int, range_start long, range_end long")
    got = {}
    for r in network._blocks(rows).collect():
        got.setdefault(r.id, set()).add((r._block << r._shift, 32 - r._shift))
    ip = ipaddress.IPv4Address
    want = {i: {(int(n.network_address), n.prefixlen) for n in ipaddress.summarize_address_range(ip(a), ip(b))} for i, (a, b) in enumerate(bounds) if a <= b}
    assert got == want and got[3] == {(10 << 24, 8)}


def test_the_smallest_block_names_an_address(spark):
    rng = random.Random(6)
    cidrs = [("10.0.0.0/8", "wide"), ("10.2.0.0/16", "regional"), ("10.2.0.0/26", "office"), ("0.0.0.0/0", "world"), ("10.2.0.5/32", "one")]
    cidrs += [(f"10.{rng.randint(0, 3)}.{rng.randint(0, 3)}.0/{rng.randint(14, 30)}", f"n{i}") for i in range(20)]
    ips = [f"10.{rng.randint(0, 3)}.{rng.randint(0, 3)}.{rng.randint(0, 80)}" for _ in range(200)] + ["10.2.0.5", "9.9.9.9", "::1", "bad"]
    clients = spark.createDataFrame([(i, 5) for i in sorted(set(ips))], "ip string, asn int")
    got = {r.ip: r.operator for r in network.net_operator(clients, spark.createDataFrame(cidrs, "cidr string, operator string"), spark.createDataFrame([(5, "by asn")], "asn int, operator string")).collect()}
    assert set(got) == set(ips) and got["::1"] == got["bad"] == "by asn" and got["9.9.9.9"] == "world" and got["10.2.0.5"] == "one"
    nets = [(ipaddress.ip_network(c, strict=False), o) for c, o in cidrs]
    for ip in set(ips) - {"::1", "bad"}:
        longest = max(n.prefixlen for n, _ in nets if ipaddress.ip_address(ip) in n)
        assert got[ip] in {o for n, o in nets if n.prefixlen == longest and ipaddress.ip_address(ip) in n}


def test_lookups_without_ranges_or_addresses(spark):
    ranges = spark.createDataFrame([(1, 9, 7)], "range_start long, range_end long, asn int")
    rows = spark.createDataFrame([("0.0.0.5", 5), ("x", None)], "ip string, num long")
    assert [(r.ip, r.asn) for r in network.range_lookup(rows, ranges.where("asn = 0")).orderBy("ip").collect()] == [("0.0.0.5", None), ("x", None)]
    assert network.range_lookup(rows.where("num = 0"), ranges).count() == 0


def test_signs_of_form_spam_equal_all_pairs(spark):
    rng = random.Random(7)
    site, w = "https://site.ru", 1800
    people = [(f"p{i}", f"1.1.1.{rng.randint(0, 5)}", rng.choice("uv"), s, s + rng.choice([0, 5, 2000, 9000]), "people", 3, rng.choice(["/a/", "/b/"]), rng.choice([200, 404]))
              for i, s in enumerate(rng.randint(0, 30000) for _ in range(120))]
    seen = [(p[0], p[7]) for p in people] + [(p[0], "/c/") for p in people[::3]]
    asks = [(f"c{i}", f"1.1.1.{rng.randint(0, 5)}", rng.choice("uv"), rng.randint(0, 36000), site + rng.choice(["/a/", "/b/", "/c/", "/"])) for i in range(300)]
    visits = spark.createDataFrame(people, "vid string, ip string, ua string, start long, `end` long, `group` string, n_pages int, entry string, entry_status int")
    rq = spark.createDataFrame(seen, "vid string, base string")
    candidates = spark.createDataFrame(asks, "vid string, ip string, ua string, start long, entry_ref string")
    got = {r.vid for r in forms.same_user_flag(candidates, visits, rq).collect()}
    base = {v: {b for x, b in seen if x == v} for v, _ in seen}
    want = {c for c, ip, ua, t, ref in asks if ref != site + "/"
            for p in people if ref[len(site):] in base[p[0]] and p[1] != ip and p[2] == ua and p[3] <= t and p[4] >= t - w}
    assert got == want and 0 < len(want) < len(asks)
    got = {r.vid for r in forms.ip_switch_flag(candidates, visits, 1500).collect()}
    want = {c for c, ip, _, t, ref in asks for p in people if p[8] == 404 and p[7] == ref[len(site):] and p[1] != ip and t - 1500 <= p[3] <= t}
    assert got == want and 0 < len(want) < len(asks)
    caught = visits.where("entry_status = 404")
    rows = caught.collect()
    got = {r.vid for r in forms.caught_week_flag(candidates, caught, 300).collect()}
    want = {c for c, ip, _, t, _ in asks if any(r.ip == ip and abs(r.start - t) <= 300 for r in rows)}
    assert got == want and 0 < len(want) < len(asks)


def test_companions_equal_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        keys = {rng.choice(["utm_source", "q", "page", "sort", f"k{rng.randint(0, 60)}"])}
        if "utm_source" in keys or rng.random() < 0.2:
            keys |= {"utm_source"} | ({"utm_medium"} if rng.random() < 0.93 else set()) | ({"utm_term"} if rng.random() < 0.9 else set())
        if rng.random() < 0.05:
            keys |= {f"k{j}" for j in range(rng.randint(5, 40))}
        rows.append("&".join(f"{k}={rng.randint(0, 3)}" for k in sorted(keys)))
    log = spark.createDataFrame([(q, "people", 200, True, "GET", True, "") for q in rows], "query string, `group` string, status int, is_page boolean, method string, ref_internal boolean, fam_cat string")
    total, both = {}, {}
    for q in rows:
        keys = {p.split("=")[0] for p in q.split("&")}
        for k in keys:
            total[k] = total.get(k, 0) + 1
            for c in keys - {k}:
                both[k, c] = both.get((k, c), 0) + 1
    for share in (0.9, 0.5, 1.0):
        got = {(r.key, r.companion): (r.n, r.total) for r in structure.param_companions(log, share, slices=4).collect()}
        assert got == {(k, c): (n, total[k]) for (k, c), n in both.items() if n >= share * total[k]}
        assert got
