"""Networks, templates, components, sequences and rules against brute force."""
import random
from itertools import combinations

from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import paths, personal
from weblens.operators import components, network, series
from weblens.rules import signatures


def test_range_lookup_bounds_and_gaps(spark):
    ranges = spark.createDataFrame([(16777216, 16777471, 1, "one"), (16777728, 33554431, 2, "wide")], "range_start long, range_end long, asn int, org string")
    ips = ["0.0.0.1", "1.0.0.0", "1.0.0.255", "1.0.1.0", "1.0.2.0", "1.255.255.255", "2.0.0.0", "::1", "999.1"]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").withColumn("num", C.ip_to_long(F.col("ip")))
    got = {r.ip: r.asn for r in network.range_lookup(rows, ranges).collect()}
    assert got == {"0.0.0.1": None, "1.0.0.0": 1, "1.0.0.255": 1, "1.0.1.0": None, "1.0.2.0": 2, "1.255.255.255": 2, "2.0.0.0": None, "::1": None, "999.1": None}


def test_templates_collapse_wide_parents(spark):
    bases = [f"/catalog/{w}/page{i}/" for i, w in enumerate(["red", "blue", "green", "black"])] + ["/about/us/", "/item/12/x", "/f/0123456789abcdef01/"]
    rows = spark.createDataFrame([(b,) for b in bases], "base string")
    got = {r.base: r.tpl for r in paths.path_templates(spark, rows, rows, min_children=3).collect()}
    assert got["/catalog/red/page0/"] == "/catalog/*/page*/" and got["/about/us/"] == "/about/us/"
    assert got["/item/12/x"] == "/item/*/x" and got["/f/0123456789abcdef01/"] == "/f/*/"


def test_burst_equals_brute_force(spark):
    rng = random.Random(3)
    times = {k: [rng.randint(0, 400) for _ in range(60)] for k in "ab"}
    rows = spark.createDataFrame([(k, t) for k, v in times.items() for t in v], "ip string, ts long")
    got = {r.ip: r.burst for r in series.burst(rows, ["ip"], 30).collect()}
    assert got == {k: max(sum(1 for x in v if t <= x <= t + 30) for t in v) for k, v in times.items()}


def test_rhythm_finds_the_clockwork_client(make_log):
    rows = [(1704067200 + i * 60, "1.1.1.1", "/") for i in range(320)] + [(1704067200 + i * i % 5000, "2.2.2.2", "/") for i in range(320)]
    found = series.rhythm(make_log(rows)).collect()
    assert [(r.ip, r.median_gap) for r in found] == [("1.1.1.1", 60.0)]


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randint(0, 40):02d}", f"h{rng.randint(0, 30)}") for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for n, h in links:
        parent[find(h)] = find(n)
    nodes = spark.createDataFrame([(n,) for n in sorted({n for n, _ in links})], "node string")
    got = {r.node: r.label for r in components.connect(spark, nodes, spark.createDataFrame(links, "node string, hub string")).collect()}
    for a, b in combinations(got, 2):
        assert (got[a] == got[b]) == (find(a) == find(b))


def operators_by_pairs(evidence, sends):
    """Slow reference: merge groups pair by pair until nothing changes."""
    group = {ip: {ip} for ip, *_ in evidence}
    merged = True
    while merged:
        merged = False
        for a, b in combinations(sorted(group), 2):
            if group[a] is group[b]:
                continue
            signs = lambda g: {(k, s, v) for ip, k, s, v in evidence if ip in g}
            shared = signs(group[a]) & signs(group[b])
            kinds = {(k, s) for k, s, _ in shared}
            wave = any(abs(x - y) <= 7200 for i in group[a] for x in sends.get(i, []) for j in group[b] for y in sends.get(j, []))
            medium = sum(1 for _, s in kinds if s == "medium")
            weak = sum(1 for _, s in kinds if s == "weak") + wave
            if any(s == "strong" for _, s in kinds) or (medium and 2 * medium + weak >= 3):
                union = group[a] | group[b]
                for ip in union:
                    group[ip] = union
                merged = True
    return {frozenset(g) for g in group.values()}


def test_operator_linking_equals_pairwise_merging(spark):
    for seed in (1,):
        rng = random.Random(seed)
        ips = [f"i{n}" for n in range(14)]
        evidence = sorted({(rng.choice(ips), k, s, f"{k}{rng.randint(0, 6)}") for _ in range(26)
                           for k, s in [rng.choice([("shared broken entry", "strong"), ("same entry trick", "medium"), ("referrer is a broken entry", "medium"), ("same browser", "weak")])]})
        sends = {ip: [rng.randint(0, 60000)] for ip in ips}
        ev = spark.createDataFrame(evidence, "ip string, kind string, strength string, value string")
        visits = spark.createDataFrame([(ip, t, "form spam: x") for ip, v in sends.items() for t in v], "ip string, start long, subgroup string")
        got = {}
        for r in components.link_operators(spark, ev, visits).collect():
            got.setdefault(r.operator, set()).add(r.ip)
        assert {frozenset(g) for g in got.values()} == operators_by_pairs(evidence, sends)


def sequence_by_hand(rows, steps):
    """Backtracking search of one session: rows are (ts, base, is_page)."""
    def rec(k, prev):
        for j in range(0 if prev is None else prev + 1, len(rows)):
            if prev is not None:
                if steps[k].get("within") is not None and rows[j][0] - rows[prev][0] > steps[k]["within"]:
                    return False
                if steps[k].get("max_pages_between") is not None and sum(r[2] for r in rows[prev + 1:j]) > steps[k]["max_pages_between"]:
                    return False
            if rows[j][1] == steps[k]["match"]["base"] and (k == len(steps) - 1 or rec(k + 1, j)):
                return True
        return False
    return rec(0, None)


def test_sequences_equal_backtracking(spark):
    rng = random.Random(11)
    data, expected = [], {}
    variants = [
        [{"match": {"base": "/a"}}, {"match": {"base": "/b"}, "within": 20}, {"match": {"base": "/c"}, "max_pages_between": 1}],
        [{"match": {"base": "/a"}}, {"match": {"base": "/b"}}, {"match": {"base": "/c"}, "within": 900, "max_pages_between": 2}],
    ]
    sessions = {}
    for s in range(60):
        t, rows = 1000, []
        for _ in range(rng.randint(1, 12)):
            t += rng.choice([0, 5, 30, 700])
            rows.append((t, rng.choice(["/a", "/b", "/c", "/d"]), rng.random() < 0.5))
        sessions[f"s{s}"] = rows
        data += [(f"s{s}", i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "vid string, req_id long, ts long, base string, is_page boolean")
    for steps in variants:
        got = {r.vid for r in signatures.sequence_sessions(df, ["vid"], steps).collect()}
        expected = {v for v, rows in sessions.items() if sequence_by_hand(rows, steps)}
        assert got == expected and expected


def test_personal_data_and_masking(spark):
    cases = {
        "phone=%2B7916123-45-67": (True, "phone=+7 9** ***-**-67"), "email=ivan%40mail.ru": (True, "email=i***@m***"), "name=Anna": (False, "name=***"),
        "yclid=79161234567": (False, "yclid=79161234567"), "goto=https://x.example/a@b.ru?email=z%40q.ru": (False, None), "token=abcdef123": (False, "token=abcd…"),
        "x=1&fio=Petrov": (True, "x=1&fio=***"), "a=b": (False, "a=b"), "": (False, ""),
    }
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", personal.has_pd(F.col("q")).alias("has"), personal.mask_query(F.col("q")).alias("m")).collect()
    for r in rows:
        assert r.has == cases[r.q][0], r.q
        if cases[r.q][1] is not None:
            assert r.m == cases[r.q][1]


def test_impossible_browsers_and_decoding(spark):
    uas = {"Mozilla/4.0 (Windows 98)": True, "Mozilla/5.0 (iPhone; CPU iPhone OS 5_1 like Mac OS X)": True, "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1)": False,
           "Mozilla/5.0 (X11) Gecko/20300101 Firefox/99": True, "Mozilla/5.0 (X11) Gecko/20100101 Firefox/120": False}
    rows = spark.createDataFrame([(u,) for u in uas], "ua string").select("ua", C.impossible_ua(F.col("ua"), F.lit(2024)).alias("x")).collect()
    assert {r.ua: r.x for r in rows} == uas
    decoded = spark.createDataFrame([("/.%65nv+x%zz",)], "p string").select(C.decode_path(F.col("p")).alias("d")).first().d
    assert decoded == "/.env+x%zz"


def test_labels_settle_on_a_long_chain(spark):
    from weblens.operators.components import connect

    nodes = [f"n{k:03d}" for k in range(200)]
    links = spark.createDataFrame([(n, f"h{k + d}") for k, n in enumerate(nodes) for d in (0, 1)], "node string, hub string")
    labels = connect(spark, spark.createDataFrame([(n,) for n in nodes], "node string"), links)
    assert {r.label for r in labels.collect()} == {"n000"}


def test_regions_climb_to_any_depth(spark):
    from weblens.functions.ads import region_names

    regions = spark.createDataFrame([("c1", "top", "c0", 2), ("c0", "world", None, 1), *[(f"c{k}", f"r{k}", f"c{k - 1}", 9) for k in range(2, 15)], ("x", "x", "y", 9), ("y", "y", "x", 9)], "code string, name string, parent string, level int")
    got = {r.region: (r.name, r.area) for r in region_names(spark, spark.createDataFrame([("c14",), ("x",), ("q",)], "region string"), regions).collect()}
    assert got == {"c14": ("r14", "top"), "x": ("x", ""), "q": ("", "")}


def test_log_fields_are_whole_unless_limits_are_given(spark):
    from weblens.sources import access_log as A

    line = '1.1.1.1 - - [01/Jan/2024:00:00:01 +0300] "GET /' + "a" * 900 + "?" + "q" * 1500 + ' HTTP/1.1" 200 5 "-" "' + "u" * 700 + '"'
    rows = spark.createDataFrame([(line,)], "line string")
    whole, cut = A.parse_access(rows).first(), A.parse_access(rows, A.LIMITS).first()
    assert (len(whole.base), len(whole.query), len(whole.ua)) == (901, 1500, 700) and (len(cut.base), len(cut.query), len(cut.ua)) == (500, 1000, 400)


def test_islands_in_two_levels_equal_one_pass(spark):
    rng = random.Random(8)
    for gap in (1, 3, 2000):
        points = {k: sorted(rng.sample(range(0, 9000), 60) + [20000]) for k in "ab"}
        flagged = {k: {p for p in v if rng.random() < 0.5} for k, v in points.items()}
        rows = spark.createDataFrame([(k, p, p in flagged[k]) for k, v in points.items() for p in v], "k string, minute long, f boolean")
        got = series.spread_island(series.islands(rows, F.col("f"), "minute", gap, "run", ["k"]), "run", "minute", ["k"]).collect()
        for k in "ab":
            number, last, want = 0, None, {}
            for p in points[k]:
                if p in flagged[k]:
                    number += last is None or p - last > gap
                    last, want[p] = p, number
            for p in points[k]:
                was, then = [[want[q] for q in points[k] if q in want and (q <= p if s else q >= p)] for s in (1, 0)]
                want.setdefault(p, was[-1] if was and then and was[-1] == then[0] else None) if p not in flagged[k] else None
            assert {r.minute: r.run for r in got if r.k == k} == {p: want.get(p) for p in points[k]}
    sparse = spark.createDataFrame([(5, 1), (4000, 2)], "minute long, n long")
    grid = {r.minute: r.n for r in series.full_grid(sparse, "minute").collect()}
    assert grid == {m: {5: 1, 4000: 2}.get(m, 0) for m in range(5, 4001)}
