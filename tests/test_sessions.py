"""Visits against a plain Python model on random logs, and boundary cases."""
import random

from pyspark.sql import functions as F

from weblens.operators import sessions


def model(rows):
    """Visits and page flags of (req_id, ts, ip, base, status, is_static) rows of one browser."""
    visits, flags = {}, {}
    for ip in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == ip), key=lambda r: (r[1], r[0]))
        start, last, prev_page, pages = None, None, None, []
        for r in mine:
            if last is None or r[1] - last > 1800:
                start = r[1]
            last = r[1]
            visits.setdefault((ip, start), []).append(r)
            if r[5]:
                flags[r[0]] = (False, False)
                continue
            dup = prev_page is not None and prev_page[3] == r[3] and r[1] - prev_page[1] <= 5
            flags[r[0]] = [dup, False]
            if prev_page is not None and prev_page[4] in (301, 302) and r[1] - prev_page[1] <= 3:
                flags[prev_page[0]][1] = True
            prev_page = r
    return visits, {k: tuple(v) for k, v in flags.items()}


def test_random_logs_match_the_model(make_log, weblog):
    rng = random.Random(7)
    raw, rows = [], []
    for i in range(1500):
        ts = 1704067200 + rng.choice([0, 600, 1200, 40000]) + rng.randint(-6, 6) + rng.choice([0, 1800, 1801, 3600]) * rng.randint(0, 3)
        ip = f"10.0.0.{rng.randint(1, 4)}"
        base = rng.choice(["/a/", "/b/", "/c/", "/x.css"])
        status = rng.choice([200, 200, 301, 404])
        raw.append((i, ts, ip, base, status, base.endswith(".css")))
        rows.append((ts, ip, base, {"status": status}))
    w = weblog(make_log(rows))
    visits, flags = model(raw)
    got = {(r.ip, r.start): (r.n_req, r.end) for r in w.visits_raw.collect()}
    assert got == {k: (len(v), max(x[1] for x in v)) for k, v in visits.items()}
    marked = {r.req_id: (r.is_dup, r.is_redirect_hop) for r in w.marked.collect()}
    assert marked == flags
    ids = sessions.with_visit(w.marked, w.visits_raw, "start").select("req_id", "ip", "start").collect()
    assert {r.req_id: (r.ip, r.start) for r in ids} == {x[0]: k for k, v in visits.items() for x in v}


def test_gap_boundary_and_order_of_lines(make_log, weblog):
    t = 1704067200
    rows = [(t, "1.1.1.1", "/a/"), (t + 1800, "1.1.1.1", "/b/"), (t + 3601, "1.1.1.1", "/c/")]
    for variant in (rows, rows[::-1]):
        starts = sorted((r.start, r.n_req) for r in weblog(make_log(variant)).visits_raw.collect())
        assert starts == [(t, 2), (t + 3601, 1)]


def test_one_client_with_a_third_of_all_rows_is_spread_over_slots(make_log, weblog):
    rows = [(1704067200 + i * 7, "9.9.9.9", "/hot/") for i in range(3000)] + [(1704067200 + i, f"1.1.{i % 250}.1", "/p/") for i in range(6000)]
    w = weblog(make_log(rows))
    hot = w.visits_raw.where("ip = '9.9.9.9'").collect()
    assert len(hot) == 1 and hot[0].n_req == 3000
    biggest = w.marked.groupBy("ip", "ua", "host_site", "slot").count().agg(F.max("count")).first()[0]
    assert biggest <= 600


def test_empty_log_gives_typed_empty_tables(make_log, weblog):
    w = weblog(make_log([(1704067200, "1.1.1.1", "/")]).where("false"))
    assert w.visits.count() == 0
    assert {"group", "channel", "n_pages"} <= set(w.visits.columns)
