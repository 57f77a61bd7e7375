"""Check queries for streams: the same counts over the whole log, of what the watermark has closed when the stream ends."""

from oracles.prelude import sql

SQL = {
    "t01_stream_sessions": sql("features", """, g AS (SELECT ip, ua, ts, bytes, CASE WHEN ts - lag(ts) OVER c > 1800 THEN 1 ELSE 0 END AS new FROM rf WINDOW c AS (PARTITION BY ip, ua ORDER BY ts)),
        n AS (SELECT *, sum(new) OVER (PARTITION BY ip, ua ORDER BY ts) AS k FROM g),
        s AS (SELECT ip, ua, min(ts) AS "start", max(ts) AS "end", count(*) AS n_req, CAST(sum(bytes) AS BIGINT) AS bytes FROM n GROUP BY ip, ua, k)
        SELECT ip, ua, "start", "end", n_req, bytes FROM s WHERE "end" + 1800 <= (SELECT max(ts) - 600 FROM rf)"""),
    "t02_stream_recent_404": sql("features", """SELECT DISTINCT e.req_id, e.ip, m.base AS path, m.ip AS ip_404 FROM rf e JOIN rf m
        ON e.ref_internal AND e.ref_path = m.base AND m.method = 'GET' AND m.status = 404 AND e.ip <> m.ip AND e.ts BETWEEN m.ts AND m.ts + 7200"""),
    "t03_stream_window_counters": sql("features", """SELECT ip, CAST(ts // 3600 * 3600 AS BIGINT) AS window_start, count(*) AS requests, count(DISTINCT base) AS addresses FROM rf
        WHERE ts // 3600 * 3600 + 3600 <= (SELECT max(ts) - 600 FROM rf) GROUP BY 1, 2"""),
    "t04_stream_sliding_burst": sql("features", """, b AS (SELECT DISTINCT ip, ts AS "start", count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS requests FROM rf)
        SELECT ip, "start", requests FROM b WHERE requests >= 4 AND "start" + 60 < (SELECT max(ts) - 60 FROM rf)"""),
    "t05_stream_minute_alerts": sql("features", """, p AS (SELECT ip, ts FROM rf WHERE method IN ('GET', 'HEAD') AND NOT is_static)
        SELECT ip, CAST(ts // 60 * 60 AS BIGINT) AS minute, count(*) AS pages FROM p WHERE ts // 60 * 60 + 60 <= (SELECT max(ts) - 60 FROM p) GROUP BY 1, 2 HAVING count(*) >= 2"""),
    "t06_late_rows": sql("features", """, d AS (SELECT min(ts) + (max(ts) - min(ts)) // 4 AS border, min(ts) + 2 * (max(ts) - min(ts)) // 4 AS middle FROM rf),
        m AS (SELECT max(ts) - 60 AS watermark FROM rf, d WHERE ts < middle)
        SELECT CAST(CASE WHEN ts < border THEN 2 WHEN ts < middle THEN 0 ELSE 1 END AS BIGINT) AS batch, count(*) AS rows, count(*) FILTER (WHERE ts < border AND ts < watermark) AS late FROM rf, d, m GROUP BY 1"""),
}
