"""Check queries for sources, minutes, days and templates."""

from oracles.prelude import ERROR_LINES, REQUESTS, SEGMENT, plain_counts, sql

_FILES = """,
two AS (SELECT *, 'site.ru-access.log' AS src FROM requests WHERE ts < 1705536000 UNION ALL
        SELECT *, 'site.ru-access.log.1' AS src FROM requests WHERE ts >= 1704931200 AND NOT (ts >= 1705363200 AND req_id % 97 = 0)),
mi AS (SELECT src, ts // 60 AS minute, count(*) AS n FROM two GROUP BY ALL),
mj AS (SELECT *, min(minute) OVER (PARTITION BY src) AS sf FROM mi),
mk AS (SELECT *, first(n) OVER w AS rn, row_number() OVER w AS k FROM mj WINDOW w AS (PARTITION BY minute ORDER BY sf, src)),
dd AS (SELECT src, minute, n, n = rn AS dup FROM mk WHERE k > 1)"""

_GRID = """,
pm AS (SELECT ts // 60 AS minute, count(*) AS n FROM requests GROUP BY 1),
gr AS (SELECT unnest(range((SELECT min(minute) FROM pm), (SELECT max(minute)+1 FROM pm))) AS minute),
gn AS (SELECT minute, coalesce(n, 0) AS n, CAST(minute // 60 % 24 AS INT) AS hod FROM gr LEFT JOIN pm USING (minute)),
mn AS (SELECT *, median(n) OVER (PARTITION BY hod) AS norm FROM gn)"""

_DB = "Too many connections|MySQL server has gone away|Lost connection|Can.t connect to|SQLSTATE|DB query error|Deadlock|marked as crashed|mysqli|Connection refused.*3306"
OUTAGES = f""",{ERROR_LINES},
om AS (SELECT ts // 60 AS minute, count_if(pg AND status>=500) AS p5, count_if(pg AND status=499) AS p499, count_if(pg) AS p, count(*) AS n,
  count_if(is_static AND status<400) AS s_ok, count_if(is_static) AS s, count(DISTINCT ip) FILTER (WHERE pg AND status>=500) AS ip5
  FROM (SELECT *, is_page OR method='POST' AS pg FROM rg) GROUP BY 1),
oe AS (SELECT ts // 60 AS minute, count_if(regexp_matches(msg, '{_DB}')) AS dbm, count_if(regexp_matches(msg, 'upstream timed out|connect\\(\\) failed')) AS upm FROM el GROUP BY 1),
og AS (SELECT unnest(range((SELECT min(minute) FROM om), (SELECT max(minute)+1 FROM om))) AS minute),
o1 AS (SELECT og.minute, coalesce(p5,0) AS p5, coalesce(p499,0) AS p499, coalesce(p,0) AS p, coalesce(n,0) AS n, coalesce(s_ok,0) AS s_ok, coalesce(s,0) AS s, coalesce(ip5,0) AS ip5,
  coalesce(dbm,0) AS dbm, coalesce(upm,0) AS upm, og.minute // 60 % 24 AS hod FROM og LEFT JOIN om USING (minute) LEFT JOIN oe USING (minute)),
o2 AS (SELECT *, (p5+p499) / greatest(p,1) AS share FROM o1),
o3 AS (SELECT *, coalesce(median(CASE WHEN p>=5 THEN share END) OVER (PARTITION BY hod),0) AS bs, median(n) OVER (PARTITION BY hod) AS bn FROM o2),
o4 AS (SELECT *, p5>=3 AND ip5>=3 AND p5/greatest(p,1)>=0.25 AS peak, (p>=5 AND share>=greatest(3*bs,0.2)) OR (p5>=3 AND ip5>=3 AND p5/greatest(p,1)>=0.25) AS bad, n<0.3*bn AND bn>=20 AS dropped FROM o3),
wf AS (SELECT minute, CASE WHEN minute - lag(minute) OVER (ORDER BY minute) <= 3 THEN 0 ELSE 1 END AS new FROM o4 WHERE bad OR dropped),
wi AS (SELECT min(minute) AS a, max(minute) AS b FROM (SELECT minute, sum(new) OVER (ORDER BY minute) AS k FROM wf) GROUP BY k),
wp AS (SELECT * FROM wi WHERE EXISTS (SELECT 1 FROM o4 WHERE peak AND minute BETWEEN a AND b)),
nf AS (SELECT minute, CASE WHEN minute - lag(minute) OVER (ORDER BY minute) <= 3 THEN 0 ELSE 1 END AS new FROM o4 WHERE bad),
ni AS (SELECT min(minute) AS a, max(minute) AS b FROM (SELECT minute, sum(new) OVER (ORDER BY minute) AS k FROM nf) GROUP BY k),
np AS (SELECT * FROM ni WHERE NOT EXISTS (SELECT 1 FROM o4 WHERE peak AND minute BETWEEN a AND b) AND b-a+1>=10 AND NOT EXISTS (SELECT 1 FROM wp WHERE wp.a<=ni.a AND ni.b<=wp.b)),
sp AS (SELECT * FROM wp UNION ALL SELECT * FROM np),
sq AS (SELECT a, b, min(minute) FILTER (WHERE peak) AS fa, max(minute) FILTER (WHERE peak) AS fb FROM sp JOIN o4 ON minute BETWEEN a AND b GROUP BY a, b),
sr AS (SELECT a, b, fa IS NOT NULL AS hp, coalesce(fa,a) AS pa, coalesce(fb,b) AS pb FROM sq),
ss AS (SELECT a, b, hp, pa, pb, sum(p5) AS x5, sum(p499) AS x499, sum(s_ok) AS sok, sum(s) AS sall, sum(dbm) AS dbm, sum(upm) AS upm,
  sum(p5) FILTER (WHERE minute BETWEEN pa AND pb) AS q5, sum(p) FILTER (WHERE minute BETWEEN pa AND pb) AS qp, avg(n) FILTER (WHERE minute BETWEEN pa AND pb) AS qn,
  avg(bn) FILTER (WHERE minute BETWEEN pa AND pb) AS qbn FROM sr JOIN o4 ON minute BETWEEN a AND b GROUP BY ALL),
outages AS (SELECT a*60 AS degraded_from, pa*60 AS peak_from, pb*60+59 AS peak_to, b*60+59 AS degraded_to, CASE WHEN hp THEN pb-pa+1 ELSE 0 END AS peak_minutes, b-a+1 AS total_minutes,
  CAST(x5 AS BIGINT) AS pages_5xx, CAST(x499 AS BIGINT) AS aborted_499, round(q5/greatest(qp,1),4) AS peak_share, CAST(floor(qn) AS BIGINT) AS requests_per_minute, CAST(floor(qbn) AS BIGINT) AS usual_per_minute,
  round(sok/greatest(sall,1),4) AS static_ok, concat_ws('; ', CASE WHEN dbm>0 THEN 'database' END, CASE WHEN upm>0 THEN 'backend' END,
   CASE WHEN sok/greatest(sall,1)>0.9 AND x5>0 THEN 'static fine, dynamic failed' END, CASE WHEN qn<0.3*qbn THEN 'traffic dropped' END) AS cause
  FROM ss WHERE (hp OR (b-a+1>=10 AND x5+x499>=20)) AND (pb-pa+1>=2 OR x5+x499>=20))"""

_BURSTS = OUTAGES + """,
bm AS (SELECT minute, n, bn AS norm, n >= greatest(3*bn, bn+5) AS hit FROM o4),
bf AS (SELECT minute, CASE WHEN minute - lag(minute) OVER (ORDER BY minute) <= 10 THEN 0 ELSE 1 END AS new FROM bm WHERE hit),
bi AS (SELECT min(minute) AS a, max(minute) AS b FROM (SELECT minute, sum(new) OVER (ORDER BY minute) AS k FROM bf) GROUP BY k),
bt AS (SELECT a, b, sum(n) AS requests, max(n) AS mx, sum(n-norm) AS excess, avg(norm) AS un FROM bi JOIN bm ON minute BETWEEN a AND b GROUP BY a, b HAVING sum(n-norm) >= 20),
bx AS (SELECT a, b, rg.* FROM bt JOIN rg ON rg.ts // 60 BETWEEN a AND b),
b1 AS (SELECT a, count(*) AS ips, arg_max(ip, (n, ip)) AS top_ip, max(n) AS top_n FROM (SELECT a, ip, count(*) AS n FROM bx GROUP BY 1,2) GROUP BY a),
b2 AS (SELECT a, arg_max(fam, (n, fam)) AS top_robot, max(n) AS fam_n FROM (SELECT a, fam, count(*) AS n FROM bx WHERE fam<>'' GROUP BY 1,2) GROUP BY a),
b3 AS (SELECT a, count_if("group"='people') AS pr FROM bx GROUP BY a),
b4 AS (SELECT a, count(DISTINCT minute) AS om FROM bt JOIN bm ON minute BETWEEN a AND b JOIN outages ON minute BETWEEN degraded_from // 60 AND degraded_to // 60 GROUP BY a)
SELECT a AS first_minute, b AS last_minute, CAST(requests AS BIGINT) AS requests, mx AS max_per_minute, CAST(excess AS DOUBLE) AS excess, round(un,4) AS usual_per_minute, ips, top_ip,
  round(top_n/requests,4) AS top_ip_share, coalesce(top_robot,'') AS top_robot, pr AS people_requests,
  CASE WHEN top_n/requests>=0.5 THEN 'single ip' WHEN coalesce(fam_n,0)/requests>=0.5 THEN 'robot' WHEN pr/requests>=0.6 THEN 'people' WHEN ips>=50 AND top_n/requests<0.1 THEN 'distributed' ELSE 'mixed' END AS picture,
  coalesce(om,0) AS outage_minutes FROM bt JOIN b1 USING (a) LEFT JOIN b2 USING (a) JOIN b3 USING (a) LEFT JOIN b4 USING (a)"""


def _levels(minimum, deepest=8):
    """Template collapse unrolled level by level."""
    ctes, cur = [], "t1"
    for d in range(2, deepest + 1):
        nxt = f"t{d}"
        ctes.append(f"""{nxt}w AS (SELECT seg[1:{d}] AS par FROM {cur} WHERE good AND len(seg)>{d} AND seg[{d + 1}] NOT IN ('','*') GROUP BY 1 HAVING count(DISTINCT seg[{d + 1}])>={minimum}),
          {nxt} AS (SELECT base, good, CASE WHEN len(seg)>{d} AND seg[1:{d}] IN (SELECT par FROM {nxt}w) AND seg[{d + 1}] NOT IN ('','*') AND NOT regexp_matches(seg[{d + 1}], '\\.(php|html?|aspx?|jsp)$')
            THEN seg[1:{d}] || ['*'] || seg[{d + 2}:] ELSE seg END AS seg FROM {cur})""")
        cur = nxt
    return ",".join(ctes), cur


_ctes, _last = _levels(5)
_TEMPLATES = f""", good AS (SELECT base FROM rg WHERE method='GET' AND NOT is_static AND ua_browser AND status=200 GROUP BY base HAVING count(DISTINCT ip)>=2),
  t1 AS (SELECT DISTINCT base, base IN (SELECT base FROM good) AS good, [{SEGMENT} FOR s IN string_split(base,'/')] AS seg FROM rg),
  {_ctes} SELECT base, array_to_string(seg, '/') AS tpl FROM {_last}"""

SQL = {
    "s01_read_lines": sql("requests", "SELECT method<>'GET' AS packed, count(*) AS lines, CAST(sum(bytes) AS BIGINT) AS bytes, min(ts) AS first_ts, max(ts) AS last_ts, CAST(0 AS BIGINT) AS misnumbered FROM requests GROUP BY 1"),
    "s02_parse_access": sql("requests", "SELECT req_id, ts, ip, vhost, method, base, query, status, bytes, ref, ua FROM requests"),
    "s03_parse_error": plain_counts(f"WITH {ERROR_LINES} SELECT line_no, ts, level, msg, client, request, host FROM el"),
    "s04_sniff": "SELECT 'site.ru-access.log' AS src, 'access:combined' AS kind UNION ALL SELECT 'site.ru-error.log', 'error:nginx'",
    "s05_file_inventory": sql("requests", """, x AS (SELECT req_id % 3 AS k, ts, true AS good FROM requests UNION ALL SELECT event_id % 3, NULL, false FROM events WHERE event_type='error')
        SELECT concat('part-', CAST(k AS VARCHAR)) AS src, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts, '+0300' AS tz_offset, count_if(NOT good) AS unparsed FROM x GROUP BY k"""),
    "s06_hour_gaps": sql("requests", """, h AS (SELECT DISTINCT vhost, ts // 3600 AS hour_no FROM requests), b AS (SELECT vhost, min(hour_no) AS a, max(hour_no) AS z FROM h GROUP BY 1),
        g AS (SELECT vhost, unnest(range(a, z + 1)) AS hour_no FROM b) SELECT g.vhost, g.hour_no FROM g ANTI JOIN h ON h.vhost=g.vhost AND h.hour_no=g.hour_no"""),
    "s07_drop_overlaps": sql("requests", _FILES + """ SELECT src, count(*) AS lines, CAST(sum(bytes) AS BIGINT) AS bytes FROM two t
        WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.dup AND dd.src=t.src AND dd.minute=t.ts // 60) GROUP BY src"""),
    "s07_overlap_report": sql("requests", _FILES + """ SELECT src, count_if(dup) AS minutes_duplicate, count_if(NOT dup) AS minutes_partial,
        CAST(coalesce(sum(n) FILTER (WHERE dup),0) AS BIGINT) AS lines_duplicate FROM dd GROUP BY src"""),
    "s08_site_hosts": sql("requests", _FILES + " SELECT 'site.ru' AS host, count(*) AS n, 'file name' AS \"by\" FROM two"),
    "s08_site_by_referrer": sql("features", "SELECT ref_host AS host, count(*) AS n FROM rf WHERE ref_host<>'' GROUP BY 1 ORDER BY n DESC, host LIMIT 5"),
    "p06_path_templates": sql("grouped", _TEMPLATES),
    "w07_episodes": sql("requests", """, m AS (SELECT DISTINCT vhost, ts // 60 AS minute FROM requests),
        f AS (SELECT *, CASE WHEN minute - lag(minute) OVER (PARTITION BY vhost ORDER BY minute) <= 3 THEN 0 ELSE 1 END AS new FROM m),
        k AS (SELECT *, CAST(sum(new) OVER (PARTITION BY vhost ORDER BY minute) AS BIGINT) AS episode FROM f)
        SELECT vhost, episode, min(minute) AS first_minute, max(minute) AS last_minute, count(*) AS minutes FROM k GROUP BY vhost, episode"""),
    "w08_minute_norm": sql("requests", _GRID + " SELECT minute, n, hod, norm FROM mn"),
    "w09_outages": sql("grouped", OUTAGES + " SELECT * FROM outages"),
    "w10_bursts": sql("grouped", _BURSTS),
    "w12_waves": sql("grouped", """, d AS (SELECT DISTINCT ip, status, day FROM rg WHERE status>=400),
        r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY ip, status ORDER BY day) AS INT) AS k FROM d)
        SELECT ip, status, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM r GROUP BY ip, status, k"""),
    "w13_status_changes": sql("grouped", """, c AS (SELECT tpl, day, CASE WHEN status>=500 THEN '5xx' WHEN status=404 THEN '404' WHEN status<400 THEN 'OK' ELSE '4xx' END AS cls, count(*) AS n
          FROM rg WHERE (is_page OR method='POST') AND "group"='people' GROUP BY ALL),
        d AS (SELECT tpl, day, arg_max(cls, (n, -CASE cls WHEN '404' THEN 0 WHEN '4xx' THEN 1 WHEN '5xx' THEN 2 ELSE 3 END)) AS now, sum(n) AS n FROM c GROUP BY 1,2),
        e AS (SELECT *, sum(n) OVER (PARTITION BY tpl) AS total, lag(now) OVER (PARTITION BY tpl ORDER BY day) AS was FROM d)
        SELECT tpl, day, was, now FROM e WHERE total>=50 AND was<>now"""),
    "w14_rhythm": sql("requests", """, g AS (SELECT ip, ua, base, ts - lag(ts) OVER (PARTITION BY ip, ua, base ORDER BY ts, req_id) AS gap FROM requests)
        SELECT ip, ua, base, count(*) AS hits, count(gap) AS gaps, median(gap) AS median_gap, round(stddev_pop(gap)/(avg(gap)+1e-9),6) AS cv FROM g GROUP BY ip, ua, base
        HAVING count(*)>=10 AND count(gap)>5 AND median(gap)>20 AND round(stddev_pop(gap)/(avg(gap)+1e-9),6)<2.0"""),
    "w20_day_span": sql("features", """SELECT day, min(ts) AS first_ts, max(ts) AS last_ts, min(ts) % 86400 // 60 <= 5 AND max(ts) % 86400 // 60 >= 1435 AS is_full FROM rf GROUP BY day"""),
    "w21_burst": sql("requests", """, b AS (SELECT ip, ua, count(*) OVER (PARTITION BY ip, ua ORDER BY ts RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING) AS n FROM requests)
        SELECT ip, ua, max(n) AS burst FROM b GROUP BY ip, ua HAVING max(n)>=4"""),
}
