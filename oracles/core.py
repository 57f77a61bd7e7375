"""Check queries for requests, user agents, networks, visits and the overview."""

from oracles.prelude import IP_DIM, REQUESTS, UA, sql
from weblens.functions import fixed_values as fv

_groups = fv.GROUPS
_daily = ", ".join(
    [f"count(*) FILTER (WHERE \"group\"='{g}') AS visits_{g}, count(DISTINCT ip) FILTER (WHERE \"group\"='{g}') AS ips_{g}" for g in _groups]
    + [f"CAST(coalesce(sum(n_goal) FILTER (WHERE \"group\"='{g}'),0) AS BIGINT) AS leads_{g}" for g in ("people", "bots", "own")])

SQL = {
    "p01_p02_p05_request_features": sql("features", """SELECT req_id, ext, is_static, ref_host, ref_internal, ref_path, host_site, day, hour,
        regexp_extract(base, '^(/[^/?]*/?)', 1) AS section FROM rf"""),
    "p03_p04_user_agents": f"WITH {REQUESTS},{UA} SELECT ua, fam, fam_cat, ua_browser, ua_old, ua_mobile, ua_webview FROM ua_dim",
    "p17_j01_ip_networks": f"WITH {REQUESTS},{IP_DIM} SELECT ip, asn, org, cc, nettype, net_first, net_last FROM ip_dim",
    "p18_impossible_ua": f"""WITH {REQUESTS} SELECT ua, regexp_matches(ua, 'Windows 9[58]|Win 9x|Windows NT 4\\.0')
        OR coalesce(TRY_CAST(nullif(regexp_extract(ua, '(?:iPhone|CPU) OS (\\d+)_', 1),'') AS INT) < 7, false)
        OR coalesce(TRY_CAST(nullif(regexp_extract(ua, 'Gecko/(20\\d\\d)\\d\\d\\d\\d\\b', 1),'') AS INT) > 2024, false) AS impossible
        FROM (SELECT DISTINCT ua FROM requests)""",
    "w01_sessionize": sql("sessions", "SELECT req_id, vid FROM rq"),
    "w02_w03_page_flags": sql("sessions", "SELECT req_id, is_dup, is_redirect_hop, is_page FROM rq"),
    "w05_p13_visits": sql("base", """SELECT vid, ip, ua, host_site, "start", "end", n_req, n_pages, n_pages_raw, n_dup, n_redirect, n_static, bytes, n_post, n_head,
        n_err4, n_err5, n_goal, n_conv, dur, entry, entry_query, entry_status, entry_ref, entry_ref_host, entry_ref_internal, channel, channel_sub, day, hour, weekday FROM vs"""),
    "w06_returning": sql("visits", """, f AS (SELECT ip, "start" > min("start") OVER (PARTITION BY ip) AS is_returning FROM vs)
        SELECT is_returning, count(*) AS visits, count(DISTINCT ip) AS ips FROM f GROUP BY 1"""),
    "r01_r02_groups": sql("base", 'SELECT vid, "group", subgroup, fam_verified, nettype FROM vs'),
    "j02_net_operator": f"""WITH {REQUESTS},{IP_DIM} SELECT ip, CASE WHEN ip LIKE '10.2.0.%' AND CAST(split_part(ip,'.',4) AS INT) < 64 THEN 'office'
        WHEN ip LIKE '10.2.%' THEN 'regional' WHEN asn=24940 THEN 'hoster' WHEN asn=8359 THEN 'mobile' ELSE '' END AS operator FROM ip_dim""",
    "j03_verify_robots": sql("visits", """, x AS (SELECT *, CASE WHEN fam='Googlebot' THEN CASE WHEN ip LIKE '10.0.0.%' OR (ip LIKE '10.4.0.%' AND CAST(split_part(ip,'.',4) AS INT) < 128) THEN 'yes' ELSE 'no' END
          WHEN fam='YandexBot' THEN CASE WHEN ip LIKE '10.1.%' THEN 'yes' ELSE 'no' END ELSE fam_verified END AS fv FROM vs WHERE fam<>''),
        y AS (SELECT fam, fv, CASE WHEN fv='no' AND "group" IN ('robots','people') THEN 'bots' ELSE "group" END AS g,
          CASE WHEN fv='no' AND "group" IN ('robots','people') THEN 'fake robots' ELSE subgroup END AS s FROM x)
        SELECT fam, fv AS fam_verified, g AS "group", s AS subgroup, count(*) AS visits FROM y GROUP BY 1,2,3,4"""),
    "j04_requests_by_group": sql("grouped", 'SELECT "group", subgroup, channel, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM rg GROUP BY 1,2,3'),
    "a01_group_totals": sql("visits", """SELECT "group", subgroup, count(*) AS visits, count(DISTINCT ip) AS ips, CAST(sum(n_req) AS BIGINT) AS requests,
        CAST(sum(bytes) AS BIGINT) AS bytes FROM vs GROUP BY 1,2"""),
    "a02_daily_activity": sql("visits", f"SELECT day, {_daily} FROM vs GROUP BY GROUPING SETS ((day), ())"),
    "a03_channels": sql("visits", """SELECT channel, count(*) AS visits, count(DISTINCT ip) AS ips, CAST(sum(n_goal) AS BIGINT) AS leads,
        round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(n_goal)/count(*),6) AS conversion FROM vs WHERE "group"='people' GROUP BY channel"""),
}
