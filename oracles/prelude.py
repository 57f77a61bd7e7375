"""Common table expressions shared by the DuckDB check queries.

Written independently of the Spark operators: sessions are built with one
window per client instead of time slots, lookups are plain SQL joins.
"""

from weblens.functions import fixed_values as fv
from weblens.operators.goals import FORM_HINT, FORM_NAME, RULE_200, RULE_3XX
from weblens.sources.event_log import CONDITION, ERROR_LINE, SELECT_LIST, STEPS, T0


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + ")"


def case_rx(subject: str, rules, default: str) -> str:
    """Ordered regex rules -> CASE."""
    whens = " ".join(f"WHEN regexp_matches({subject}, {lit(p)}) THEN {v}" for p, v in rules)
    return f"CASE {whens} ELSE {default} END"


SITE_HOSTS = ["site.ru"]

_steps = ", ".join(f"({s},{d})" for s, d in STEPS)
REQUESTS = f"""
ev AS (SELECT event_id AS e, user_id AS u, event_type AS t, CAST(floor(value) AS BIGINT) AS v, {T0} AS t0 FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t_raw FROM events)),
st AS (SELECT * FROM (VALUES {_steps}) AS x(step, dt)),
requests AS (SELECT {SELECT_LIST} FROM ev CROSS JOIN st WHERE {CONDITION})"""

UA = f"""
ua_fam AS (SELECT ua, CASE WHEN regexp_matches(ua, {lit(fv.HUMAN_APP)}) AND NOT contains(lower(ua), 'bot') THEN 0 ELSE
  {case_rx("ua", [(p, i + 1) for i, (p, _, _) in enumerate(fv.ROBOT_FAMILIES)], "0")} END AS fam_no
  FROM (SELECT DISTINCT ua FROM requests)),
fams AS (SELECT * FROM (VALUES (0,'',''), {", ".join(f"({i + 1},{lit(f)},{lit(c)})" for i, (_, f, c) in enumerate(fv.ROBOT_FAMILIES))}) AS x(fam_no, fam, fam_cat)),
ua_dim AS (SELECT ua, fam, fam_cat,
  regexp_matches(ua, {lit(fv.UA_BROWSER)}) AND NOT regexp_matches(ua, {lit(fv.UA_NOT_BROWSER)}) AND NOT regexp_matches(ua, {lit(fv.UA_OLD)}) AND fam='' AS ua_browser,
  regexp_matches(ua, {lit(fv.UA_OLD)}) AS ua_old, regexp_matches(ua, {lit(fv.UA_MOBILE)}) AS ua_mobile, regexp_matches(ua, {lit(fv.UA_WEBVIEW)}) AS ua_webview
  FROM ua_fam JOIN fams USING (fam_no))"""

_static = in_list(fv.STATIC_EXTENSIONS)
FEATURES = f"""
rf0 AS (SELECT *, lower(regexp_extract(base, '\\.([A-Za-z0-9]{{1,5}})$', 1)) AS ext,
  regexp_replace(lower(regexp_extract(ref, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS ref_host,
  split_part(regexp_replace(ref, '^https?://[^/]+', ''), '?', 1) AS rp FROM requests),
rf AS (SELECT r.*, ext IN {_static} AS is_static,
  {" OR ".join(f"ref_host={lit(h)} OR ends_with(ref_host, {lit('.' + h)})" for h in SITE_HOSTS)} AS ref_internal,
  CASE WHEN ref_internal THEN rp ELSE '' END AS ref_path,
  {" OR ".join(f"vhost={lit(h)} OR ends_with(vhost, {lit('.' + h)})" for h in SITE_HOSTS)} AS host_site,
  DATE '1970-01-01' + CAST(ts // 86400 AS INT) AS day, CAST(ts // 3600 % 24 AS INT) AS hour,
  method IN ('GET','HEAD') AND NOT (ext IN {_static}) AS page_raw
  FROM rf0 r)"""

SEGMENT = """CASE WHEN regexp_full_match(s,'\\d+|[0-9a-fA-F]{16,}|[0-9a-fA-F-]{32,36}') THEN '*' WHEN regexp_full_match(s,'[A-Za-z_-]{1,8}\\d+[A-Za-z]?') THEN regexp_replace(s,'\\d+[A-Za-z]?$','*') ELSE s END"""
TPL = f"array_to_string([{SEGMENT} FOR s IN string_split(base,'/')], '/')"

GOALS = f"""
gp AS (SELECT rf.*, concat({TPL}, CASE WHEN regexp_matches(query, {lit(FORM_NAME)}) THEN concat('?form=', regexp_extract(query, {lit(FORM_NAME)}, 1)) ELSE '' END) AS gkey FROM rf WHERE method='POST' AND ref_internal),
gg AS (SELECT gkey, count(*) AS posts, count(DISTINCT ip) AS ips, count_if(status BETWEEN 200 AND 399)/count(*) AS oks, count_if(status IN (302,303)) AS r3, count_if(status IN (301,308))/count(*) AS r301, min(ts) AS first_ts, max(ts) AS last_ts
  FROM gp JOIN ua_dim USING (ua) WHERE ua_browser GROUP BY gkey HAVING count(*)>=3),
goals AS (SELECT gkey, posts, ips, first_ts, last_ts, CASE WHEN oks<0.5 THEN 'no goal: does not accept POST' WHEN r301>=0.5 THEN 'no goal: redirected (301)'
  WHEN r3>=greatest(2,0.1*posts) AND (regexp_matches(gkey,{lit(FORM_HINT)}) OR (ends_with(gkey,'.php') AND r3>=0.3*posts AND ips>=5)) THEN {lit(RULE_3XX)}
  WHEN regexp_matches(gkey,{lit(FORM_HINT)}) THEN {lit(RULE_200)} ELSE 'no goal: background address' END AS rule FROM gg),
gr_ AS (SELECT gp.req_id AS grid, gp.gkey AS goal, CASE WHEN rule={lit(RULE_3XX)} THEN status IN (302,303) ELSE status=200 END AS goal_success FROM gp JOIN goals USING (gkey) WHERE rule LIKE 'goal%' AND host_site)"""

SESSIONS = """
se0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ip, ua, host_site ORDER BY ts, req_id) <= 1800 THEN 0 ELSE 1 END AS is_new FROM rf),
se1 AS (SELECT *, sum(is_new) OVER (PARTITION BY ip, ua, host_site ORDER BY ts, req_id) AS visit_no FROM se0),
se AS (SELECT *, min(ts) OVER (PARTITION BY ip, ua, host_site, visit_no) AS vstart FROM se1),
pg AS (SELECT req_id AS rid, ts - lag(ts) OVER w <= 5 AND lag(base) OVER w = base AND lag(query) OVER w = query AS dup,
  status IN (301,302,303,307,308) AND lead(ts) OVER w - ts <= 3 AS red
  FROM se WHERE page_raw WINDOW w AS (PARTITION BY ip, ua, host_site, visit_no ORDER BY ts, req_id)),
rq AS (SELECT se.* EXCLUDE (is_new, visit_no, rp), md5(concat_ws('|', ip, ua, CASE WHEN host_site THEN 'true' ELSE 'false' END, CAST(vstart AS VARCHAR))) AS vid,
  page_raw AND coalesce(dup, false) AS is_dup, page_raw AND coalesce(red, false) AS is_redirect_hop,
  page_raw AND NOT coalesce(dup, false) AND NOT coalesce(red, false) AS is_page, coalesce(goal,'') AS goal, coalesce(goal_success,false) AS goal_success
  FROM se LEFT JOIN pg ON se.req_id = pg.rid LEFT JOIN gr_ ON se.req_id = gr_.grid)"""

_hi = lambda c: f"coalesce({c}, 0)"
VISITS0 = """
vf AS (SELECT vid, ip, ua, host_site, min(ts) AS "start", max(ts) AS "end", count(*) AS n_req, count_if(is_page) AS n_pages,
  count_if(is_page)+count_if(is_dup)+count_if(is_redirect_hop) AS n_pages_raw, count_if(is_dup) AS n_dup, count_if(is_redirect_hop) AS n_redirect,
  count_if(is_static) AS n_static, CAST(sum(bytes) AS BIGINT) AS bytes, count_if(method='POST') AS n_post, count_if(method='HEAD') AS n_head,
  count_if(status BETWEEN 400 AND 499) AS n_err4, count_if(status>=500) AS n_err5, count_if(goal<>'') AS n_goal, count_if(goal_success) AS n_conv, max(ts)-min(ts) AS dur,
  min(ts*1000000000+req_id) AS first_any, min(ts*1000000000+req_id) FILTER (WHERE is_page) AS first_page
  FROM rq GROUP BY vid, ip, ua, host_site),
ve AS (SELECT vf.*, r.base AS entry, r.query AS entry_query, r.status AS entry_status, r.ref AS entry_ref, r.ref_host AS entry_ref_host, r.ref_internal AS entry_ref_internal
  FROM vf JOIN rq r ON r.vid = vf.vid AND r.ts*1000000000+r.req_id = coalesce(first_page, first_any))"""


def channel_sql(h, internal, q, ref):
    rx = lambda p: f"regexp_matches({q}, {lit(p)})"
    hx = lambda p: f"regexp_matches({h}, {lit(p)})"
    pairs = [
        (f"contains({q},'yclid=') OR {rx('utm_source=(yandex|yd|ya|direct)')}", lit(fv.CH_ADS), lit("Yandex Direct")),
        (f"contains({q},'gclid=') OR contains({q},'gbraid=') OR contains({q},'wbraid=') OR (contains({q},'utm_source=google') AND contains({q},'cpc'))", lit(fv.CH_ADS), lit("Google Ads")),
        (f"contains({q},'rb_clickid=') OR contains({q},'vkclid=') OR {rx('utm_source=(vk|mytarget|vkads)')}", lit(fv.CH_ADS), lit("VK Ads")),
        (f"{rx('utm_source=(tg|telegram)')} AND contains({q},'cpc')", lit(fv.CH_ADS), lit("Telegram Ads")),
        (f"contains({q},'utm_source=chatgpt.com')", lit(fv.CH_AI), lit("ChatGPT")),
        (rx("utm_medium=(e-?mail|newsletter|rassylka)"), lit(fv.CH_MAIL), "''"),
        (rx("utm_medium=(cpc|cpm|cpa|paid|ppc)"), lit(fv.CH_ADS), lit("other systems")),
        (internal, lit(fv.CH_INTERNAL), "''"),
        (hx(fv.REF_AI), lit(fv.CH_AI), h),
        (f"{hx(fv.REF_MAPS)} OR (contains({ref},'/maps') AND (contains({h},'yandex.') OR contains({h},'google.')))", lit(fv.CH_MAPS), h),
        (hx(fv.REF_SEARCH), lit(fv.CH_SEARCH), f"CASE WHEN contains({h},'yandex') OR {h}='ya.ru' THEN 'Yandex' WHEN contains({h},'google') THEN 'Google' ELSE {h} END"),
        (hx(fv.REF_SOCIAL), lit(fv.CH_SOCIAL), h),
        (hx(fv.REF_AGGREGATOR), lit(fv.CH_AGGREGATOR), h),
        (f"contains({q},'utm_')", lit(fv.CH_LABELS), f"regexp_extract({q},'utm_source=([^&]*)',1)"),
        (f"{h}=''", lit(fv.CH_DIRECT), "''"),
    ]
    name = "CASE " + " ".join(f"WHEN {c} THEN {n}" for c, n, _ in pairs) + f" ELSE {lit(fv.CH_LINKS)} END"
    sub = "CASE " + " ".join(f"WHEN {c} THEN {s}" for c, _, s in pairs) + f" ELSE {h} END"
    return name, sub


RANGES = """
ip_ranges AS (SELECT * FROM (VALUES
  (167772160,167837695,13238,'YANDEX LLC','RU'), (167837696,167903231,15169,'Google LLC','US'), (167903232,167968767,8359,'MTS PJSC','RU'),
  (167968768,168034303,24940,'Hetzner Online GmbH','DE'), (168034304,168034403,15169,'Google LLC','US'), (168034404,168034450,13238,'YANDEX LLC','RU')) AS x(range_start, range_end, asn, org, cc))"""

IP_DIM = f"""{RANGES},
ip_dim AS (SELECT i.ip, coalesce(r.asn,0) AS asn, coalesce(r.org,'') AS org, coalesce(r.cc,'') AS cc, coalesce(r.range_start,-1) AS net_first, coalesce(r.range_end,-1) AS net_last,
  CASE WHEN coalesce(r.asn,0)=0 THEN {lit(fv.NET_UNKNOWN)} WHEN r.asn IN {in_list(fv.RELAY_ASN)} THEN {lit(fv.NET_RELAY)} WHEN r.asn IN {in_list(fv.MOBILE_ASN)} THEN {lit(fv.NET_MOBILE)}
   WHEN regexp_matches(r.org, {lit(fv.BANK_ORG)}) THEN {lit(fv.NET_BANK)} WHEN r.asn={fv.YANDEX_ASN} THEN {lit(fv.NET_YANDEX)}
   WHEN r.asn IN {in_list(fv.CLOUD_ASN)} OR regexp_matches(r.org, {lit(fv.HOSTING_ORG)}) THEN CASE WHEN r.org<>'' THEN concat({lit(fv.NET_DC + ' (')}, r.org, ')') ELSE {lit(fv.NET_DC)} END
   WHEN r.cc='RU' THEN {lit(fv.NET_RU)} ELSE {lit(fv.NET_FOREIGN)} END AS nettype
  FROM (SELECT DISTINCT ip, CAST(split_part(ip,'.',1) AS BIGINT)*16777216+CAST(split_part(ip,'.',2) AS BIGINT)*65536+CAST(split_part(ip,'.',3) AS BIGINT)*256+CAST(split_part(ip,'.',4) AS BIGINT) AS num FROM requests) i
  LEFT JOIN ip_ranges r ON i.num BETWEEN r.range_start AND r.range_end)"""

_ch, _sub = channel_sql("entry_ref_host", "entry_ref_internal", "lower(entry_query)", "entry_ref")
_ver = "CASE fam " + " ".join(f"WHEN {lit(f)} THEN CASE WHEN asn IN {in_list(a)} THEN 'yes' ELSE 'no' END" for f, a in fv.FAMILY_ASNS) + " ELSE '' END"

# monitors are named by user agent only when they ask few addresses; no analyst-supplied staff here
_mon = "CASE " + " ".join(f"WHEN regexp_matches(ua, {lit('(?i)' + p)}) THEN {lit(n)}" for n, p in fv.MONITOR_SERVICES) + " END"
VISITS = f"""
vd AS (SELECT ve.*, {_ch} AS channel, {_sub} AS channel_sub, DATE '1970-01-01' + CAST("start" // 86400 AS INT) AS day,
  CAST("start" // 3600 % 24 AS INT) AS hour, CAST(("start" // 86400 + 3) % 7 AS INT) AS weekday,
  fam, fam_cat, ua_browser, ua_old, ua_mobile, ua_webview, asn, org, cc, nettype, {_ver} AS fam_verified
  FROM ve JOIN ua_dim USING (ua) JOIN ip_dim USING (ip)),
vg AS (SELECT *, CASE WHEN fam<>'' AND fam_verified='no' THEN 'bots' WHEN fam<>'' THEN 'robots' WHEN NOT ua_browser OR n_head=n_req THEN 'bots'
   WHEN n_static=0 AND n_pages>=1 THEN 'bots' ELSE 'people' END AS grp,
  CASE WHEN fam<>'' AND fam_verified='no' THEN 'fake robots' WHEN fam<>'' AND fam_cat NOT IN ({lit(fv.SCRIPT)},{lit(fv.OTHER_BOTS)}) THEN 'known' WHEN fam<>'' THEN 'unknown'
   WHEN NOT ua_browser OR n_head=n_req THEN 'explicit (not a browser)' WHEN n_static=0 AND n_pages>=1 THEN 'masked: loads no resources' ELSE '' END AS sub FROM vd),
na AS (SELECT ip, ua, count(DISTINCT base) AS n_addr FROM rq GROUP BY ip, ua),
vm AS (SELECT vg.*, n_addr, {_mon} AS mon_name, (fam<>'' AND fam_cat='monitoring') OR {_mon} IS NOT NULL AS by_name FROM vg JOIN na USING (ip, ua)),
vs0 AS (SELECT vm.* EXCLUDE (grp, sub, mon_name, by_name, n_addr, first_any, first_page),
  CASE WHEN by_name AND n_addr<=3 THEN 'monitors' WHEN by_name THEN 'bots' WHEN fam='No User-Agent' AND grp='robots' THEN 'bots'
   WHEN fam_cat={lit(fv.SCRIPT)} AND grp='robots' THEN 'utilities' ELSE grp END AS "group",
  CASE WHEN by_name AND n_addr<=3 THEN coalesce(mon_name, ua) WHEN by_name THEN 'poses as monitoring' WHEN fam='No User-Agent' AND grp='robots' THEN 'no user agent'
   WHEN fam_cat={lit(fv.SCRIPT)} AND grp='robots' THEN fam ELSE sub END AS subgroup
  FROM vm)"""

_ATTRIBUTES = 'vs."group", vs.subgroup, vs.channel, vs.fam, vs.fam_cat, vs.fam_verified, vs.ua_browser, vs.asn, vs.cc, vs.nettype'
# visits and requests before the rules
BASE = "vs AS (SELECT * FROM vs0)"
FIELDS = f"""
rg0 AS (SELECT rq.*, {_ATTRIBUTES} FROM rq JOIN vs USING (vid)),
rg AS (SELECT *, {TPL} AS tpl FROM rg0)"""
# the same after the rules: oracles.chain puts its text (which defines vs and demoted) in the mark's place
CHAIN = "/*chain*/"
JUDGED = FIELDS.replace("SELECT rq.*,", "SELECT rq.* REPLACE (rq.goal_success AND rq.req_id NOT IN (SELECT req_id FROM demoted) AS goal_success),")

_visits = [REQUESTS, UA, FEATURES, GOALS, SESSIONS, VISITS0, IP_DIM, VISITS]
# successive stages of the prelude
STAGES = {
    "requests": [REQUESTS],
    "features": [REQUESTS, FEATURES],
    "sessions": [REQUESTS, UA, FEATURES, GOALS, SESSIONS],
    "base": [*_visits, BASE],
    "rules": [*_visits, BASE, FIELDS],
    "visits": [*_visits, CHAIN],
    "grouped": [*_visits, CHAIN, JUDGED],
}


def sql(stage: str, body: str) -> str:
    """A full query: the prelude up to ``stage`` and then ``body`` (may start with more CTEs, ', name AS (...) SELECT')."""
    body = body.strip()
    head = "WITH " + ",".join(STAGES[stage])
    return plain_counts(head + (body if body.startswith(",") else "\n" + body))


def plain_counts(text: str) -> str:
    """count_if(x) -> count(*) FILTER (WHERE x), which is BIGINT like Spark's."""
    while (at := text.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[:at] + "count(*) FILTER (WHERE " + text[at + 9:end - 1] + ")" + text[end:]
    return text


ERROR_LINES = f"""
el0 AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t_raw FROM events WHERE event_type='error'),
el1 AS (SELECT *, {T0} AS t0 FROM el0),
el2 AS (SELECT *, make_timestamp(t0*1000000) AS lt FROM el1),
error_lines AS (SELECT event_id AS line_no, {ERROR_LINE} AS line FROM el2),
el AS (SELECT line_no, CAST(epoch(strptime(line[1:19], '%Y/%m/%d %H:%M:%S')) AS BIGINT) AS ts, regexp_extract(line, '\\[(\\w+)\\]', 1) AS level,
  split_part(regexp_extract(line, '\\d+#\\d+: (?:\\*\\d+ )?(.*)$', 1), ', client:', 1) AS msg, regexp_extract(line, ', client: ([^,"]*)', 1) AS client,
  regexp_extract(line, ', request: "([^",]*)"', 1) AS request, regexp_extract(line, ', host: "([^",]*)"', 1) AS host FROM error_lines)"""
