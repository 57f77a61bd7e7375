"""Check queries of the book of rules: one plain statement a rule, sequences as self-joins."""

from oracles.prelude import in_list, lit, sql
from weblens.plans.queries_signatures import ADMIN, CARD, ENTRY, FORMS, LISTS
from weblens.rules import rule_book

_SEEN = """, miss AS (SELECT base AS path, ts, req_id, ip FROM rg WHERE method='GET' AND status=404 AND fam='' AND NOT is_static),
lastm AS (SELECT r.req_id, r.ip, r.ts, arg_max(struct_pack(t := miss.ts, who := miss.ip), (miss.ts, miss.req_id)) AS m FROM rg r JOIN miss ON miss.path=r.ref_path AND (miss.ts, miss.req_id) < (r.ts, r.req_id)
  WHERE r.ref_internal AND r.ref_path<>'' GROUP BY 1,2,3),
seen AS (SELECT req_id, ts-m.t AS seen FROM lastm WHERE m.who<>ip)"""
_ROWS = _SEEN + f""", rr AS (SELECT rg.*, seen, regexp_matches(base,{lit(FORMS)}) AND method='POST' AS fp, regexp_matches(base,{lit(FORMS)}) AND method='GET' AS fg, nullif(regexp_extract(query,'yclid=([0-9]+)',1),'') AS yclid, regexp_matches(base,{lit(CARD)}) AS card,
  regexp_matches(ua,'Windows NT|Macintosh|X11') AND NOT contains(ua,'Mobile') AS desk, CASE WHEN query='' THEN base ELSE concat(base,'?',query) END AS path FROM rg LEFT JOIN seen USING (req_id)),
pn AS (SELECT *, coalesce(sum(CAST(is_page AS INT)) OVER (PARTITION BY vid ORDER BY ts, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pno FROM rr),
fb AS (SELECT *, count(*) OVER (PARTITION BY vid ORDER BY ts RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS k FROM rr WHERE fp), pb AS (SELECT *, count(*) OVER (PARTITION BY vid ORDER BY ts RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS k FROM rr WHERE is_page),
staffed AS (SELECT DISTINCT vid FROM rr WHERE regexp_matches(base,{lit(ADMIN)})), formed AS (SELECT DISTINCT vid FROM rr WHERE fp), paged AS (SELECT DISTINCT vid FROM rr WHERE is_page),
d1 AS (SELECT DISTINCT b.vid, b.ts, b.req_id, b.pno + CAST(b.is_page AS INT) AS nx FROM pn a JOIN pn b ON a.vid=b.vid AND (b.ts,b.req_id)>(a.ts,a.req_id) AND b.ts-a.ts<=900
  WHERE a.is_page AND a.pno=0 AND a.method='GET' AND a.status=404 AND a.ref='-' AND regexp_matches(a.base,{lit(ENTRY)}) AND b.method='GET' AND b.base='/' AND b.status=200),
d2 AS (SELECT DISTINCT c.vid FROM d1 JOIN pn c ON c.vid=d1.vid AND (c.ts,c.req_id)>(d1.ts,d1.req_id) AND c.ts-d1.ts<=300 AND c.pno-d1.nx<=4 WHERE c.fp),
w1 AS (SELECT DISTINCT b.vid FROM pn a JOIN pn b ON a.vid=b.vid AND (b.ts,b.req_id)>(a.ts,a.req_id) AND b.ts-a.ts<=900 AND b.pno-a.pno-1<=4 WHERE a.is_page AND a.pno=0 AND a.ref_internal AND a.seen<=1800 AND regexp_matches(a.ref_path,{lit(ENTRY)}) AND b.fp),
s1 AS (SELECT vid FROM pn WHERE is_page AND pno=0 AND ref='-' AND desk AND yclid IS NULL AND status NOT IN (500,502,503,504) AND fam='')"""
_cols = 'count(*) AS requests, min(ts) AS "start", max(ts) AS "end"'
_clean = "vid NOT IN (SELECT vid FROM staffed)"


def _session(name: str, cond: str, having: str = "") -> str:
    return f"SELECT '{name}' AS sig, any_value(ip) AS key, any_value(ip) AS ip, {_cols} FROM rr WHERE {cond} GROUP BY vid {having}"


def _request(name: str, cond: str) -> str:
    return f"SELECT '{name}', ip, ip, {_cols} FROM rr WHERE {cond} GROUP BY ip, day"


_HITS = _ROWS + ", hits AS (" + " UNION ALL ".join([
    _session("spam_dead_entry", f"{_clean} AND vid IN (SELECT vid FROM d2)"), _session("spam_ip_switch", f"{_clean} AND vid IN (SELECT vid FROM w1)"),
    _session("form_without_pages", f"{_clean} AND vid IN (SELECT vid FROM formed) AND vid NOT IN (SELECT vid FROM paged)"),
    _session("fast_pages_and_forms", f"{_clean} AND vid IN (SELECT vid FROM fb WHERE k>=2) AND vid IN (SELECT vid FROM pb WHERE k>=6)"),
    _session("no_browser", "fam='' AND vid IN (SELECT vid FROM s1)", "HAVING count_if(is_page)>=1 AND count_if(is_static)=0 AND count_if(fg)=0"),
    f"SELECT 'form_agents', ip, ip, {_cols} FROM rr WHERE fp GROUP BY ip, day HAVING count(DISTINCT ua)>=3",
    f"SELECT 'probing', ip, ip, {_cols} FROM rr WHERE regexp_matches(base,{lit(rule_book.PROBED)}) GROUP BY ip, day, hour HAVING count(DISTINCT base)>=3",
    f"SELECT 'robot_rotation', ip, ip, {_cols} FROM rr WHERE fam<>'' AND (asn IS NULL OR asn NOT IN (13238,15169,8075,714)) GROUP BY ip, day HAVING count(DISTINCT fam)>=4",
    f"SELECT 'ad_clicks', concat(ip,'|',ua), ip, {_cols} FROM rr WHERE fam='' GROUP BY ip, ua, day HAVING count(DISTINCT yclid)>=8 AND count_if(card)=0",
    _request("removed_handlers", f"method='POST' AND status=404 AND base IN {in_list(LISTS['removed_handlers'])}"), _request("known_spam_ip", f"fp AND ip IN {in_list(LISTS['spam_ips'])}"),
    _request("scouting", f"method='GET' AND status=404 AND ref='-' AND base IN {in_list(LISTS['rare_entries'])}"), _request("tel_as_page", f"regexp_matches(path,{lit(rule_book.TEL_LINK)})"),
    _request("false_robot", "fam_verified='no'"), _request("headless", f"regexp_matches(ua,{lit(rule_book.HEADLESS)})")]) + ")"

_RANK = "CASE sig " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rule_book.SEVERITY.items()) + " END"

SQL = {
    "r25_rule_book": sql("grouped", _HITS + " SELECT * FROM hits"),
    "r25_rule_book_ips": sql("grouped", _HITS + f" SELECT ip, max({_RANK}) AS max_rank, count(DISTINCT sig) AS signatures, count(*) AS hits FROM hits GROUP BY ip"),
    "r25_seen_404": sql("grouped", _SEEN + " SELECT req_id, seen AS ref_seen_404_other_ip FROM seen"),
}
