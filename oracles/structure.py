"""Check queries for pages, facets, inventories, intake and site facts."""

from oracles.errors import registry
from oracles.prelude import ERROR_LINES, TPL, case_rx, in_list, lit, sql
from oracles.rules import _OPER
from oracles.security import _Q, _kind, _link, _mask
from oracles.series import OUTAGES
from weblens.functions import fixed_values as fv
from weblens.marts import structure as T
from weblens.rules import special

_chans = ", ".join([f"count_if(channel={lit(c)}) AS ch_{c.replace(' ', '_')}" for c in T.TOP_CHANNELS] + [f"count_if(channel NOT IN {in_list(T.TOP_CHANNELS)}) AS ch_other"])


def _top(unit, n, having):
    return sql("grouped", registry("rg") + f""", p AS (SELECT *, {unit} AS unit FROM rg WHERE is_page AND "group"='people' AND base NOT IN (SELECT base FROM adr WHERE probe<>'')),
      v AS (SELECT unit, vid, ip, channel, count(*) AS views, count_if(status>=400 AND status<>499) AS errors, count_if(status BETWEEN 200 AND 299) AS ok FROM p GROUP BY ALL),
      t AS (SELECT unit, CAST(sum(views) AS BIGINT) AS views, count(*) AS visits, count(DISTINCT ip) AS ips, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(ok) AS BIGINT) AS ok, {_chans} FROM v GROUP BY unit),
      a AS (SELECT unit, count(DISTINCT base) AS addresses FROM p GROUP BY unit) SELECT t.*, addresses FROM t JOIN a USING (unit) WHERE {having} ORDER BY visits DESC, unit LIMIT {n}""")


# the only facets of this log: brand-is-* in the path, color and size in parameters
_FACETS = """, ok AS (SELECT * FROM rg WHERE is_page AND "group"='people' AND status=200),
fx AS (SELECT '/catalog/' AS section, 'brand-is' AS key, regexp_extract(base,'/brand-is-([^/]+)/',1) AS value, 'Brand' AS condition, 'path' AS origin, ip FROM ok WHERE contains(base,'/brand-is-')
 UNION ALL SELECT '/catalog/', 'color', regexp_extract(query,'(?:^|&)color=([^&]+)',1), 'Color', 'parameters', ip FROM ok WHERE regexp_matches(query,'(?:^|&)color=[^&]')
 UNION ALL SELECT '/catalog/', 'size', regexp_extract(query,'(?:^|&)size=([^&]+)',1), 'Size', 'parameters', ip FROM ok WHERE regexp_matches(query,'(?:^|&)size=[^&]')),
fa AS (SELECT section, key, value, condition, origin, count(*) AS requests, count(DISTINCT ip) AS people FROM fx GROUP BY ALL)"""
_PAIRS = """, qn AS (SELECT query, count(*) AS n, count_if("group"='people') AS people_n, count_if(is_page AND method='GET') AS page_n, count_if("group"='people' AND is_page) AS page_people_n, count_if("group"='people' AND ref_internal) AS inner_n,
 count_if(status>=400) AS error_n, count_if(fam_cat='vulnerability scanner') AS scan_n, count_if("group"='own') AS own_n FROM rg WHERE query<>'' GROUP BY 1),
qx AS (SELECT *, unnest(string_split(query,'&')) AS pair FROM qn), qk AS (SELECT *, lower(trim(url_decode(split_part(pair,'=',1)))) AS key, CASE WHEN contains(pair,'=') THEN substr(pair,strpos(pair,'=')+1) ELSE '' END AS value FROM qx),
qp_ AS (SELECT * FROM qk WHERE regexp_full_match(key,'[\\w\\[\\]\\-.() ;]{1,40}'))"""
_MATCH = "CASE WHEN {k}='utm_source' THEN 'ad source' WHEN {k}='yclid' THEN 'ads and analytics' WHEN {k}='color' THEN 'catalog filter' WHEN starts_with({k},'si') THEN 'sizes' WHEN starts_with({k},'utm_') THEN 'ads and analytics' WHEN starts_with({k},'s') THEN 'anything' END"
_PAT = "CASE WHEN {k}='utm_source' THEN 'utm_source' WHEN {k}='yclid' THEN 'yclid' WHEN {k}='color' THEN 'color' WHEN starts_with({k},'si') THEN 'si*' WHEN starts_with({k},'utm_') THEN 'utm_*' WHEN starts_with({k},'s') THEN 's*' END"
_fam = "CASE WHEN regexp_extract(key,'^(.*?[A-Za-z])_[^_]*\\d',1)<>'' THEN concat(regexp_extract(key,'^(.*?[A-Za-z])_[^_]*\\d',1),'_*') ELSE key END"
_PARAMS = _PAIRS + f""", qf AS (SELECT *, {_fam} AS family, count(DISTINCT key) OVER (PARTITION BY {_fam}) AS fk FROM qp_), qg AS (SELECT *, CASE WHEN fk>=2 THEN family ELSE key END AS param, regexp_matches(url_decode(replace(value,'+',' ')), {lit(T.ATTACK_VALUE)}) AS att FROM qf),
qa AS (SELECT param, query, any_value(n) AS n, any_value(people_n) AS pn, any_value(page_n) AS gn, any_value(page_people_n) AS gpn, any_value(inner_n) AS inn, any_value(error_n) AS en, any_value(scan_n) AS sn, any_value(own_n) AS own, bool_or(att) AS att FROM qg GROUP BY 1,2),
qt AS (SELECT param, sum(n) AS n, sum(pn) AS pn, sum(gn) AS gn, sum(gpn) AS gpn, sum(inn) AS inn, sum(en) AS en, sum(sn) AS sn, sum(own) AS own, coalesce(sum(n) FILTER (WHERE att),0) AS an FROM qa GROUP BY 1),
qv AS (SELECT param, count(DISTINCT value) AS "values", count(DISTINCT key) AS keys FROM qg GROUP BY 1)
SELECT param, keys, CASE WHEN an>=0.5*n OR (sn>=0.5*n AND pn=0) OR (pn<=greatest(1,0.02*n) AND en>=0.9*n) THEN 'attacks and probes' WHEN {_MATCH.format(k='param')} IS NOT NULL THEN {_MATCH.format(k='param')}
 WHEN regexp_matches(param,{lit(T.NAV_KEYS)}) AND gn>=0.5*n AND gpn>=2 THEN 'search and navigation' WHEN pn>=3 AND inn>=3 THEN 'site logic' WHEN own>=0.5*n THEN 'site logic' ELSE 'unknown' END AS param_group,
 CAST(n AS BIGINT) AS requests, CAST(pn AS BIGINT) AS people_requests, "values", CAST(en AS BIGINT) AS errors FROM qt JOIN qv USING (param)"""
_seg = "regexp_extract(base,'^(/[^/]+/[^/]+/|/[^/]+/)',1)"
_rec = registry("rg") + f""", rc_ AS (SELECT rg.*, for_people, [lower(split_part(p,'=',1)) FOR p IN string_split(query,'&') IF lower(split_part(p,'=',1)) NOT IN {in_list(fv.AD_PARAMS)}] AS ks FROM rg JOIN adr USING (base) WHERE method='GET' AND query<>'' AND form='page' AND probe=''),
rk_ AS (SELECT *, CASE WHEN regexp_matches(base,'(?i)/(api|rest)/') THEN 'api' WHEN regexp_matches(base,{lit(T.SCRIPTS)}) THEN CASE WHEN for_people THEN 'service script' ELSE 'scanner' END
  WHEN len([k FOR k IN ks IF regexp_full_match(k,'q|query|s|search|text')])>0 THEN 'search' WHEN len([k FOR k IN ks IF regexp_matches(k,{lit(T.FACET_KEY)})])>0 THEN 'filter' END AS kind FROM rc_),
recv AS (SELECT base, kind, count(*) AS requests, count(DISTINCT ip) AS ips, count_if(status<400) AS ok, min(ts) AS first_ts, max(ts) AS last_ts FROM rk_ WHERE kind IS NOT NULL GROUP BY 1,2 HAVING count(*)>=3)"""
_POST = """, pt AS (SELECT tpl, count(*) AS requests, count(DISTINCT ip) AS ips, count_if(status BETWEEN 200 AND 399 AND status<>301) AS ok, count_if(status IN (404,405)) AS gone, count_if(status IN (404,405,301,302)) AS bad, count_if(status=403) AS f403,
 count_if(ref_internal) AS ri, count_if("group"='own') AS own, count_if("group"<>'own') AS outsiders, count_if("group"<>'own' AND status=200) AS outsiders_ok FROM rg WHERE method='POST' GROUP BY 1 HAVING count(*)>=3),
posts AS (SELECT tpl AS address, 'POST' AS method, CASE WHEN tpl IN (SELECT gkey FROM goals WHERE rule LIKE 'goal%') THEN 'lead' WHEN tpl='/admin/' THEN 'login' WHEN gone>=0.8*requests OR bad>=0.8*requests OR f403>=0.5*requests THEN 'scanner' WHEN contains(tpl,'upload') THEN 'file upload'
 WHEN regexp_matches(tpl,'ajax|/tools/|/services/|autosave|\\.php$') AND ok>=0.5*requests THEN 'service script' WHEN ri>=0.8*requests THEN 'page load' ELSE 'scanner' END AS kind, requests, ips, own, outsiders, outsiders_ok FROM pt)"""
_bk = case_rx("base", [(p, lit(n)) for p, n in T.BLOCK_KINDS], "'unrecognised'")

SQL = {
    "w04_embedded_templates": sql("grouped", """, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY vid ORDER BY ts, req_id) <= 3, false) AND ref_internal AS soon FROM rg)
        SELECT tpl, count(*) AS hits, round(count_if(soon)/count(*),6) AS share FROM g WHERE method='GET' AND NOT is_static AND ua_browser GROUP BY 1 HAVING count_if(soon)/count(*)>=0.05 AND count(*)>=50"""),
    "a04_top_pages": _top("base", 500, "ok>0"),
    "a04_top_sections": _top("regexp_extract(base,'^(/[^/?]*/?)',1)", 100, "true"),
    "a04_page_types": _top("tpl", 200, "ok>0"),
    "a04_leads_by_page": sql("grouped", "SELECT ref_path AS page, count(*) AS leads FROM rg WHERE goal<>'' AND method='POST' AND \"group\"='people' GROUP BY 1"),
    "a05_facets": sql("grouped", _FACETS + " SELECT * FROM fa"),
    "a08_pd_in_get": sql("grouped", _Q + f""", h AS (SELECT query FROM qp GROUP BY 1 HAVING bool_or(query<>'' AND NOT {_link} AND ({_kind}) IS NOT NULL))
        SELECT base, array_to_string([{_mask} FOR p IN string_split(query,'&')],'&') AS masked, "group", count(*) AS n, count(DISTINCT ip) AS ips FROM rg WHERE method='GET' AND query IN (SELECT query FROM h) GROUP BY base, query, "group\""""),
    "a65_files_inventory": sql("grouped", registry("rg") + f""", p AS (SELECT base, count(*) AS requests, sum(bytes) AS bytes, count_if(status BETWEEN 200 AND 299 OR status=304) AS ok, count_if(ref_internal) AS from_site, count_if(ref_internal AND "group" IN ('people','own')) AS asked,
          min(day) AS first_day, max(day) AS last_day, count_if(fam<>'') AS robots FROM rg GROUP BY 1),
        f AS (SELECT p.*, file_group, {_seg} AS seg, lower(regexp_extract(base,'\\.([A-Za-z0-9]+)$',1)) AS ext FROM p JOIN adr USING (base) WHERE form='file' AND p.requests>=3 AND (ok>0 OR asked>0 OR regexp_matches(base,{lit(T.AUTO_ASKED)}))),
        k AS (SELECT *, CASE WHEN seg<>'' AND file_group<>'for robots' THEN count(*) OVER (PARTITION BY seg, ext, file_group) ELSE 0 END AS k FROM f)
        SELECT CASE WHEN k>=3 THEN concat(seg, CASE WHEN ext='' THEN '*' ELSE '*.' || ext END) ELSE base END AS file, file_group, count(*) AS files, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(from_site) AS BIGINT) AS from_site, CAST(sum(robots) AS BIGINT) AS robots,
        round(sum(bytes)/sum(requests),4) AS mean_bytes, min(first_day) AS first_day, max(last_day) AS last_day FROM k GROUP BY 1,2"""),
    "a66_params_inventory": sql("grouped", _PARAMS),
    "a66_param_companions": sql("grouped", _PAIRS + """, d AS (SELECT DISTINCT query, n, key FROM qp_), t AS (SELECT key, sum(n) AS total FROM d GROUP BY 1)
        SELECT a.key, b.key AS companion, CAST(sum(a.n) AS BIGINT) AS n, CAST(any_value(total) AS BIGINT) AS total FROM d a JOIN d b ON a.query=b.query AND a.key<>b.key JOIN t ON t.key=a.key GROUP BY 1,2 HAVING sum(a.n)>=0.9*any_value(total)"""),
    "j16_match_params": sql("grouped", _PAIRS + f" SELECT DISTINCT key, {_PAT.format(k='key')} AS pattern, {_MATCH.format(k='key')} AS param_group FROM qp_ WHERE {_MATCH.format(k='key')} IS NOT NULL"),
    "a67_embedded_blocks": sql("grouped", f"SELECT tpl, {_bk} AS kind, count(*) AS requests, count(DISTINCT vid) AS visits, count(DISTINCT ref_path) AS pages FROM rg WHERE \"group\"='people' AND ref_internal AND NOT is_static AND method='POST' GROUP BY 1,2"),
    "a68_site_structure": sql("grouped", registry("rg") + """, p AS (SELECT base, any_value(tpl) AS tpl, count(*) AS n, count_if("group"='people') AS people, count_if(status>=400) AS errors, count_if(query<>'') AS wq FROM rg GROUP BY 1)
        SELECT section, CAST(len([s FOR s IN string_split(base,'/') IF s<>'']) AS INT) AS level, count(*) AS addresses, count(DISTINCT tpl) AS templates, count_if(form='page') AS pages, count_if(form='file') AS files, count_if(existence='live') AS live, CAST(sum(n) AS BIGINT) AS requests,
        CAST(sum(people) AS BIGINT) AS people_requests, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(wq) AS BIGINT) AS with_query FROM p JOIN adr USING (base) GROUP BY 1,2"""),
    "a69_receivers": sql("grouped", _rec + " SELECT * FROM recv"),
    "r26_post_kinds": sql("grouped", _POST + " SELECT * FROM posts"),
    "a70_intake": sql("grouped", _rec + _POST + " SELECT address, method, kind, requests, ips FROM posts UNION ALL SELECT base, 'GET', kind, requests, ips FROM recv"),
    "a71_engines": sql("grouped", "SELECT '1C-Bitrix' AS engine, count(*) AS requests, count(DISTINCT ip) AS ips FROM rg WHERE ua_browser AND status IN (200,304) AND req_id%7=0"),
    "a71_server": sql("grouped", f""",{ERROR_LINES} SELECT 'php' AS fact, regexp_extract(msg,'PHP (Fatal error|Warning|Notice|Deprecated|Parse error)',1) AS value, count(*) AS n FROM el WHERE regexp_matches(msg,'PHP (Fatal error|Warning|Notice|Deprecated|Parse error)') GROUP BY 2
        UNION ALL SELECT 'path', '/var/www/site', count(*) FROM el WHERE contains(msg,'/var/www/site') UNION ALL SELECT 'nginx 499', '', count(*) FROM rg WHERE status=499"""),
    "a71_ad_parameters": sql("visits", f""", k AS (SELECT lower(split_part(p,'=',1)) AS key FROM (SELECT unnest(string_split(entry_query,'&')) AS p FROM vs WHERE "group"='people' AND NOT entry_ref_internal AND entry_query<>'')) SELECT key, count(*) AS entries, key IN {in_list(fv.AD_PARAMS)} AS is_ad FROM k WHERE key<>'' GROUP BY 1"""),
    "a72_site_profile": sql("grouped", f""", h AS (SELECT * FROM rg WHERE "group"='people' AND is_page AND status=200 AND method='GET'), o AS (SELECT count(*) AS views, count(DISTINCT base) AS pages, count(DISTINCT vid) AS visits, count(DISTINCT vid) FILTER (WHERE regexp_matches(base,{lit(T.PURPOSE['cart'])})) AS cart,
          count(DISTINCT vid) FILTER (WHERE regexp_matches(base,{lit(T.PURPOSE['cabinet'])})) AS cabinet, count_if(regexp_matches(base,{lit(T.PURPOSE['content'])})) AS content, count_if(regexp_matches(base,{lit(T.PURPOSE['api'])})) AS api,
          CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM h GROUP BY base ORDER BY n DESC, base LIMIT 3)) AS BIGINT) AS top3, (SELECT count(*) FROM goals WHERE rule LIKE 'goal%') AS forms, (SELECT count(*) FROM vs WHERE "group"='people') AS people_visits FROM h)
        SELECT *, CASE WHEN api>=0.5*views THEN 'web service or API' WHEN cabinet>=0.5*people_visits THEN 'closed platform' WHEN cart>=0.005*people_visits AND cart>=20 THEN 'online shop' WHEN pages<=10 OR (top3>=0.8*views AND pages<=30) THEN 'landing page'
          WHEN content>=0.4*views THEN 'content site' WHEN forms>0 THEN 'catalog with leads' ELSE 'corporate site' END AS purpose FROM o"""),
    "a73_gov_robots": sql("grouped", f""", so AS (SELECT vid FROM rg GROUP BY vid HAVING bool_and(regexp_matches(base,{lit(special.SERVICE_ONLY)}))), a AS (SELECT *, {_OPER} AS gov_op FROM vs),
        b AS (SELECT vid, gov_op, CASE WHEN fam='' AND n_goal=0 AND (vid IN (SELECT vid FROM so) OR n_pages>=100) THEN 'scanner under a browser' WHEN "group"='people' THEN 'visitor' WHEN "group"='bots' AND regexp_matches(subgroup,'^(scanner under a browser|masked|explicit)') THEN 'scanner under a browser' ELSE 'other' END AS gov_kind FROM a WHERE gov_op<>'')
        SELECT ip, gov_op, gov_kind, count(*) AS requests, count(DISTINCT base) AS addresses, count_if(status IN (403,429,444) OR status>=500) AS refused, min(day) AS first_day, max(day) AS last_day FROM rg JOIN b USING (vid) GROUP BY 1,2,3"""),
    "a74_web_archive": sql("grouped", OUTAGES + """, w AS (SELECT vid FROM vs WHERE asn=8359 AND fam='' AND n_pages=1 AND n_req>=3 AND dur<=120 AND "group"<>'own')
        SELECT 'Web archive: page save' AS archive, count(*) AS requests, count(DISTINCT ip) AS ips, count(DISTINCT base) AS addresses, count_if(status IN (403,429,444) OR status>=500) AS refused, round(count_if(status IN (403,429,444) OR status>=500)/count(*)*100,4) AS refused_pct,
        count_if(EXISTS (SELECT 1 FROM outages WHERE ts // 60 BETWEEN degraded_from // 60 AND degraded_to // 60)) AS in_outage FROM rg WHERE vid IN (SELECT vid FROM w) HAVING count(*)>0"""),
    "a76_summary": sql("grouped", """SELECT count(*) AS visits, count_if("group"='people') AS people_visits, CAST(sum(n_pages_raw) AS BIGINT) AS pages_raw, CAST(sum(n_pages) AS BIGINT) AS pages, CAST(sum(n_dup) AS BIGINT) AS double_loads, CAST(sum(n_redirect) AS BIGINT) AS redirects, CAST(sum(n_goal) AS BIGINT) AS sent,
        CAST(sum(n_conv) AS BIGINT) AS accepted, count(DISTINCT ip) FILTER (WHERE "group"='people') AS people_ips, (SELECT count(*) FROM rg) AS requests, (SELECT count(DISTINCT ip) FROM rg) AS ips, (SELECT min(ts) FROM rg) AS first_ts, (SELECT max(ts) FROM rg) AS last_ts FROM vs"""),
    "r17_shop": sql("grouped", """, h AS (SELECT * FROM rg WHERE "group"='people'), r AS (SELECT vid, bool_or(base LIKE '/cart/checkout/%' OR base='/cart/') AS reached FROM h GROUP BY 1), c AS (SELECT * FROM h WHERE ref_internal AND NOT is_static AND NOT is_page),
        rfx AS (SELECT base FROM c GROUP BY 1 HAVING count(DISTINCT ref_path)>=5), cv AS (SELECT DISTINCT base, vid FROM c WHERE base IN (SELECT base FROM rfx)), a AS (SELECT base, count(*) AS visits, avg(CAST(reached AS INT)) AS rate FROM cv JOIN r USING (vid) GROUP BY 1)
        SELECT base, CASE WHEN base LIKE '/cart/success/%' THEN 'success' WHEN base LIKE '/cart/checkout/%' THEN 'checkout' ELSE 'cart' END AS role, count(DISTINCT vid) AS visits, CAST(-1 AS DOUBLE) AS lift FROM h WHERE method='GET' AND status<400 AND (base LIKE '/cart/success/%' OR base LIKE '/cart/checkout/%' OR base='/cart/') GROUP BY 1,2
        UNION ALL SELECT base, 'product action', visits, round(rate/(SELECT avg(CAST(reached AS INT)) FROM r),6) FROM a WHERE round(rate/(SELECT avg(CAST(reached AS INT)) FROM r),6)>=1.0"""),
    "k01_time_order": sql("requests", "SELECT ts, req_id, base FROM requests ORDER BY ts, req_id"),
    "k03_top_rows": sql("visits", "SELECT vid, n_req, bytes FROM vs ORDER BY n_req DESC, bytes DESC, vid LIMIT 50"),
    "u01_union_chunks": sql("requests", "SELECT status, count(*) AS n FROM requests GROUP BY 1"),
    "u02_first_per_key": sql("requests", ", r AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, req_id) AS k FROM requests) SELECT ip, req_id, base FROM r WHERE k=1"),
    "u03_ip_sets": sql("visits", """, p AS (SELECT ip, bool_or("group"='people') AS p, bool_or("group"='bots') AS b FROM vs GROUP BY 1) SELECT count_if(p AND b) AS ips, 'both' AS kind FROM p UNION ALL SELECT count_if(p AND NOT b), 'people only' FROM p UNION ALL SELECT count_if(b AND NOT p), 'bots only' FROM p"""),
    "u04_site_cut": sql("grouped", "SELECT vhost, count(*) AS n, count(DISTINCT vid) AS visits FROM rg WHERE host_site GROUP BY 1"),
    "p27_actor_labels": sql("requests", "SELECT DISTINCT ua, CASE WHEN regexp_extract(ua,'compatible; ?([^/;)]+)',1)<>'' THEN trim(regexp_extract(ua,'compatible; ?([^/;)]+)',1)) ELSE regexp_extract(ua,'^([^/ (]+)',1) END AS program FROM requests"),
    "p06_simple_templates": sql("grouped", "SELECT DISTINCT base, tpl FROM rg"),
}
