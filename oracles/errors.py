"""Check queries for the address registry and error tables."""

from oracles.prelude import ERROR_LINES, SEGMENT, case_rx, in_list, lit, plain_counts, sql
from weblens.functions import fixed_values as fv

SEARCH_OK = f"(fam IN {in_list(fv.SEARCH_FAMILIES)} AND fam_verified='yes')"
WHO = (f"CASE WHEN \"group\"='people' THEN 'people' WHEN {SEARCH_OK} THEN 'search robots' WHEN \"group\" IN ('robots','monitors','utilities','own') THEN \"group\" ELSE 'bots' END")
ORIGIN = "CASE WHEN ref_internal THEN 'site pages' WHEN ref_host IN ('','-') THEN 'direct' ELSE 'other sites' END"
_WHO = ["people", "search robots", "robots", "monitors", "utilities", "bots", "own"]
PROBE_RX = {s: "(?i)" + "|".join(f"(?:{p})" for _, _, t, p in fv.PROBES if t == s) for s in ("strong", "weak")}
VULN = (f"(regexp_matches(base, {lit('(?i)' + fv.VULNERABILITY + '|' + '|'.join(f'(?:{p})' for _, _, _, p in fv.PROBES))})"
        " OR (regexp_matches(base, '(?i)/\\.well-known/') AND NOT regexp_matches(base, '(?i)/\\.well-known/acme')))")
TOP = lambda keys, value, name, n, src, where="true": f"""(SELECT {keys}, string_agg(concat(v, ': ', CAST(n AS VARCHAR)), ', ' ORDER BY k) AS {name} FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, v) AS k FROM (SELECT {keys}, CAST({value} AS VARCHAR) AS v, count(*) AS n FROM {src} WHERE {where} GROUP BY ALL)) WHERE k <= {n} GROUP BY {keys})"""

_ext_group = "CASE " + " ".join(f"WHEN e IN {in_list(x.split())} THEN {lit(g)}" for g, x in fv.FILE_GROUPS_BY_EXTENSION) + " END"
_by_addr = case_rx("p", [("(?i)" + rx, lit(g)) for g, rx in fv.FILE_GROUPS_BY_ADDRESS], "NULL")


def forms(src):
    """Address registry CTEs over a relation with base, status, group, fam, ref_internal."""
    return f""",
af0 AS (SELECT base, CASE WHEN regexp_replace(base, '^https?://[^/]+', '')='' THEN '/' ELSE regexp_replace(base, '^https?://[^/]+', '') END AS r FROM (SELECT DISTINCT base FROM {src})),
af1 AS (SELECT *, url_decode(r) AS p FROM af0),
af2 AS (SELECT *, regexp_extract(rtrim(p,'/'), '([^/]*)$', 1) AS leaf FROM af1),
af3 AS (SELECT *, CASE WHEN starts_with(leaf,'.') THEN lower(split_part(leaf[2:],'.',1)) ELSE lower(regexp_extract(leaf,'\\.([A-Za-z0-9]{{1,10}})$',1)) END AS e FROM af2),
af4 AS (SELECT *, regexp_matches(r, {lit(fv.CONSTRUCT)}) OR regexp_matches(p, {lit(fv.CONSTRUCT)}) AS cons, {_by_addr} AS ga, {_ext_group} AS ge, starts_with(leaf,'.') AND length(leaf)>1 AS hid,
  e='' OR e IN {in_list(fv.PAGE_EXTENSIONS + fv.TLD_TAILS)} OR regexp_full_match(e,'\\d+') AS pagelike FROM af3),
af AS (SELECT base, CASE WHEN cons THEN 'construct' WHEN ga IS NOT NULL OR hid THEN 'file' WHEN pagelike THEN 'page' ELSE 'file' END AS form,
  CASE WHEN cons THEN '' WHEN ga IS NOT NULL THEN ga WHEN hid THEN 'configs' WHEN pagelike THEN '' ELSE coalesce(ge,'unknown kind') END AS file_group,
  CASE WHEN cons THEN '' WHEN ga IS NOT NULL THEN e WHEN hid THEN lower(leaf[2:]) ELSE e END AS extension,
  CASE WHEN cons OR ga IS NOT NULL THEN false WHEN hid THEN lower(leaf[2:]) NOT IN {in_list(fv.HIDDEN_FILES)} WHEN pagelike THEN false ELSE ge IS NULL END AS unknown_ext FROM af4)"""


def registry(src):
    return forms(src) + f""",
ad1 AS (SELECT base, count(*) AS requests, count_if(w AND status BETWEEN 200 AND 299) AS ok, count_if(status BETWEEN 200 AND 299) AS oka, count_if(w AND status BETWEEN 300 AND 399) AS r3,
  count_if(status BETWEEN 400 AND 499) AS e4, count_if(status>=500) AS e5, count_if(fam<>'') AS rob, count_if(ref_internal) AS inn FROM (SELECT *, "group" IN ('people','own') AS w FROM {src}) GROUP BY base),
ad2 AS (SELECT *, CASE WHEN regexp_matches(base, {lit(PROBE_RX['strong'])}) OR regexp_matches(url_decode(base), {lit(PROBE_RX['strong'])}) THEN 'strong'
  WHEN regexp_matches(base, {lit(PROBE_RX['weak'])}) OR regexp_matches(url_decode(base), {lit(PROBE_RX['weak'])}) THEN 'weak' ELSE '' END AS pr FROM ad1 JOIN af USING (base)),
adr AS (SELECT base, form, CASE WHEN file_group='widget data' AND extension IN ('xml','yml','csv','tsv') AND rob>=0.5*requests AND inn<0.2*requests THEN 'feeds and exports' ELSE file_group END AS file_group,
  extension, unknown_ext, CASE WHEN pr='weak' AND ok>0 THEN '' ELSE pr END AS probe, CASE WHEN ok>0 OR oka>0 THEN 'live' WHEN r3>0 THEN 'redirect' WHEN e5>0 THEN 'broken' ELSE 'missing' END AS existence,
  ok>0 AS for_people, file_group='service (.well-known)' AS service_page, starts_with(base,'/.well-known/') AND file_group NOT IN ('service (.well-known)','ownership proofs') AND oka>0 AS foreign_well_known,
  regexp_extract(base,'^(/[^/]*/?)',1) AS section, requests FROM ad2)"""


_who_counts = ", ".join(f"count_if(who='{w}') AS {w.replace(' ', '_')}" for w in _WHO)
_R = f", rw AS (SELECT *, {WHO} AS who, {ORIGIN} AS origin FROM rg)"
_ETYPE = case_rx("msg", [(p, lit(n)) for n, p in fv.ERROR_TYPES], "'other'")
_EL = f"WITH {ERROR_LINES}, et AS (SELECT *, {_ETYPE} AS type, DATE '1970-01-01' + CAST(ts // 86400 AS INT) AS day FROM el)"
_rptpl = f"array_to_string([{SEGMENT} FOR s IN string_split(ref_path,'/')], '/')"
_AD = f"regexp_matches(query, {lit(fv.AD_MARK)})"
_CODES = _R + f""", ac0 AS (SELECT base, status, count(*) AS requests, count(DISTINCT ip) AS ips, min(day) AS first_day, max(day) AS last_day, {_who_counts},
  count_if(origin='site pages') AS site_pages, count_if(origin='direct') AS direct, count_if(origin='other sites') AS other_sites FROM rw WHERE status>=400 GROUP BY 1,2),
ac1 AS (SELECT base, status, arg_min(s, (-n, s)) AS source FROM (SELECT base, status, CASE origin WHEN 'site pages' THEN ref_path WHEN 'other sites' THEN ref_host ELSE '' END AS s, count(*) AS n FROM rw WHERE status>=400 GROUP BY ALL) WHERE s<>'' GROUP BY 1,2),
ac AS (SELECT ac0.*, coalesce(source,'') AS source FROM ac0 LEFT JOIN ac1 USING (base, status))"""
_SRC = f""", es0 AS (SELECT *, CASE WHEN {_AD} THEN 'ads' WHEN origin='site pages' AND ref_path<>base THEN 'site pages' WHEN origin='other sites' AND regexp_matches(ref_host, {lit(fv.REF_SEARCH)}) THEN 'search' WHEN origin='other sites' THEN 'sites' ELSE 'direct' END AS kind FROM rw WHERE status>=400),
es AS (SELECT base, status, kind, CASE WHEN kind='site pages' THEN {_rptpl} WHEN kind IN ('search','sites') THEN ref_host ELSE '' END AS detail, count(*) AS n FROM es0 GROUP BY ALL)"""
_broken = lambda static: f"\"group\"='people' AND status=404 AND {'' if static else 'NOT '}is_static AND NOT {VULN}"
_T5 = lambda tpl: f""", t5 AS (SELECT {tpl} AS tpl, count_if(status>=500) AS errors, count_if(status>=500 AND "group"='people') AS human_errors, count(DISTINCT vid) FILTER (WHERE status>=500 AND "group"='people') AS human_visits,
  count(DISTINCT base) FILTER (WHERE status>=500) AS addresses, min(day) FILTER (WHERE status>=500) AS first_day, max(day) FILTER (WHERE status>=500) AS last_day, count(DISTINCT day) FILTER (WHERE status>=500) AS days,
  count_if(status<400) AS ok FROM rg WHERE is_page OR method='POST' GROUP BY 1 HAVING count_if(status>=500)>0)"""
_GLUED = f", rc AS (SELECT * REPLACE (CASE WHEN req_id%53=0 THEN base || '${{marker.image}}' WHEN req_id%59=0 THEN base || 'item.qqq' ELSE base END AS base) FROM rg)"
_SV = f"regexp_matches(base, {lit(fv.SERVICE_ADDRESSES)})"
_links = lambda kind, source, page, cond: sql("grouped", _R + registry("rg") + f""" SELECT {kind} AS kind, {source} AS source, tpl AS target, count(*) AS hits, count(DISTINCT vid) AS visits, count_if("group"='people') AS people,
  count_if({SEARCH_OK}) AS search, count(DISTINCT {page}) AS source_pages, count(DISTINCT base) AS addresses, min(day) AS first_day, max(day) AS last_day
  FROM rw WHERE status>=400 AND status<>499 AND {cond} AND base IN (SELECT base FROM adr WHERE form='page' AND probe='') GROUP BY 1,2,3""")
_journal = ", ".join([f"count_if(status>=500 AND who='{w}') AS e5_{w.replace(' ', '_')}, count_if(status BETWEEN 400 AND 498 AND who='{w}') AS e4_{w.replace(' ', '_')}" for w in _WHO]
                     + [f"count_if(status=499 AND who='{w}') AS e499_{w.replace(' ', '_')}" for w in _WHO[:2]])
_SOFT = _R + """, sp AS (SELECT base, bytes, who, count(*) AS n FROM rw WHERE is_page AND status=200 AND method<>'HEAD' AND bytes<20000 GROUP BY ALL),
""" + "sz AS MATERIALIZED (SELECT DISTINCT bytes FROM sp)," + """
sr AS (WITH RECURSIVE st(start) AS (SELECT min(bytes) FROM sz UNION ALL SELECT (SELECT min(bytes) FROM sz WHERE bytes > st.start * 1.02) FROM st WHERE st.start IS NOT NULL AND EXISTS (SELECT 1 FROM sz WHERE bytes > st.start * 1.02)) SELECT start FROM st),
sg AS (SELECT sp.*, (SELECT max(start) FROM sr WHERE start <= sp.bytes) AS start FROM sp),
sb AS (SELECT start, min(bytes) AS size_from, max(bytes) AS size_to, count(DISTINCT base) AS addresses, CAST(sum(n) AS BIGINT) AS requests, round(coalesce(sum(n) FILTER (WHERE who='people'),0)/sum(n)*100,4) AS people_pct,
  round(coalesce(sum(n) FILTER (WHERE who='search robots'),0)/sum(n)*100,4) AS search_pct, round(coalesce(sum(n) FILTER (WHERE who='bots'),0)/sum(n)*100,4) AS bots_pct,
  count(DISTINCT base) FILTER (WHERE NOT ends_with(base,'/')) AS ns FROM sg GROUP BY start HAVING count(DISTINCT base)>=8),
sm AS (SELECT base, median(bytes) AS m FROM rw WHERE is_page AND status=200 AND method<>'HEAD' GROUP BY base),
stw AS (SELECT start, count(*) AS tw, count_if(abs(m-start)>0.1*start) AS df FROM (SELECT DISTINCT start, base FROM sg WHERE NOT ends_with(base,'/')) x JOIN sm ON sm.base = x.base || '/' GROUP BY start),
s4 AS (SELECT arg_min(bytes, (-n, bytes)) AS b FROM (SELECT bytes, count(*) AS n FROM rw WHERE is_page AND status=404 GROUP BY 1))
SELECT start, size_from, size_to, addresses, requests, people_pct, search_pct, bots_pct, CASE WHEN ns>addresses/2 AND coalesce(tw,0)>=greatest(20,0.1*ns) AND coalesce(df,0)>coalesce(tw,0)/2 THEN 'no trailing slash'
  WHEN abs((SELECT b FROM s4)-start)<=0.02*start THEN 'not found with code 200' ELSE 'same page, check' END AS kind FROM sb LEFT JOIN stw USING (start)"""

SQL = {
    "p08_address_form": sql("requests", forms("requests") + " SELECT * FROM af"),
    "p09_address_registry": sql("grouped", registry("rg") + " SELECT * FROM adr"),
    "p10_probe_addresses": sql("grouped", registry("rg") + f" SELECT base FROM adr WHERE {VULN} AND NOT (probe='' AND (for_people OR service_page))"),
    "p12_constructs": sql("grouped", _GLUED + registry("rc") + """, k AS (SELECT base, count(*) AS requests, count(DISTINCT ip) AS ips, count_if("group" IN ('people','own')) AS people, count_if("group"='robots') AS robots,
        count_if(ref_internal AND "group" IN ('people','own') AND ref_path<>base) AS from_site FROM rc WHERE base IN (SELECT base FROM adr WHERE form='construct') GROUP BY base)
        SELECT *, CASE WHEN from_site>0 THEN 'broken page code' WHEN people>0 THEN 'broken outside link' WHEN robots>0 THEN 'broken link on the web' ELSE 'injection or probe by outsiders' END AS verdict FROM k"""),
    "p22_error_types": _EL + " SELECT line_no, type FROM et",
    "p25_owner_origin_state": sql("grouped", _R + """ SELECT who, origin, CASE WHEN status<300 OR status=304 THEN 'works' WHEN status<400 THEN 'redirect' WHEN status IN (404,410) THEN 'missing' WHEN status<500 THEN 'refused' ELSE 'server error' END AS state, count(*) AS n FROM rw GROUP BY ALL"""),
    "a09_errors_by_day": sql("grouped", _R + """ SELECT day, CASE WHEN who IN ('people','search robots','robots','own') THEN who ELSE 'bots' END AS who, count_if(status>=500) AS n_5xx, count_if(status=499) AS n_499, count_if(status=404) AS n_404,
        count_if(status BETWEEN 400 AND 498 AND status<>404) AS n_4xx_other, count_if(status<400) AS n_normal FROM rw GROUP BY 1,2"""),
    "a09_status_codes": sql("grouped", _R + f" SELECT status, {_who_counts} FROM rw GROUP BY status"),
    "a10_errors_5xx": sql("grouped", _T5("tpl") + " SELECT *, regexp_extract(tpl,'^(/[^/?]*/?)',1) AS section FROM t5"),
    "a10_sections_5xx": sql("grouped", _T5("base") + """, s AS (SELECT *, regexp_extract(tpl,'^(/[^/?]*/?)',1) AS section FROM t5)
        SELECT section, count(*) AS templates, CAST(sum(human_errors) AS BIGINT) AS human_errors, max(human_errors) AS worst FROM s WHERE human_errors>=5 GROUP BY 1 HAVING count(*)>=3 AND max(human_errors)<0.5*sum(human_errors)"""),
    "a11_entry_404": sql("visits", f""", h AS (SELECT * FROM vs WHERE "group"='people' AND entry_status=404)
        SELECT a.*, referrers FROM (SELECT entry, channel, count(*) AS visits, count(DISTINCT ip) AS ips FROM h GROUP BY 1,2) a JOIN {TOP('entry, channel', 'entry_ref_host', 'referrers', 2, 'h')} b USING (entry, channel)"""),
    "a12_broken_links": sql("grouped", f""", b AS (SELECT * FROM rg WHERE ref_internal AND {_broken(False)})
        SELECT a.*, main_sources FROM (SELECT tpl, count(*) AS hits, count(DISTINCT vid) AS visits, min(base) AS example, count(DISTINCT ref_path) AS source_pages FROM b GROUP BY tpl) a JOIN {TOP('tpl', 'ref_path', 'main_sources', 2, 'b')} t USING (tpl)"""),
    "a12_broken_link_sources": sql("grouped", f"SELECT ref_path, count(*) AS hits, count(DISTINCT base) AS addresses FROM rg WHERE ref_internal AND {_broken(False)} GROUP BY 1"),
    "a12_links_internal": _links("'internal'", _rptpl, "ref_path", "origin='site pages' AND ref_path<>base"),
    "a12_links_external": _links(f"CASE WHEN {_AD} THEN 'ads' WHEN regexp_matches(ref_host, {lit(fv.REF_SEARCH)}) THEN 'search' ELSE 'sites' END",
                                 "CASE WHEN ref_host IN ('','-') THEN 'no referrer' ELSE ref_host END", "ref_host", f"(origin='other sites' OR {_AD})"),
    "a13_missing_static": sql("grouped", f""", f AS (SELECT base, count(*) AS requests, count(DISTINCT vid) AS visits FROM rg WHERE ext<>'map' AND {_broken(True)} GROUP BY base)
        SELECT CASE WHEN regexp_matches(base, {lit(fv.INVISIBLE_FILES)}) THEN base WHEN regexp_matches(base, '/apple-touch-icon[\\w-]*\\.png$') THEN '/apple-touch-icon*.png' ELSE regexp_replace(base,'[^/]+$','*') END AS folder,
        count(*) AS files, CAST(sum(requests) AS BIGINT) AS requests, max(visits) AS max_visits FROM f GROUP BY 1"""),
    "a14_service_files": sql("grouped", f""", s AS (SELECT * FROM rg WHERE {_SV}) SELECT a.*, codes FROM (SELECT base, day, count(*) AS requests, round(avg(bytes)/1024,4) AS kb FROM s GROUP BY 1,2) a
        JOIN {TOP('base, day', 'status', 'codes', 3, 's')} t USING (base, day)"""),
    "a14_service_file_health": sql("grouped", f""", s AS (SELECT *, fam_cat IN {in_list([fv.SEARCH, fv.ADS, 'feeds and marketplaces', fv.GOOGLE_SVC])} AS legit FROM rg WHERE {_SV}),
        q AS (SELECT base, ts, status>=400 AS bad, count(*) AS n, max(req_id) AS lr FROM s GROUP BY 1,2,3),
        r AS (SELECT s.*, row_number() OVER (PARTITION BY s.base ORDER BY s.ts DESC, q.lr DESC, q.bad) AS k, count(*) OVER (PARTITION BY s.base) AS c FROM s JOIN q ON q.base=s.base AND q.ts=s.ts AND q.bad=(s.status>=400)),
        t AS (SELECT base, count(*) AS requests, count_if(legit) AS legit, count_if(legit AND status>=400) AS lb, count_if(status=200) AS ok, count_if(status<300 OR status>=400) AS an, count_if(status=404) AS ms,
          count_if(status>=400 AND k<=greatest(1, c // 5)) / greatest(1, count(*) // 5) AS tb FROM r GROUP BY base)
        SELECT base, requests, legit, ok, round(tb,6) AS tail_bad, CASE WHEN (legit>=10 AND lb/legit>0.8) OR (ok>=5 AND tb>0.8) THEN 'failing' WHEN regexp_matches(base,'^/(robots\\.txt|sitemap\\.xml)$') AND an>0 AND ms/an>0.9 THEN 'absent' ELSE 'fine' END AS verdict FROM t"""),
    "a15_search_errors": sql("grouped", f""", s AS (SELECT * FROM rg WHERE {SEARCH_OK}) SELECT a.*, codes FROM (SELECT fam, tpl, count(*) AS requests, count_if(status>=400) AS errors FROM s GROUP BY 1,2 HAVING count_if(status>=400)>0) a
        JOIN {TOP('fam, tpl', 'status', 'codes', 3, 's', 'status>=400')} t USING (fam, tpl)"""),
    "a16_ad_errors": sql("visits", """SELECT entry, entry_status, count(*) AS clicks, min(day) AS first_day, max(day) AS last_day FROM vs WHERE "group"='people' AND channel='ads' AND entry_status>=400 GROUP BY 1,2"""),
    "a17_soft_groups": sql("grouped", _SOFT),
    "a18_tiny_pages": sql("grouped", "SELECT base, count(*) AS answers FROM rg WHERE is_page AND status=200 AND method<>'HEAD' AND bytes<300 GROUP BY 1"),
    "a19_errlog_summary": plain_counts(_EL + f""" SELECT a.*, requests FROM (SELECT type, count(*) AS messages, min(day) AS first_day, max(day) AS last_day FROM et GROUP BY 1) a JOIN {TOP('type', 'request', 'requests', 2, 'et')} t USING (type)"""),
    "a20_address_codes": sql("grouped", _CODES + " SELECT * FROM ac"),
    "a20_error_families": sql("grouped", _CODES + """ SELECT base, CASE WHEN status=404 THEN '404' WHEN status>=500 THEN '5xx' WHEN status=499 THEN '499' ELSE '403 and other 4xx' END AS family, CAST(sum(requests) AS BIGINT) AS requests, max(ips) AS ips,
        CAST(sum(people) AS BIGINT) AS people, CAST(sum(search_robots) AS BIGINT) AS search_robots, min(first_day) AS first_day, max(last_day) AS last_day,
        string_agg(concat(CAST(status AS VARCHAR), ': ', CAST(requests AS VARCHAR)), ', ' ORDER BY status) AS codes FROM ac GROUP BY 1,2"""),
    "a21_error_sources": sql("grouped", _R + _SRC + " SELECT * FROM es"),
    "a22_criticality": sql("grouped", _CODES + _SRC + """, e AS (SELECT base, sum(people) AS people, sum(CASE WHEN status>=500 THEN people ELSE 0 END) AS p5, sum(CASE WHEN status>=500 THEN search_robots ELSE 0 END) AS s5 FROM ac WHERE status<>499 GROUP BY 1),
        s AS (SELECT base, count_if(kind='ads') AS ads, count_if(kind='site pages') AS site FROM es WHERE status<>499 GROUP BY 1), m AS (SELECT greatest(10, 0.001*count(*)) AS mass FROM vs WHERE "group"='people'),
        w AS (SELECT base, concat_ws('; ', CASE WHEN ads>0 THEN 'ads lead here' END, CASE WHEN site>0 THEN 'linked from the site' END, CASE WHEN p5>0 THEN '5xx for people' END, CASE WHEN s5>0 THEN '5xx for search robots' END,
          CASE WHEN people>=mass THEN 'many people' END) AS why FROM e LEFT JOIN s USING (base) CROSS JOIN m) SELECT * FROM w WHERE why<>''"""),
    "a23_error_journal": sql("grouped", _R + f" SELECT day, {_journal} FROM rw GROUP BY ROLLUP (day)"),
    "a23_error_summary": sql("grouped", _R + " SELECT who, count(*) AS requests, count_if(status<400) AS ok, count_if(status BETWEEN 400 AND 498) AS e4, count_if(status>=500) AS e5, count_if(status=499) AS n499 FROM rw GROUP BY 1"),
    "a24_slowness": sql("grouped", f""",{ERROR_LINES}, t AS (SELECT DATE '1970-01-01' + CAST(ts // 86400 AS INT) AS day, CAST(ts // 3600 % 24 AS INT) AS hour, count(*) AS n FROM el WHERE regexp_matches(msg, {lit(fv.TIMEOUT_MESSAGE)}) GROUP BY 1,2)
        SELECT a.*, coalesce(n,0) AS timeouts FROM (SELECT day, hour, count_if("group"='people') AS human_requests, count_if(status IN (502,504)) AS gateway_errors,
          CASE WHEN count_if("group"='people')>=1 THEN round(count_if("group"='people' AND status=499)/count_if("group"='people')*100,4) ELSE -1 END AS aborted_pct FROM rg GROUP BY 1,2) a LEFT JOIN t USING (day, hour)"""),
    "a75_unknown_extensions": sql("grouped", _GLUED + registry("rc") + """ SELECT extension, CAST(sum(requests) AS BIGINT) AS requests, count(*) AS addresses, min(base) AS example FROM adr
        WHERE unknown_ext AND probe='' AND existence<>'missing' GROUP BY 1 HAVING sum(requests)>=3 ORDER BY 2 DESC, 1 LIMIT 30"""),
    "j23_slash_twins": sql("grouped", """, p AS (SELECT base, count(*) AS requests, count_if(status<300) AS ok FROM rg WHERE base<>'/' GROUP BY 1)
        SELECT rtrim(base,'/') AS address, max(requests) FILTER (WHERE ends_with(base,'/')) AS with_slash, max(requests) FILTER (WHERE NOT ends_with(base,'/')) AS without_slash, CAST(sum(ok) AS BIGINT) AS ok
        FROM p GROUP BY 1 HAVING count_if(ends_with(base,'/'))>0 AND count_if(NOT ends_with(base,'/'))>0"""),
    "k02_top_values": sql("grouped", f"SELECT * FROM {TOP(chr(34) + 'group' + chr(34), 'base', 'top_pages', 5, 'rg')}"),
    "k04_code_rollup": sql("grouped", """, c AS (SELECT base, status, count(*) AS n FROM rg GROUP BY 1,2)
        SELECT base, coalesce(string_agg(concat(CAST(status AS VARCHAR),' (',CAST(n AS VARCHAR),')'), ', ' ORDER BY n DESC, status) FILTER (WHERE status<400 OR status=499),'') AS answers,
        coalesce(string_agg(concat(CAST(status AS VARCHAR),' (',CAST(n AS VARCHAR),')'), ', ' ORDER BY n DESC, status) FILTER (WHERE status>=400 AND status<>499),'') AS errors FROM c GROUP BY 1"""),
    "k05_most_frequent_ua": sql("grouped", """, c AS (SELECT ip, ua, count(*) AS n FROM rg WHERE ua NOT IN ('','-') GROUP BY 1,2)
        SELECT ip, arg_min(ua, (-n, ua)) AS ua, count(*)-1 AS ua_more FROM c GROUP BY ip"""),
    "p07_section_totals": sql("grouped", "SELECT regexp_extract(base,'^(/[^/?]*/?)',1) AS section, count(*) AS n FROM rg GROUP BY 1"),
}
