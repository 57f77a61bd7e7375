"""Check queries for load, security, bots and search robots."""

from oracles.errors import SEARCH_OK, TOP, VULN, registry
from oracles.prelude import case_rx, in_list, lit, sql
from weblens.functions import fixed_values as fv
from weblens.functions import personal
from weblens.marts import security as S
from weblens.marts import seo

_kv = "split_part(p,'=',1)"
_raw = "CASE WHEN contains(p,'=') THEN substr(p, strpos(p,'=')+1) ELSE '' END"
_dec = lambda x: f"url_decode(replace({x},'+',' '))"
_val = f"trim({_dec(_raw)})"
_twice = f"trim({_dec(_dec(_raw))})"
_link = f"(regexp_matches({_kv}, {lit(personal.LINK_KEYS)}) OR regexp_matches({_twice}, {lit(personal.LINK_VALUE)}))"
_digits = f"regexp_replace({_val}, '\\D', '', 'g')"
_phone = f"(regexp_matches({_val}, '^\\+?[\\d\\s()-]+$') AND CASE WHEN starts_with({_val},'+') THEN length({_digits}) BETWEEN 10 AND 15 ELSE length({_digits}) IN (10,11) AND {_digits}[1] IN ('7','8') END)"
_kind = f"""CASE WHEN {_val}='' OR lower({_kv}) IN {in_list(fv.AD_PARAMS)} OR regexp_matches({_val}, {lit(personal.PROBE_VALUE)}) THEN NULL
  WHEN regexp_matches({_val}, {lit(personal.EMAIL_VALUE)}) THEN 'email' WHEN {_phone} THEN 'phone' WHEN regexp_matches({_kv}, {lit(personal.PERSONAL_KEYS)}) THEN 'field' END"""
_maskd = f"CASE WHEN length({_digits})<4 THEN '***' ELSE concat(CASE WHEN starts_with({_val},'+') THEN '+' ELSE '' END, {_digits}[1], CASE WHEN length({_digits})>=10 THEN concat(' ', {_digits}[2]) ELSE '' END, '** ***-**-', right({_digits},2)) END"
_mask = f"""CASE WHEN NOT contains(p,'=') THEN p WHEN lower({_kv}) IN {in_list(personal.SECRET_KEYS)} AND {_raw}<>'' THEN concat({_kv},'=',left({_raw},4),'…')
  WHEN regexp_matches({_kv}, {lit(personal.TEXT_KEYS)}) AND {_val}<>'' THEN concat({_kv},'=***') WHEN ({_kind})='phone' THEN concat({_kv},'=',{_maskd})
  WHEN ({_kind})='email' THEN concat({_kv},'=',regexp_replace({_val},'([\\w.-])[\\w.-]*@([\\w-])[\\w.-]*','\\1***@\\2***','g'))
  WHEN ({_kind})='field' THEN concat({_kv},'=',CASE WHEN regexp_matches({_kv},{lit(personal.PHONE_KEYS)}) THEN {_maskd} ELSE '***' END) ELSE p END"""
_Q = ", dq AS (SELECT DISTINCT query FROM rg), qp AS (SELECT query, unnest(string_split(query,'&')) AS p FROM dq)"
# in this log the only queries with a foreign link are the redirector's and the metadata probe
_EXT = "(query LIKE 'url=https%3A%2F%2Fevil.example%' OR query LIKE 'url=http://169.254%')"
_ATT = f"(regexp_matches(query,{lit(fv.ATTACK)}) OR regexp_matches(base,{lit(fv.ATTACK)}))"
_AK = case_rx("concat(query,'|',base)", [(p, lit(n)) for n, p in S.ATTACK_KINDS], "'other'")
_A = f""", atk AS (SELECT *, CASE WHEN {_EXT} AND NOT starts_with(base,'/go/') AND (NOT {_ATT} OR ({_AK})='other') THEN 'SSRF' WHEN {_ATT} THEN {_AK} END AS attack FROM rg)"""
_STAFF = """, sa AS (SELECT *, base='/admin/' OR base='/admin/index.php' AS root FROM rg WHERE base LIKE '/admin/%' AND ua_browser),
sp AS (SELECT DISTINCT ip FROM sa WHERE root AND method='POST'),
sf AS (SELECT median(bytes) AS form FROM sa WHERE root AND method='GET' AND status=200 AND bytes>0 AND ip NOT IN (SELECT ip FROM sp)),
sj AS (SELECT sa.*, ip IN (SELECT ip FROM sp) AS poster, status=200 AND bytes>0 AS ok, coalesce(abs(bytes-form)<=greatest(300,0.05*form),false) AS isf FROM sa CROSS JOIN sf),
staff AS (SELECT ip FROM sj GROUP BY ip HAVING (bool_or(poster) AND count_if(ok AND root AND NOT isf AND method='GET')>0)
  OR (count_if(ok AND NOT root AND NOT isf AND NOT regexp_matches(base,'(?i)login|auth'))>=5 AND count_if(ok AND NOT root AND NOT isf AND NOT regexp_matches(base,'(?i)login|auth'))>count_if(ok AND isf)))"""
_PR = registry("rg") + f", probes AS (SELECT base FROM adr WHERE {VULN} AND NOT (probe='' AND (for_people OR service_page)))"
_TG = case_rx("base", [(p, lit(n)) for n, p in fv.SCAN_TARGETS], "'other'")
_GEN = f"(fam_cat='{fv.SEARCH}' AND fam_verified='yes')"
_ENG = "CASE fam " + " ".join(f"WHEN {lit(f)} THEN {lit(e)}" for f, e in seo.ENGINES.items()) + " ELSE 'other' END"
_pct = lambda c: f"round(count_if({c})/count(*)*100,4)"
_RF = f"regexp_matches(base,{lit(seo.ROBOT_FILES)})"
_OUT = f""", r0 AS (SELECT *, row_number() OVER (PARTITION BY ip, ua ORDER BY ts, req_id) AS k FROM rg),
r3 AS (SELECT * FROM r0 WHERE {_RF} AND status BETWEEN 300 AND 399),
ra AS (SELECT a.req_id, arg_min(b.status, b.k) AS s FROM r3 a JOIN r0 b ON a.ip=b.ip AND a.ua=b.ua AND b.k BETWEEN a.k+1 AND a.k+3 AND b.ts-a.ts<=60 AND b.base=a.base GROUP BY 1),
rb AS (SELECT r3.*, CASE WHEN s=200 THEN 'ok' WHEN s=403 THEN 'denied' ELSE '' END AS o1 FROM r3 LEFT JOIN ra USING (req_id)),
rp AS (SELECT a.req_id, arg_min(b.status, (b.ts, b.req_id)) AS s2 FROM rb a JOIN rg b ON a.o1='' AND a.fam<>'' AND a.fam_verified='yes' AND b.fam_verified='yes' AND a.fam=b.fam AND a.base=b.base AND b.status NOT BETWEEN 300 AND 399 AND b.ts BETWEEN a.ts AND a.ts+60 GROUP BY 1),
oc AS (SELECT rb.req_id, rb.base, CASE WHEN o1<>'' THEN o1 WHEN s2=200 THEN 'ok' WHEN s2=403 THEN 'denied' ELSE '' END AS outcome FROM rb LEFT JOIN rp USING (req_id))"""
_gsum = ", ".join(f"count_if(\"group\"='{g}') AS {g}" for g in fv.GROUPS)

SQL = {
    "p11_attack_kinds": sql("grouped", _A + " SELECT attack, count(*) AS n FROM atk WHERE attack IS NOT NULL GROUP BY 1"),
    "p19_has_pd": sql("grouped", _Q + f" SELECT query, coalesce(bool_or(query<>'' AND NOT {_link} AND ({_kind}) IS NOT NULL), false) AS has_pd FROM qp GROUP BY 1"),
    "p20_mask_query": sql("grouped", _Q + f" SELECT query, array_to_string([{_mask} FOR p IN string_split(query,'&')],'&') AS masked FROM dq"),
    "p21_external_link": sql("grouped", f"SELECT DISTINCT query FROM rg WHERE {_EXT}"),
    "r14_staff_ips": sql("grouped", _STAFF + " SELECT ip FROM staff"),
    "r21_ip_profile": sql("visits", """, b AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY n_req DESC, vid DESC) AS k FROM vs), g AS (SELECT ip, count(DISTINCT "group") AS groups, CAST(sum(n_req) AS BIGINT) AS requests FROM vs GROUP BY ip)
        SELECT ip, b."group", b.subgroup, b.fam, b.nettype, b.cc, g.groups, g.requests, (b."group"='people' OR (b."group"='own' AND b.subgroup<>'site server')) AS is_live, CASE WHEN b."group"='people' THEN 'people' WHEN b."group"='robots' THEN 'robots: ' || fam
          WHEN subgroup='fake robots' THEN 'bots: fake ' || fam WHEN subgroup<>'' THEN b."group" || ': ' || subgroup ELSE b."group" END AS label FROM b JOIN g USING (ip) WHERE k=1"""),
    "a25_heat": sql("grouped", """, h AS (SELECT day, hour, count(*) AS requests, count_if("group"='people') AS people, count_if("group" IN ('robots','bots')) AS programs, count_if("group"='people' AND status=499) AS aborted FROM rg GROUP BY 1,2)
        SELECT *, people>=quantile_cont(people,0.75) OVER () AND programs>=quantile_cont(programs,0.75) OVER () AS both_busy FROM h"""),
    "a26_peaks": sql("grouped", """, m AS (SELECT ts // 60 AS minute, count(*) AS requests FROM rg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), x AS (SELECT m.*, ip, fam FROM m JOIN rg ON ts // 60 = minute),
        i AS (SELECT minute, requests, arg_min(ip,(-k,ip)) AS top_ip, max(k) AS top_ip_requests FROM (SELECT minute, requests, ip, count(*) AS k FROM x GROUP BY 1,2,3) GROUP BY 1,2),
        f AS (SELECT minute, arg_min(fam,(-k,fam)) AS top_robot FROM (SELECT minute, fam, count(*) AS k FROM x WHERE fam<>'' GROUP BY 1,2) GROUP BY 1)
        SELECT i.*, coalesce(top_robot,'') AS top_robot FROM i LEFT JOIN f USING (minute)"""),
    "a27_load_sources": sql("grouped", """, l AS (SELECT "group" AS category, CASE WHEN "group"='people' THEN 'visitors' ELSE subgroup END AS type, CASE WHEN "group"='robots' THEN fam WHEN "group"='own' THEN ip WHEN "group"='bots' THEN fam WHEN "group"='people' THEN '' ELSE subgroup END AS suspect,
          ts // 60 AS minute, count(*) AS n, sum(bytes) AS b, count_if(NOT is_static) AS p FROM rg GROUP BY ALL)
        SELECT category, type, suspect, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(p) AS BIGINT) AS pages, CAST(sum(b) AS BIGINT) AS bytes, max(n) AS max_per_minute, round(sum(b)/(SELECT sum(bytes) FROM rg)*100,4) AS traffic_pct FROM l GROUP BY 1,2,3"""),
    "a27_people_load": sql("grouped", """, l AS (SELECT channel, ts // 60 AS minute, count(*) AS n, count_if(is_page) AS p, sum(bytes) AS b FROM rg WHERE "group"='people' GROUP BY 1,2)
        SELECT channel, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(p) AS BIGINT) AS pages, CAST(sum(b) AS BIGINT) AS bytes, max(p) AS max_pages_per_minute FROM l GROUP BY 1"""),
    "a28_mass_requests": sql("grouped", """, l AS (SELECT ip, ts // 60 AS minute, count_if(is_page) AS p, count(*) AS n, count_if(status IN (403,429,444)) AS d FROM rg GROUP BY 1,2)
        SELECT ip, max(p) AS max_pages, count_if(p>=2) AS minutes, min(minute) FILTER (WHERE p>=2) AS first_minute, max(minute) FILTER (WHERE p>=2) AS last_minute, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(d) AS BIGINT) AS refused FROM l GROUP BY 1 HAVING count_if(p>=2)>0"""),
    "a29_file_types": sql("grouped", """SELECT ext, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, round(count_if(status=304)/count(*),6) AS cached, round(avg(bytes),4) AS mean_bytes, round(sum(bytes)/(SELECT sum(bytes) FROM rg)*100,4) AS traffic_pct
        FROM rg WHERE is_static GROUP BY 1"""),
    "a29_heavy_files": sql("grouped", """SELECT base, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, round(avg(bytes),4) AS mean_bytes, count_if(ref_internal) AS from_site, min(day) AS first_day, max(day) AS last_day
        FROM rg WHERE is_static AND status=200 GROUP BY 1 ORDER BY bytes DESC, base LIMIT 200"""),
    "a30_hotlinks": sql("grouped", f"""SELECT ref_host, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT base) AS files, min(day) AS first_day, max(day) AS last_day,
        CASE WHEN regexp_full_match(ref_host,'[\\d.]+') THEN 'ip without a domain' WHEN regexp_matches(ref_host,'dev|test|stage|staging|demo|local') THEN 'looks like a test copy' ELSE 'external site' END AS verdict
        FROM rg WHERE ref_host<>'' AND NOT ref_internal AND ext IN {in_list(fv.MEDIA_EXTENSIONS)} AND status=200 AND NOT regexp_matches(ref_host,{lit(fv.REF_SEARCH)}) GROUP BY 1"""),
    "a31_parasites": sql("grouped", f""", d AS (SELECT tpl, query, count(*) AS n FROM rg WHERE is_page AND {SEARCH_OK} GROUP BY 1,2), b AS (SELECT tpl, count(*) AS variants, CAST(sum(n) AS BIGINT) AS requests FROM d GROUP BY 1 HAVING count(*)>=2),
        pr AS (SELECT DISTINCT tpl, pair FROM (SELECT tpl, unnest(string_split(query,'&')) AS pair FROM d) WHERE pair<>'')
        SELECT b.*, coalesce(guilty_keys,'') AS guilty_keys FROM b LEFT JOIN {TOP('tpl', "split_part(pair,'=',1)", 'guilty_keys', 3, 'pr')} t USING (tpl)"""),
    "a31_crawler_traps": sql("grouped", "SELECT tpl, count(DISTINCT query) AS variants FROM rg WHERE is_page AND \"group\"<>'people' GROUP BY 1 HAVING count(DISTINCT query)>=3"),
    "a32_admin_access": sql("grouped", _STAFF + """ SELECT ip, count(*) AS requests, count_if(status=200) AS ok, count_if(method='POST') AS posts, count(DISTINCT day) AS days, min(ts) AS first_ts, max(ts) AS last_ts, max(cc) AS cc, ip IN (SELECT ip FROM staff) AS staff
        FROM rg WHERE base LIKE '/admin/%' GROUP BY ip"""),
    "a33_service_sections": sql("grouped", _STAFF + """, x AS (SELECT *, regexp_extract(base,'^(/[^/?]*/?)',1) AS section FROM rg WHERE regexp_matches(base,'^/(admin|cart|go)/')),
        y AS (SELECT section, ip, count(*) AS n, count_if(status=200) AS ok, count_if(method='POST') AS posts, count_if(status=200 AND base<>section) AS inner_ok, ip IN (SELECT ip FROM staff) AS st FROM x GROUP BY 1,2)
        SELECT section, CAST(sum(n) AS BIGINT) AS requests, count(*) AS ips, CAST(sum(ok) AS BIGINT) AS ok, count_if(st) AS staff_ips, count_if(NOT st AND posts>0) AS failed_login_ips, count_if(NOT st AND posts=0 AND inner_ok>0) AS inside_without_login, sum(ok)>0 AS is_real FROM y GROUP BY 1"""),
    "a34_scanners": sql("grouped", _PR + f""" SELECT {_TG} AS target, count(*) AS requests, count(DISTINCT ip) AS ips, count_if(status=200 AND bytes>0) AS served, count(DISTINCT ip) FILTER (WHERE status=200 AND bytes>0) AS ips_served, count(DISTINCT base) AS addresses
        FROM rg WHERE base IN (SELECT base FROM probes) GROUP BY 1"""),
    "a34_scanner_ips": sql("grouped", _PR + " SELECT ip, count(*) AS requests, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day, count_if(status=200) AS served FROM rg WHERE base IN (SELECT base FROM probes) GROUP BY 1"),
    "a35_leaks": sql("grouped", _PR + _STAFF + """, o AS (SELECT *, status=200 AND bytes>0 AS sv FROM rg WHERE ip NOT IN (SELECT ip FROM staff)),
        c AS (SELECT bytes // 100 AS size, count(DISTINCT base) AS a FROM o WHERE sv AND base NOT IN (SELECT base FROM probes) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
        f AS (SELECT base, count_if(sv) AS served, count(DISTINCT ip) FILTER (WHERE sv) AS ips, median(bytes) FILTER (WHERE sv) AS size_typical, min(bytes) FILTER (WHERE sv) AS mn, max(bytes) FILTER (WHERE sv) AS mx, min(day) FILTER (WHERE sv) AS first_day,
          max(day) FILTER (WHERE sv) AS last_day, arg_max(sv,(ts,req_id)) AS open_at_last_request FROM o WHERE base IN (SELECT base FROM probes) GROUP BY 1 HAVING count_if(sv)>0)
        SELECT base, served, ips, size_typical, first_day, last_day, open_at_last_request, CASE WHEN regexp_matches(base,'(?i)\\.(php\\d?|phtml|asp|aspx|jsp|cgi)$') THEN 'executed, content unknown' WHEN floor(size_typical/100) IN (SELECT size FROM c) THEN 'stub: common page size'
          WHEN size_typical<20 THEN 'stub: almost empty' WHEN mx>3*mn THEN 'varies: not a file' ELSE 'check' END AS verdict FROM f"""),
    "a36_attacks": sql("grouped", _A + """, nb AS (SELECT DISTINCT base, bytes FROM atk WHERE attack IS NULL AND status=200), hs AS (SELECT * FROM atk WHERE attack IS NOT NULL),
        x AS (SELECT *, status=200 AND NOT EXISTS (SELECT 1 FROM nb WHERE nb.base=hs.base AND abs(nb.bytes-hs.bytes)<=greatest(200,0.02*hs.bytes)) AS odd FROM hs),
        t AS (SELECT base, attack, arg_min(ip,(-n,ip)) AS top_ip FROM (SELECT base, attack, ip, count(*) AS n FROM hs GROUP BY 1,2,3) GROUP BY 1,2)
        SELECT x.base, x.attack, count(*) AS requests, count(DISTINCT ip) AS ips, count_if(status=200) AS served, count_if(status>=500) AS e5, min(ts) AS first_ts, max(ts) AS last_ts, any_value(top_ip) AS top_ip, count_if(odd) AS unusual
        FROM x JOIN t ON t.base=x.base AND t.attack=x.attack GROUP BY 1,2"""),
    "a37_webshells": sql("grouped", f"SELECT base, count(*) AS requests, count_if(status=200) AS ok, count(DISTINCT ip) AS ips, max(day) AS last_day FROM rg WHERE regexp_matches(base,{lit(S.EXECUTABLE_UPLOAD)}) GROUP BY 1"),
    "a39_open_redirects": sql("grouped", f"""SELECT base, count(*) AS requests, count(DISTINCT ip) AS ips, count(DISTINCT query) AS links FROM rg a WHERE base LIKE '/go/%' AND status BETWEEN 300 AND 399 AND {_EXT}
        AND NOT EXISTS (SELECT 1 FROM rg b WHERE b.base=a.base AND b.bytes=a.bytes AND b.status BETWEEN 300 AND 399 AND NOT (b.query LIKE 'url=https%3A%2F%2Fevil.example%' OR b.query LIKE 'url=http://169.254%')) GROUP BY 1"""),
    "a40_tokens": sql("grouped", f"""SELECT base, 'token' AS param, count(*) AS requests, count_if("group"='own') AS own, count_if("group"<>'own') AS outsiders, count_if({SEARCH_OK}) AS search, min(ts) AS first_ts, max(ts) AS last_ts FROM rg WHERE contains(query,'&token=') GROUP BY 1"""),
    "a41_server_filter": sql("grouped", f""", bz AS (SELECT DISTINCT vid FROM rg WHERE "group"='people' AND is_page AND status=200),
        x AS (SELECT *, CASE WHEN "group"='people' THEN 'people' WHEN {SEARCH_OK} THEN 'search robots' ELSE 'ad checkers' END AS filter_group, CASE WHEN "group"='people' THEN 'people' ELSE fam END AS who FROM rg
          WHERE ("group"='people' AND vid IN (SELECT vid FROM bz)) OR ("group"<>'people' AND ({SEARCH_OK} OR (fam IN ('YaDirectFetcher','AdsBot-Google') AND fam_verified='yes')))),
        t AS (SELECT who, count(*) AS total FROM x GROUP BY 1)
        SELECT filter_group, who, status, nettype, cc, count(*) AS answers, count(DISTINCT day) AS days, round(count(*)/any_value(total)*100,4) AS pct FROM x JOIN t USING (who)
        WHERE status IN (403,429,444,503) AND NOT {VULN} AND NOT regexp_matches(base,{lit(S.FOLDER_PROBE)}) GROUP BY 1,2,3,4,5"""),
    "a42_methods": sql("grouped", "SELECT method AS kind, count(*) AS requests, count(DISTINCT ip) AS ips, count_if(status BETWEEN 200 AND 299) AS accepted, min(ts) AS first_ts, max(ts) AS last_ts FROM rg GROUP BY 1"),
    "a43_security_journal": sql("grouped", _PR + f""", d AS (SELECT day, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, {_gsum}, count_if(base IN (SELECT base FROM probes)) AS probes FROM rg GROUP BY 1),
        m AS (SELECT day, max(n) AS peak FROM (SELECT day, ts // 60, count(*) AS n FROM rg GROUP BY 1,2) GROUP BY 1) SELECT d.*, peak FROM d JOIN m USING (day)"""),
    "a44_robot_families": sql("grouped", f""", f AS (SELECT fam, fam_cat, count(*) AS requests, count(DISTINCT ip) AS ips, count(DISTINCT day) AS days, CAST(sum(bytes) AS BIGINT) AS bytes, {_pct('status=200')} AS ok_pct, count_if(status=404) AS n_404, count_if(status>=500) AS n_5xx,
        {_pct("fam_verified='yes'")} AS genuine_pct FROM rg WHERE fam<>'' GROUP BY 1,2) SELECT f.*, looks_at FROM f JOIN {TOP('fam', "regexp_extract(base,'^(/[^/?]*/?)',1)", 'looks_at', 3, 'rg', "fam<>''")} t USING (fam)"""),
    "a44_robot_networks": sql("grouped", "SELECT fam, asn, count(*) AS requests, count(DISTINCT ip) AS ips FROM rg WHERE fam<>'' GROUP BY 1,2"),
    "a45_monitors": sql("grouped", f""", m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY subgroup, ip ORDER BY ts) AS gap FROM (SELECT DISTINCT subgroup, ip, ts FROM rg WHERE "group"='monitors')), i AS (SELECT subgroup, ip, median(gap) AS g FROM m GROUP BY 1,2), j AS (SELECT subgroup, median(g) AS "interval" FROM i GROUP BY 1),
        b AS (SELECT subgroup, count(*) AS checks, count(DISTINCT ip) AS ips, CAST(sum(bytes) AS BIGINT) AS bytes, count_if(status IN (403,429,444,503)) AS refused, round(count_if(status IN (403,429,444,503))/count(*),6) AS refused_share FROM rg WHERE "group"='monitors' GROUP BY 1)
        SELECT b.*, j."interval", checks_what FROM b JOIN j USING (subgroup) JOIN {TOP('subgroup', 'base', 'checks_what', 2, 'rg', chr(34) + 'group' + chr(34) + "='monitors'")} t USING (subgroup)"""),
    "a46_fakes": sql("visits", "SELECT ip, min(fam) AS posed_as, CAST(sum(n_req) AS BIGINT) AS requests, count(*) AS visits, min(cc) AS cc, min(nettype) AS nettype, min(day) AS first_day, max(day) AS last_day FROM vs WHERE subgroup='fake robots' GROUP BY ip"),
    "a46_bot_classes": sql("visits", """, x AS (SELECT *, CASE WHEN starts_with(subgroup,'form spam') THEN subgroup WHEN n_pages>=10 AND n_static=0 THEN 'page parser' WHEN regexp_matches(ua,'HeadlessChrome|Puppeteer|Playwright|PhantomJS|Lightpanda') THEN 'headless'
        WHEN subgroup='masked: loads no resources' THEN 'loads no resources' END AS class FROM vs WHERE "group"='bots' OR ("group"='people' AND n_goal>0))
        SELECT class, count(*) AS visits, count(DISTINCT ip) AS ips, CAST(sum(n_goal) AS BIGINT) AS sent, CAST(sum(n_conv) AS BIGINT) AS accepted FROM x WHERE class IS NOT NULL GROUP BY 1"""),
    "a46_bot_signatures": sql("visits", f""", b AS (SELECT * FROM vs WHERE "group"='bots'), a AS (SELECT subgroup, count(*) AS visits, count(DISTINCT ip) AS ips, count(DISTINCT asn) AS networks, count(DISTINCT day) AS days, CAST(sum(n_goal) AS BIGINT) AS sent FROM b GROUP BY 1)
        SELECT a.*, top_network, top_entry FROM a JOIN {TOP('subgroup', 'nettype', 'top_network', 1, 'b')} t USING (subgroup) JOIN {TOP('subgroup', 'entry', 'top_entry', 1, 'b')} u USING (subgroup)"""),
    "a48_bot_networks": sql("visits", """SELECT asn, nettype, count(*) AS visits, count(DISTINCT ip) AS ips, CASE WHEN starts_with(nettype,'data center') THEN 'can be blocked by subnet' WHEN nettype='vpn/proxy relay' THEN 'by behaviour only' WHEN nettype='mobile operator' THEN 'do not block'
        WHEN nettype='RU access provider' THEN 'by behaviour only' WHEN nettype='foreign access provider' THEN 'by the audience of the site' ELSE 'depends' END AS advice FROM vs WHERE "group"='bots' GROUP BY 1,2"""),
    "a48_check_ips": sql("visits", """, l AS (SELECT concat('10.1.0.', CAST(i AS VARCHAR)) AS ip FROM range(1,21) t(i))
        SELECT l.ip, count(vid) AS visits, CAST(coalesce(sum(n_req),0) AS BIGINT) AS requests, CAST(coalesce(sum(n_goal),0) AS BIGINT) AS sent, CAST(coalesce(sum(n_conv),0) AS BIGINT) AS accepted, count(DISTINCT "group") AS groups, count(vid)>0 AS in_log FROM l LEFT JOIN vs USING (ip) GROUP BY 1"""),
    "a49_ai_robots": sql("grouped", f"SELECT fam_cat, fam, count(*) AS requests, count(DISTINCT ip) AS ips, count(DISTINCT day) AS days, CAST(sum(bytes) AS BIGINT) AS bytes, count_if(status>=400) AS errors, {_pct(chr(39).join(['fam_verified=', 'yes', '']))} AS genuine_pct FROM rg WHERE fam_cat LIKE 'AI %' GROUP BY 1,2"),
    "a49_ai_pages": sql("grouped", "SELECT base, fam, count(*) AS requests, count(DISTINCT day) AS days FROM rg WHERE fam_cat='AI training' GROUP BY 1,2"),
    "a50_audience": sql("visits", "SELECT cc, count(*) AS visits, count(DISTINCT ip) AS ips, round(count(*)/sum(count(*)) OVER ()*100,4) AS share_pct, cc='RU' AS is_main FROM vs WHERE \"group\"='people' GROUP BY cc"),
    "a50_staff_activity": sql("grouped", _STAFF + """ SELECT ip, count(*) AS visits, CAST(sum(n_req) AS BIGINT) AS requests, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day, CAST(sum(n_goal) AS BIGINT) AS sent,
        (SELECT count(*) FROM rg WHERE rg.ip=vs.ip AND base LIKE '/admin/%') AS admin_requests FROM vs WHERE ip IN (SELECT ip FROM staff) GROUP BY ip"""),
    "a51_bot_journal": sql("visits", """, b AS (SELECT * FROM vs WHERE "group"='bots'), f AS (SELECT ip, min(day) AS fd FROM b GROUP BY 1)
        SELECT day, count(*) AS visits, count(DISTINCT ip) AS ips, count(DISTINCT ip) FILTER (WHERE day=fd) AS new_ips, count_if(channel='ads') AS ad_visits, CAST(sum(n_goal) AS BIGINT) AS sent FROM b JOIN f USING (ip) GROUP BY 1"""),
    "r19_utilities": sql("grouped", _PR + _STAFF + """, u AS (SELECT rg.*, adr.probe<>'' AS isp, adr.existence='live' AS isl FROM rg JOIN adr USING (base) WHERE "group"='utilities'),
        c AS (SELECT subgroup, ip, count(*) AS n, count_if(isp) AS probes, count_if(isl) AS live, count(DISTINCT day) AS days FROM u GROUP BY 1,2), t AS (SELECT subgroup, ip, max(k) AS top FROM (SELECT subgroup, ip, base, count(*) AS k FROM u GROUP BY 1,2,3) GROUP BY 1,2),
        v AS (SELECT *, CASE WHEN ip IN (SELECT ip FROM staff) THEN 'own' WHEN probes>=3 OR probes/n>=0.2 THEN 'scanner' WHEN top/n>=0.8 AND days>=3 THEN 'integration' WHEN n<=300 AND live/n>=0.8 THEN 'developer or check' ELSE 'unclear' END AS verdict FROM c JOIN t USING (subgroup, ip))
        SELECT subgroup, verdict, count(*) AS ips, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(probes) AS BIGINT) AS probes FROM v GROUP BY 1,2"""),
    "a62_crawl": sql("grouped", f"""SELECT fam, count(*) AS requests, count_if(is_page) AS pages, count(DISTINCT base) FILTER (WHERE is_page) AS addresses, {_pct('status BETWEEN 200 AND 299')} AS ok_pct, {_pct('status BETWEEN 300 AND 399')} AS redirect_pct,
        {_pct('status BETWEEN 400 AND 499')} AS e4_pct, {_pct('status>=500')} AS e5_pct, CAST(sum(bytes) AS BIGINT) AS bytes, max(day) AS last_day, {_pct("status>=300 OR (is_page AND query<>'')")} AS wasted_pct, {_pct('status>=300')} AS missed_pct FROM rg WHERE {_GEN} GROUP BY 1"""),
    "a62_crawl_sections": sql("grouped", f"""SELECT regexp_extract(base,'^(/[^/?]*/?)',1) AS section, count(*) AS requests, count_if({_ENG}='Yandex') AS yandex, count_if({_ENG}='Google') AS google, count_if({_ENG}='Bing') AS bing, count_if({_ENG}='other') AS other,
        {_pct('status>=400')} AS errors_pct FROM rg WHERE {_GEN} AND is_page GROUP BY 1"""),
    "j09_redirect_outcome": sql("grouped", _OUT + " SELECT * FROM oc"),
    "a63_robot_files": sql("grouped", _OUT + f""", b AS (SELECT base, count(*) AS requests, count_if({_GEN}) AS search, arg_max(status,(ts,req_id)) AS last_status, count_if(status BETWEEN 300 AND 399) AS redirects, count_if(status>=400) AS errors FROM rg WHERE {_RF} GROUP BY 1),
        o AS (SELECT base, count_if(outcome='') AS bad_redirects, count_if(outcome='denied') AS denied_redirects FROM oc GROUP BY 1)
        SELECT b.*, coalesce(bad_redirects,0) AS bad_redirects, coalesce(denied_redirects,0) AS denied_redirects, CASE WHEN errors/requests>=0.5 THEN 'does not answer' WHEN coalesce(bad_redirects,0)/requests>=0.5 THEN 'answers by redirect' ELSE 'answers' END AS verdict
        FROM b LEFT JOIN o USING (base) WHERE search>0 OR requests>=20"""),
    "a63_search_redirects": sql("grouped", f""", s AS (SELECT * FROM rg WHERE {_GEN} AND status BETWEEN 300 AND 399) SELECT b.*, robots FROM (SELECT base, count(*) AS redirects FROM s GROUP BY 1) b JOIN {TOP('base', 'fam', 'robots', 3, 's')} t USING (base)"""),
    "a64_authenticity": sql("visits", f"""SELECT fam, count(DISTINCT ip) AS ips, count(DISTINCT ip) FILTER (WHERE fam_verified='yes') AS genuine_ips, count(DISTINCT ip) FILTER (WHERE fam_verified='no') AS fake_ips, CAST(sum(n_req) AS BIGINT) AS requests,
        CAST(coalesce(sum(n_req) FILTER (WHERE fam_verified='no'),0) AS BIGINT) AS fake_requests, bool_or(fam_verified<>'') AS can_be_checked, round(coalesce(sum(n_req) FILTER (WHERE fam_verified='no'),0)/greatest(sum(n_req),1)*100,4) AS fake_pct FROM vs WHERE fam_cat='{fv.SEARCH}' GROUP BY 1"""),
    "a64_seo_journal": sql("grouped", f""", r AS (SELECT day, count_if({_ENG}='Yandex') AS yandex, count_if({_ENG}='Google') AS google, count_if({_ENG} NOT IN ('Yandex','Google')) AS other, count_if(status BETWEEN 300 AND 399) AS redirects, count_if(status BETWEEN 400 AND 499) AS e4, count_if(status>=500) AS e5 FROM rg WHERE {_GEN} GROUP BY 1),
        p AS (SELECT day, count(*) AS search_visits, CAST(sum(n_conv) AS BIGINT) AS search_leads FROM vs WHERE "group"='people' AND channel='search' GROUP BY 1)
        SELECT day, coalesce(yandex,0) AS yandex, coalesce(google,0) AS google, coalesce(other,0) AS other, coalesce(redirects,0) AS redirects, coalesce(e4,0) AS e4, coalesce(e5,0) AS e5, coalesce(search_visits,0) AS search_visits, coalesce(search_leads,0) AS search_leads FROM r FULL JOIN p USING (day)"""),
    "j14_uncrawled": sql("grouped", registry("rg") + f""", p AS (SELECT base, count(DISTINCT vid) AS n FROM rg WHERE is_page AND "group"='people' AND status=200 GROUP BY 1), r AS (SELECT base, count(*) AS n FROM rg WHERE is_page AND {_GEN} GROUP BY 1)
        SELECT base, n, 'people only' AS kind FROM p WHERE n>=1 AND NOT regexp_matches(base,{lit(seo.NOT_PAGE)}) AND base IN (SELECT base FROM adr WHERE for_people AND probe<>'strong') AND base NOT IN (SELECT base FROM r)
        UNION ALL SELECT base, n, 'robots only' FROM r WHERE base NOT IN (SELECT base FROM p)"""),
}
