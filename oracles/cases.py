"""Check queries for bounded time joins, cases, findings, rules and exports."""

from oracles.errors import TOP, _T5, _broken, registry
from oracles.prelude import ERROR_LINES, in_list, lit, sql
from oracles.security import _A, _PR, _STAFF
from oracles.errors import _ETYPE
from oracles.series import OUTAGES
from weblens.marts import security as S
from weblens.rules import cases as K

_ST = "CASE WHEN status<300 OR status=304 THEN 'works' WHEN status<400 THEN 'redirect' WHEN status IN (404,410) THEN 'missing' WHEN status<500 THEN 'refused' ELSE 'server error' END"
_HIST = OUTAGES + f""", bd AS (SELECT DISTINCT base FROM rg WHERE status>=400 AND status<>499),
h1 AS (SELECT base, day, CASE WHEN status>=500 AND EXISTS (SELECT 1 FROM outages WHERE ts // 60 BETWEEN degraded_from // 60 AND degraded_to // 60) THEN 'server error in outage' ELSE {_ST} END AS state,
  "group" IN ('people','own') OR (fam_verified='yes' AND fam_cat='search engine') AS own FROM rg WHERE status<>499 AND base IN (SELECT base FROM bd)),
h2 AS (SELECT *, bool_or(own) OVER (PARTITION BY base) AS ho FROM h1), h3 AS (SELECT base, day, state, count(*) AS n FROM h2 WHERE own OR NOT ho GROUP BY 1,2,3),
h4 AS (SELECT base, day, arg_min(state,(-n,state)) AS state FROM h3 GROUP BY 1,2),
h5 AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY base ORDER BY day)=state THEN 0 ELSE 1 END AS nw FROM h4), h6 AS (SELECT *, sum(nw) OVER (PARTITION BY base ORDER BY day) AS run FROM h5),
h7 AS (SELECT base, CAST(run AS BIGINT) AS run, state, min(day) AS a, max(day) AS b FROM h6 GROUP BY 1,2,3)
SELECT base, string_agg(concat(state,' ',CAST(a AS VARCHAR),CASE WHEN a<>b THEN concat('..',CAST(b AS VARCHAR)) ELSE '' END),' -> ' ORDER BY run) AS history, arg_max(state,run) AS last_state, max(b) AS last_day, max(run) AS runs,
  arg_max(state,run) IN ('refused','missing','server error','server error in outage') AND max(b) >= (SELECT max(day) - CAST(greatest(2, round(count(DISTINCT day)*0.1))-1 AS INT) FROM rg) AS is_actual FROM h7 GROUP BY base"""
_STEPS = """, q AS (SELECT *, coalesce(sum(CAST(is_page AS INT)) OVER (PARTITION BY vid ORDER BY ts, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pno FROM rg),
sq AS (SELECT DISTINCT a.vid FROM q a JOIN q b ON a.vid=b.vid AND (b.ts,b.req_id)>(a.ts,a.req_id) JOIN q c ON c.vid=b.vid AND (c.ts,c.req_id)>(b.ts,b.req_id)
  WHERE a.base LIKE '/catalog/%' AND a.is_page AND a.pno=0 AND b.base='/contacts/send/' AND b.ts-a.ts<=60 AND b.pno-a.pno-1<=1 AND c.base='/thanks/' AND c.ts-b.ts<=10)"""
_HITS = _STEPS + """, hits AS (
 SELECT 'env_probe' AS sig, ip AS key, ip, count(*) AS requests, min(ts) AS "start", max(ts) AS "end" FROM rg WHERE regexp_matches(base,'^/\\.(env|git)') AND method<>'POST' GROUP BY ip, day
 UNION ALL SELECT 'cloud_errors', ip, ip, count(*), min(ts), max(ts) FROM rg WHERE asn IN (24940,15169) AND (status>=500 OR status=403) AND NOT is_static GROUP BY ip, day
 UNION ALL SELECT 'busy_hour', concat(ip,'|',ua), ip, count(*), min(ts), max(ts) FROM rg WHERE is_page GROUP BY ip, ua, day, hour HAVING count(*)>=3 AND count(DISTINCT base)>=2
 UNION ALL SELECT 'busy_day', ip, ip, count(*), min(ts), max(ts) FROM (SELECT *, count(*) OVER (PARTITION BY ip, day ORDER BY ts RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS dn FROM rg WHERE ip LIKE '10.1.%' OR ip LIKE '10.3.%') GROUP BY ip, day HAVING max(dn)>=5 AND max(ts)-min(ts)>3600
 UNION ALL SELECT 'form_after_item', any_value(ip), any_value(ip), count(*), min(ts), max(ts) FROM rg WHERE vid IN (SELECT vid FROM sq) GROUP BY vid HAVING count_if(is_static)>=1)"""
_LEAK = """, o AS (SELECT *, status=200 AND bytes>0 AS sv FROM rg WHERE ip NOT IN (SELECT ip FROM staff)), lc AS (SELECT bytes // 100 AS size, count(DISTINCT base) AS a FROM o WHERE sv AND base NOT IN (SELECT base FROM probes) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
lf AS (SELECT base, median(bytes) FILTER (WHERE sv) AS t, min(bytes) FILTER (WHERE sv) AS mn, max(bytes) FILTER (WHERE sv) AS mx FROM o WHERE base IN (SELECT base FROM probes) GROUP BY 1 HAVING count_if(sv)>0),
leak AS (SELECT base FROM lf WHERE regexp_matches(base,'(?i)\\.(php\\d?|phtml|asp|aspx|jsp|cgi)$') OR NOT (floor(t/100) IN (SELECT size FROM lc) OR t<20 OR mx>3*mn))"""
_c = lambda cond: f"count_if({cond})"
_FEAT = _PR + _STAFF + _A + _LEAK + f""", fm AS (SELECT ip, max(p) AS maxpm FROM (SELECT ip, ts // 60 AS m, count_if(is_page) AS p FROM rg GROUP BY 1,2) GROUP BY 1),
fr AS (SELECT ip, count(*) AS req, {_c('is_page')} AS pages, {_c('base IN (SELECT base FROM probes)')} AS probes, {_c('base IN (SELECT base FROM leak) AND status=200 AND bytes>0')} AS leaks, {_c('attack IS NOT NULL')} AS attacks,
  {_c('attack IS NOT NULL AND status>=500')} AS attacks500, {_c("method NOT IN ('GET','POST','HEAD')")} AS odd, {_c(f'regexp_matches(base,{lit(K.ADMIN)})')} AS admin, {_c(f"regexp_matches(base,{lit(K.LOGIN)}) AND method='POST'")} AS login_post,
  {_c('status>=500')} AS e5, CAST(sum(bytes) AS BIGINT) AS bytes, {_c("ua IN ('','-')")} AS noua FROM atk GROUP BY ip),
fv AS (SELECT ip, CAST(coalesce(sum(n_goal) FILTER (WHERE "group"='bots'),0) AS BIGINT) AS forms, CAST(coalesce(sum(n_conv) FILTER (WHERE "group"='bots'),0) AS BIGINT) AS accepted, count_if("group"='bots' AND channel='ads') AS ad_visits,
  count_if(subgroup='scheduled recon') AS sched, CAST(coalesce(sum(n_req) FILTER (WHERE starts_with(subgroup,'masked')),0) AS BIGINT) AS mask FROM vs GROUP BY ip),
feat AS (SELECT * FROM fr JOIN fm USING (ip) JOIN fv USING (ip))"""
_KEY = """, pb AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY n_req DESC, vid DESC) AS k FROM vs),
pk AS (SELECT ip, "group", nettype, CASE WHEN subgroup='fake robots' THEN 'fake:' || fam WHEN "group"='utilities' THEN 'util:' || subgroup || '|' || nettype WHEN "group"='robots' THEN 'robot:' || fam || '|' || nettype WHEN "group"='people' THEN 'human|' || nettype
  ELSE 'bot:' || split_part(subgroup,':',1) || '|' || nettype END AS case_key FROM pb WHERE k=1)"""
_EL = f"""{ERROR_LINES}, et AS (SELECT *, {_ETYPE} AS type FROM el)"""
_FIND = OUTAGES.rstrip() + f""", et AS (SELECT *, {_ETYPE} AS type FROM el){_T5('tpl')},
fnd AS (SELECT 'errors:outage:' || CAST(peak_from AS VARCHAR) AS key, 'errors' AS block, 'outage' AS type, CAST(peak_from AS VARCHAR) AS object, 'urgent' AS severity, cause AS facts, CAST(pages_5xx AS DOUBLE) AS metric FROM outages WHERE peak_minutes>=2 AND pages_5xx>=10
 UNION ALL SELECT 'errors:5xx:' || tpl, 'errors', '5xx', tpl, CASE WHEN human_errors>=20 THEN 'urgent' ELSE 'important' END, '', human_errors FROM t5 WHERE human_errors>=5
 UNION ALL SELECT 'errors:404_entry:' || channel, 'errors', '404_entry', channel, CASE WHEN channel='ads' THEN 'urgent' ELSE 'important' END, '', count(*) FROM vs WHERE "group"='people' AND entry_status=404 AND channel IN ('ads','maps','search','social','ai assistants','aggregators') GROUP BY channel HAVING count(*)>=3
 UNION ALL SELECT 'errors:broken_links:site', 'errors', 'broken_links', 'site', 'important', '', sum(v) FROM (SELECT tpl, count(DISTINCT vid) AS v FROM rg WHERE ref_internal AND {_broken(False)} GROUP BY tpl) HAVING sum(v)>=10
 UNION ALL SELECT 'errors:errlog:' || type, 'errors', 'errlog', type, CASE WHEN type='PHP Fatal' THEN 'important' ELSE 'urgent' END, '', count(*) FROM et WHERE type IN ('database','disk full','PHP Fatal') GROUP BY type
 UNION ALL SELECT 'security:webshell:' || base, 'security', 'webshell', base, 'urgent', '', count_if(status=200) FROM rg WHERE regexp_matches(base,{lit(S.EXECUTABLE_UPLOAD)}) GROUP BY base HAVING count_if(status=200)>0
 UNION ALL SELECT 'security:heavy_images:' || base, 'security', 'heavy_images', base, 'important', '', sum(bytes) FROM rg WHERE is_static AND status=200 GROUP BY base HAVING avg(bytes)>512000
 UNION ALL SELECT 'overview:bot_leads:all', 'overview', 'bot_leads', 'all', 'urgent', '', count(*) FROM rg WHERE goal_success AND "group"='bots' HAVING count(*)>0
 UNION ALL SELECT 'bots:fake_crawlers:all', 'bots', 'fake_crawlers', 'all', 'important', '', count(DISTINCT ip) FROM vs WHERE subgroup='fake robots' HAVING count(*)>0
 UNION ALL SELECT 'marketing:ad_landing_errors:all', 'marketing', 'ad_landing_errors', 'all', 'urgent', '', count(*) FROM vs WHERE "group"='people' AND channel='ads' AND entry_status>=400 HAVING count(*)>0)"""

SQL = {
    "j11_neighbours": sql("visits", """SELECT DISTINCT f.vid FROM vs f JOIN vs p ON p.ip=f.ip AND p."start"<=f."end"+36000 AND p."end">=f."start"-36000 WHERE f.n_pages=0 AND f.n_static>0 AND p."group"='people' AND p.n_pages>0"""),
    "j12_lost_orders": sql("grouped", """SELECT req_id, ip, ts, status, CASE WHEN EXISTS (SELECT 1 FROM rg o WHERE o.base LIKE '/cart/success/%' AND o.ip=e.ip AND o.ts>e.ts AND o.ts<=e.ts+10800) THEN 'recovered' ELSE 'lost' END AS outcome
        FROM rg e WHERE base LIKE '/cart/checkout/%' AND "group"='people' AND status>=400 AND status<>499"""),
    "j15_in_outages": sql("grouped", OUTAGES + """ SELECT degraded_from, count(*) AS requests, count_if(status>=500) AS e5, count(DISTINCT vid) FILTER (WHERE "group"='people') AS people_visits, count(DISTINCT vid) FILTER (WHERE "group"='people' AND channel='ads') AS ad_visits
        FROM outages JOIN rg ON ts BETWEEN degraded_from AND degraded_to GROUP BY 1"""),
    "j24_trace": sql("grouped", "SELECT CAST(x.req_id AS VARCHAR) AS name, r.req_id, r.ip, r.ts, r.method, r.base, r.status FROM rg x JOIN rg r ON r.ip=x.ip AND abs(r.ts-x.ts)<=60 WHERE x.base='/cart/success/'"),
    "w11_status_history": sql("grouped", _HIST),
    "w15_probe_tempo": sql("grouped", _PR + """, p AS (SELECT * FROM rg WHERE base IN (SELECT base FROM probes)), g AS (SELECT ip, ua, ts - lag(ts) OVER (PARTITION BY ip, ua ORDER BY ts) AS gap FROM p), m AS (SELECT ip, ua, median(gap) AS mg FROM g GROUP BY 1,2),
        a AS (SELECT base, count(DISTINCT ip) AS k FROM p GROUP BY 1), d AS (SELECT DISTINCT ip, ua, base FROM p) SELECT ip, ua, round(avg(CASE WHEN k>3 THEN 1.0 ELSE 0.0 END),6) AS shared, coalesce(any_value(mg),-1) AS median_gap FROM d JOIN a USING (base) JOIN m USING (ip, ua) GROUP BY 1,2"""),
    "w16_call_profile": sql("grouped", """, c AS (SELECT *, regexp_matches(base,'^/(contacts/send|cart/add|callback)/') AND method IN ('GET','POST') AS call FROM rg WHERE "group"='people'), d AS (SELECT * FROM c WHERE is_page OR call),
        e AS (SELECT *, max(CASE WHEN NOT call THEN ts*100000000+req_id END) OVER w AS pg, max(CASE WHEN call THEN ts END) OVER w AS pc FROM d WINDOW w AS (PARTITION BY vid ORDER BY ts, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, coalesce(ts - pg // 100000000 <= 45, false) AS bg FROM e WHERE call)
        SELECT base, count(*) AS calls, count_if(bg) AS background, count_if(NOT bg) AS extra, count_if(coalesce(ts-pc<=30,false)) AS in_burst, count(DISTINCT CASE WHEN bg THEN pg END) AS pages_followed, round(count(DISTINCT CASE WHEN bg THEN pg END)/(SELECT count(*) FROM d WHERE NOT call),6) AS share_of_pages FROM f GROUP BY base"""),
    "w17_spread_files": sql("grouped", """, d AS (SELECT base, count(*) OVER (PARTITION BY base ORDER BY ts RANGE BETWEEN CURRENT ROW AND 21600 FOLLOWING) AS n FROM rg WHERE is_static) SELECT base, max(n) AS peak, count(*) AS requests, max(n)<0.5*count(*) AS is_spread FROM d GROUP BY 1"""),
    "w18_list_crawl": sql("grouped", """, f AS (SELECT ip, ua, base, min(ts*100000000+req_id) AS o FROM rg WHERE is_static GROUP BY 1,2,3),
        d AS (SELECT *, coalesce(TRY_CAST(regexp_extract(base,'(\\d+)\\.[A-Za-z0-9]+$',1) AS BIGINT),-10) AS num, count(*) OVER (PARTITION BY ip, ua, regexp_replace(base,'[^/]*$','')) AS in_dir FROM f),
        s AS (SELECT *, num - lag(num) OVER (PARTITION BY ip, ua ORDER BY o) AS step FROM d)
        SELECT ip, ua, count(*) AS files, count_if(step=1) AS consecutive, max(in_dir) AS top_folder, count_if(step=1)/(count(*)-1)>=0.1 OR max(in_dir)/count(*)>=0.1 AS is_crawl FROM s GROUP BY 1,2 HAVING count(*)>=5"""),
    "w19_first_orders": sql("grouped", """, o AS (SELECT *, regexp_extract(query,'(?:^|&)order_id=([^&]+)',1) AS order_id FROM rg WHERE base LIKE '/cart/success/%' AND host_site), r AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, req_id) AS k FROM o WHERE order_id<>'')
        SELECT order_id, req_id, ts, status FROM r WHERE k=1"""),
    "w22_sequence": sql("grouped", _STEPS + " SELECT vid FROM sq"),
    "r16_order_steps": sql("grouped", "SELECT DISTINCT base, base LIKE '/cart/checkout/%' AS is_step, base LIKE '/admin/%' OR base LIKE '/cart/add/%' AS is_not_goal FROM rg"),
    "r25_signature_hits": sql("grouped", _HITS + " SELECT * FROM hits"),
    "r25_signature_summary": sql("grouped", _HITS + " SELECT sig, count(*) AS hits, count(DISTINCT ip) AS ips FROM hits GROUP BY 1"),
    "r20_ip_features": sql("grouped", _FEAT + " SELECT * FROM feat"),
    "j22_case_mates": sql("visits", _KEY + """, n AS (SELECT regexp_extract(ip,'^(\\d+\\.\\d+\\.\\d+)\\.\\d+$',1) AS subnet, case_key, count(*) AS ips FROM pk GROUP BY 1,2) SELECT * FROM (SELECT case_key, subnet, ips, count(*) OVER (PARTITION BY subnet) AS cases, CAST(sum(ips) OVER (PARTITION BY subnet) AS BIGINT) AS total_ips FROM n) WHERE cases>1"""),
    "r31_findings": sql("grouped", _FIND + " SELECT * FROM fnd"),
    "r28_alarms": sql("grouped", _FIND + registry("rg") + """, r AS (SELECT severity AS before_alarm, CASE WHEN type='webshell' THEN 'alarm' ELSE severity END AS severity FROM fnd) SELECT severity, before_alarm, count(*) AS n FROM r GROUP BY 1,2"""),
    "r30_proofs": sql("grouped", _FIND + ", p AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ts DESC, req_id DESC) AS k FROM rg WHERE status>=400) SELECT key, base, ts, ip, status FROM fnd JOIN p ON p.base=fnd.object WHERE k=1"),
    "j20_compare_runs": sql("visits", """, c AS (SELECT entry AS key, CAST(count(*) FILTER (WHERE day>=DATE '2024-01-16') AS DOUBLE) AS now, CAST(count(*) FILTER (WHERE day<DATE '2024-01-16') AS DOUBLE) AS was FROM vs WHERE "group"='people' AND entry_status=404 GROUP BY 1)
        SELECT key, nullif(was,0) AS was, nullif(now,0) AS now, CASE WHEN was=0 THEN 'new' WHEN now=0 THEN 'fixed' WHEN (now-was)/was>=0.3 THEN 'worse' WHEN (now-was)/was<=-0.3 THEN 'partly fixed' ELSE 'kept' END AS status FROM c"""),
    "j21_edits": sql("grouped", _FIND + """ SELECT key, block, type, object, CASE WHEN type='webshell' THEN 'important' ELSE severity END AS severity, CASE WHEN type='webshell' THEN 'checked by hand' ELSE facts END AS facts, metric FROM fnd WHERE type<>'heavy_images'
        UNION ALL SELECT key || ':copy', block, 'manual', object, 'remark', facts, metric FROM fnd WHERE type='errlog'"""),
    "p26_thresholds": sql("grouped", """, h AS (SELECT count(*) AS n FROM vs WHERE "group"='people'), r AS (SELECT count(*) AS n FROM rg) SELECT 'key_used_by_people' AS name, greatest(3, CAST(ceil(0.0002*n) AS BIGINT)) AS "limit" FROM h
        UNION ALL SELECT 'block_on_action', greatest(3, CAST(ceil(0.0005*n) AS BIGINT)) FROM h UNION ALL SELECT 'torn_key', greatest(10, CAST(ceil(0.0001*n) AS BIGINT)) FROM r"""),
    "s11_write_prepared": sql("grouped", "SELECT day, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM rg WHERE day>=DATE '2024-01-10' AND day<DATE '2024-01-13' GROUP BY 1"),
    "s12_big_csv": sql("visits", "SELECT vid, ip, n_req FROM vs"),
}
