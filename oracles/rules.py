"""Check queries for visit rules and interval joins."""

from oracles.errors import PROBE_RX, forms as _forms
from oracles.prelude import ERROR_LINES, in_list, lit, sql
from oracles.security import _STAFF
from weblens.functions import fixed_values as fv
from weblens.rules import scanners, special

_SIG = f""", ps AS (SELECT base, CASE WHEN regexp_matches(base,{lit(PROBE_RX['strong'])}) OR regexp_matches(url_decode(base),{lit(PROBE_RX['strong'])}) THEN 'strong' WHEN regexp_matches(base,{lit(PROBE_RX['weak'])}) OR regexp_matches(url_decode(base),{lit(PROBE_RX['weak'])}) THEN 'weak' ELSE '' END AS strength
  FROM (SELECT DISTINCT base FROM rg)),
x AS (SELECT rg.*, strength, NOT ref_internal OR ref_path=base AS chosen, status BETWEEN 400 AND 499 AS e4 FROM rg JOIN ps USING (base)),
g1 AS (SELECT vid, any_value(ip) AS ip, any_value(ua) AS ua, count_if(strength='strong') AS strong, count(DISTINCT base) FILTER (WHERE strength='weak' AND chosen AND e4) AS weak, count(DISTINCT base) FILTER (WHERE is_page AND chosen) AS pn,
  coalesce(bool_and(e4) FILTER (WHERE is_page AND chosen), false) AS pa FROM x GROUP BY vid),
g2 AS (SELECT ip, ua, count(DISTINCT base) FILTER (WHERE strength='weak' AND chosen AND e4) AS cweak, count(DISTINCT base) FILTER (WHERE is_page AND chosen) AS cn, coalesce(bool_and(e4) FILTER (WHERE is_page AND chosen), false) AS ca FROM x GROUP BY 1,2),
g3 AS (SELECT DISTINCT vid FROM (SELECT vid, regexp_extract(base,'/(\\.?[^/.]+)[^/]*$',1) AS stem, count(DISTINCT base) AS n FROM x WHERE e4 AND chosen AND contains(base,'.') AND regexp_extract(base,'/(\\.?[^/.]+)[^/]*$',1)<>'' GROUP BY 1,2) WHERE n>=3),
sg AS (SELECT vid, strong, CASE WHEN strong>0 THEN 0 WHEN weak>=3 OR cweak>=3 THEN 1 WHEN vid IN (SELECT vid FROM g3) THEN 2 WHEN pn>=5 AND pa THEN 3 WHEN cn>=5 AND ca THEN 4 END AS signature FROM g1 JOIN g2 USING (ip, ua))"""
_KIND = _SIG + f""", sus AS (SELECT * FROM vs WHERE "group"='people' AND vid IN (SELECT vid FROM sg WHERE signature IS NOT NULL)),
c AS (SELECT ip, ua, count(DISTINCT day) AS days FROM sus GROUP BY 1,2), cb AS (SELECT ip, count(DISTINCT ua) AS browsers FROM sus GROUP BY 1),
co AS (SELECT ip, ua, sum(n_req) AS req, sum(dur) AS dur, min(nettype) AS net, bool_or(ua_browser) AS br FROM vs JOIN c USING (ip, ua) GROUP BY 1,2),
cx AS (SELECT x.* FROM x JOIN c USING (ip, ua)),
ca AS (SELECT ip, ua, count_if(is_page AND status BETWEEN 200 AND 299 AND strength='') AS pages_ok, count_if(strength<>'') AS probes, count_if(is_static AND ref_internal) AS rendered FROM cx GROUP BY 1,2),
cg AS (SELECT ip, ua, median(gap) AS gap FROM (SELECT ip, ua, ts - lag(ts) OVER (PARTITION BY ip, ua ORDER BY ts) AS gap FROM cx WHERE strength<>'') GROUP BY 1,2),
cp AS (SELECT base, count(DISTINCT ip) AS askers FROM cx WHERE strength<>'' GROUP BY 1), cs AS (SELECT ip, ua, avg(CASE WHEN askers>3 THEN 1.0 ELSE 0.0 END) AS shared FROM (SELECT DISTINCT ip, ua, base FROM cx WHERE strength<>'') JOIN cp USING (base) GROUP BY 1,2),
ck AS (SELECT ip, ua, days, starts_with(net,'data center') AS dc, 2*CAST(rendered>=3 AS INT)+2*CAST(req/greatest(dur,1)<1 AS INT)+CAST(NOT starts_with(net,'data center') AND net<>'vpn/proxy relay' AS INT)+CAST(br AS INT)+CAST(pages_ok>0 AS INT) AS score,
  coalesce(gap<3,false) AS fast, coalesce(shared,0)>=0.5 AS common, browsers>3 AS rot, probes FROM c JOIN co USING (ip,ua) JOIN ca USING (ip,ua) LEFT JOIN cg USING (ip,ua) LEFT JOIN cs USING (ip,ua) JOIN cb USING (ip)),
kk AS (SELECT ip, ua, score, CASE WHEN score>=5 AND NOT dc AND NOT fast AND NOT common AND NOT rot AND probes<=10 THEN CASE WHEN days>=2 THEN {lit(scanners.REGULAR)} ELSE {lit(scanners.ONCE)} END ELSE {lit(scanners.SCANNER)} END AS kind FROM ck)"""
_names = "CASE signature " + " ".join(f"WHEN {i} THEN {lit(n)}" for i, n in enumerate(scanners.SIGNATURES)) + " END"
_SENS = f"regexp_matches(base,{lit('(?i)' + '|'.join(f'(?:{p})' for p in fv.SENSITIVE))})"
_ARCH = "regexp_matches(base,'(?i)\\.(zip|rar|7z|tar|tar\\.gz|tgz|gz|bz2|sql|dump|bak|wpress|jpa)(\\.\\d+)?$')"
_MOVE = f"regexp_matches(base,{lit('(?i)' + '|'.join(fv.TRANSFER))})"
_lab = lambda cond, g, s, src="vs": f"""SELECT vid, CASE WHEN {cond} THEN '{g}' ELSE "group" END AS "group", CASE WHEN {cond} THEN '{s}' ELSE subgroup END AS subgroup FROM {src}"""
_REN = """, rp AS (SELECT DISTINCT vid, base FROM rg WHERE NOT is_static AND method IN ('GET','HEAD')), rn AS (SELECT vid, count(*) AS rendered FROM rg WHERE is_static AND ref_internal AND EXISTS (SELECT 1 FROM rp WHERE rp.vid=rg.vid AND rp.base=rg.ref_path) GROUP BY vid)"""
_WK = f", wk AS (SELECT vid FROM rg GROUP BY vid HAVING bool_and(regexp_matches(base,{lit(fv.WELL_KNOWN_STANDARD)})))"
_path = "split_part(regexp_replace(entry_ref,'^https?://[^/]+',''),'?',1)"
_same = lambda cand, window=1800: f"""(SELECT DISTINCT c.vid FROM (SELECT vid, ip, ua, "start" AS t, {_path} AS path FROM {cand}) c JOIN (SELECT DISTINCT vid, base FROM rg) b ON b.base=c.path
  JOIN vs o ON o.vid=b.vid WHERE c.path NOT IN ('','/') AND o."group"='people' AND o.n_pages>0 AND o.ua=c.ua AND o.ip<>c.ip AND o."start"<=c.t AND o."end">=c.t-{window})"""
_switch = lambda cand: f"""(SELECT DISTINCT c.vid FROM (SELECT vid, ip, "start" AS t, {_path} AS path FROM {cand}) c JOIN vs e ON e.entry_status=404 AND e.entry=c.path AND e.ip<>c.ip AND e."start" BETWEEN c.t-7200 AND c.t)"""
_week = lambda cand, caught: f"""(SELECT DISTINCT q.vid FROM {cand} q JOIN {caught} k ON k.ip=q.ip AND abs(k."start"-q."start")<=604800)"""
_spam = [lit(s) for s in __import__("weblens.rules.forms", fromlist=["SPAM_SIGNS"]).SPAM_SIGNS]
_SPAM = f""", f0 AS (SELECT *, n_goal>0 AS g, entry_ref IN ('-','') AS direct FROM vs),
f1 AS (SELECT *, g AND entry_status=404 AND (direct OR (NOT entry_ref_internal AND NOT regexp_matches(entry_ref_host,{lit(fv.REF_SEARCH)}))) AND n_pages<=6 AS broken FROM f0),
f2 AS (SELECT *, g AND n_pages=0 AND NOT broken AS blind FROM f1), fc AS (SELECT * FROM f2 WHERE blind AND entry_ref_internal), fs AS (SELECT vid FROM {_same('fc')}),
f3 AS (SELECT *, CASE WHEN broken THEN 0 WHEN blind AND n_static=0 AND vid NOT IN (SELECT vid FROM fs) THEN 1 WHEN blind AND n_static>0 AND entry_ref_internal AND vid NOT IN (SELECT vid FROM fs) AND (starts_with(nettype,'data center') OR nettype='vpn/proxy relay') THEN 2
  WHEN g AND n_goal>=2 AND n_pages>=5 AND n_pages/greatest(dur,1)>0.4 THEN 3 END AS s FROM f2),
fw AS (SELECT * FROM f3 WHERE g AND entry_ref_internal AND s IS NULL), f4 AS (SELECT * REPLACE (CASE WHEN s IS NULL AND vid IN {_switch('fw')} THEN 4 ELSE s END AS s) FROM f3),
fq AS (SELECT * FROM f4 WHERE g AND direct AND n_pages<=2 AND dur<120 AND s IS NULL), fk AS (SELECT * FROM f4 WHERE s IS NOT NULL),
f5 AS (SELECT * REPLACE (CASE WHEN s IS NULL AND vid IN {_week('fq', 'fk')} THEN 5 ELSE s END AS s) FROM f4)"""
_MARK = "(regexp_matches(query,'(?i)(?:^|&)(success|formresult|result|sent|ok|status)=[^0&]|thank|spasibo|blagodar') OR regexp_matches(base,'(?i)thank|spasibo|blagodar'))"
_OPER = "CASE WHEN ip LIKE '10.2.0.%' AND CAST(split_part(ip,'.',4) AS INT) < 64 THEN 'office' WHEN ip LIKE '10.2.%' THEN 'regional' WHEN asn=24940 THEN 'hoster' WHEN asn=8359 THEN 'mobile' ELSE '' END"
_HOSTS = """, hd AS (SELECT vhost, count(*) AS requests, count_if(method='GET' AND NOT is_static AND status BETWEEN 200 AND 299) AS pages, CASE vhost WHEN 'site.ru' THEN 'site' WHEN 'shop.site.ru' THEN 'not site' WHEN '10.9.9.9' THEN 'ip' ELSE 'other domain' END AS kind FROM rg GROUP BY vhost)"""

_has = lambda words: f"x IN {in_list(words.split())}"
_any = lambda folders: "(" + " OR ".join(f"contains(l,{lit(f)})" for f in folders) + ")"
_kinds = "CASE " + " ".join(f"WHEN x IN {in_list(e)} THEN '{k}'" for k, e in fv.ASSET_KINDS.items()) + " END"
_named = lambda names: "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN {lit(t)} END" for c, t in names) + ")"
_FILES = _forms("rg") + f""",
k0 AS (SELECT base, form='page' AS page, lower(base) AS l, regexp_extract(lower(base),'([^/]*)$',1) AS lf FROM af),
k1 AS (SELECT *, CASE WHEN ends_with(lf,'.tar.gz') THEN 'tar.gz' ELSE regexp_extract(lf,'\\.([a-z0-9]{{1,10}})$',1) END AS x FROM k0),
k2 AS (SELECT *, {_has(" ".join(e for _, e in fv.DOWNLOADS))} OR ({_has(fv.DATA_EXTENSIONS)} AND {_any(fv.DATA_FOLDERS)} AND NOT {_any(fv.NOT_DATA_FOLDERS)}) AS dl FROM k1),
k AS (SELECT base, page, dl, regexp_matches(base,{lit('(?i)' + fv.SERVICE_FILES)}) AS svc, {_SENS} AS sens, {_has(fv.SOUND_AND_VIDEO)} AS av, {_has(fv.PHOTOS)} AS ph, x IN {in_list(fv.PAGE_ASSETS)} AS pa,
  {_kinds} AS kind, ({_has(fv.CONTENT_IMAGES)} OR dl) AND NOT regexp_matches(l,{lit(fv.DECORATION)}) AS content FROM k2),
r AS (SELECT rg.*, k.* EXCLUDE (base) FROM rg JOIN k USING (base)),
fl AS (SELECT vid, bool_or(page) AS hp, bool_or(NOT page AND NOT svc) AS hf, bool_or(sens) AS hs FROM r GROUP BY 1),
j AS (SELECT vs.* FROM vs JOIN fl USING (vid) WHERE "group"='people' AND NOT hp AND hf AND NOT hs AND n_post=0),
wp AS (SELECT vs.* FROM vs JOIN fl USING (vid) WHERE "group"='people' AND hp),
md AS (SELECT median(bytes) AS m FROM r JOIN fl USING (vid) WHERE hp AND kind='images' AND status=200 AND bytes>0),
f0 AS (SELECT r.*, ref NOT IN ('-','') AS hr, ref_host='other1.example' AS own, status IN (404,410) AS gone FROM r WHERE NOT svc AND vid IN (SELECT vid FROM j)),
f1 AS (SELECT *, hr AND ref_internal AND NOT own AS inn, hr AND NOT own AND NOT ref_internal AND regexp_matches(ref_host,{lit(fv.REF_SEARCH)}) AS se FROM f0),
f AS (SELECT *, hr AND NOT own AND NOT inn AND NOT se AS ext_, (dl AND status BETWEEN 200 AND 299) OR (av AND status=200) OR (ph AND status=200 AND bytes>5*(SELECT m FROM md) AND NOT se) AS taken FROM f1),
c4 AS (SELECT ip, ua, count_if(gone)>=5 AS many FROM f GROUP BY 1,2),
rp AS (SELECT DISTINCT ip, ua FROM (SELECT ip, ua, count(*) AS n FROM f WHERE status=200 GROUP BY ip, ua, base, day) WHERE n>=3),
l0 AS (SELECT ip, ua, base, min(ts*100000000+req_id) AS o FROM f WHERE status BETWEEN 200 AND 299 GROUP BY 1,2,3),
l1 AS (SELECT *, TRY_CAST(regexp_extract(base,'(\\d+)\\.[A-Za-z0-9]+$',1) AS BIGINT) AS num, regexp_replace(base,'[^/]*$','') AS dir FROM l0),
l2 AS (SELECT *, num - lag(num) OVER (PARTITION BY ip, ua ORDER BY o) AS step, count(*) OVER (PARTITION BY ip, ua, dir) AS in_dir FROM l1),
lc AS (SELECT ip, ua FROM l2 GROUP BY 1,2 HAVING count(*)>=10 AND (count_if(step=1)/(count(*)-1)>=0.8 OR max(in_dir)/count(*)>=0.8) AND (ip, ua) NOT IN (SELECT (ip, ua) FROM f WHERE pa)),
ff AS (SELECT vid, count(*) AS n, count_if(gone) AS ng, bool_or(status=403) AS refused, bool_or(taken) AS taken, bool_or(own) AS own, bool_or(inn) AS inn, bool_or(se) AS se, bool_or(ext_) AS ext_,
  count(DISTINCT ref)=1 AND bool_and(hr) AND count(DISTINCT kind)>=2 AND count(*)=count(DISTINCT base) AND max(ts)-min(ts)<=60 AS one FROM f GROUP BY 1),
s0 AS (SELECT vid, base, count(*) AS m FROM f WHERE content GROUP BY 1,2), s1 AS (SELECT vid, base FROM s0 JOIN ff USING (vid) WHERE m>=0.8*n),
s2 AS (SELECT f.base, f.ip, f.ts, count(*) OVER (PARTITION BY f.base ORDER BY f.ts RANGE BETWEEN CURRENT ROW AND 21600 FOLLOWING) AS dense FROM f JOIN s1 USING (vid, base)),
s3 AS (SELECT base FROM s2 GROUP BY 1 HAVING count(DISTINCT ip)>=20 AND max(dense)<0.5*count(*)),
fev AS (SELECT j.*, ff.* EXCLUDE (vid), EXISTS (SELECT 1 FROM wp WHERE wp.ip=j.ip AND wp."start"<=j."end"+1800 AND wp."end">=j."start"-1800) AS neighbours,
  j.ip IN (SELECT ip FROM wp GROUP BY 1 HAVING count(DISTINCT ua)>=3) AND j.hour>=9 AND j.hour<19 AND j.weekday<5 AS office, c4.many, (j.ip, j.ua) IN (SELECT (ip, ua) FROM rp) AS repeats,
  (j.ip, j.ua) IN (SELECT (ip, ua) FROM lc) AS crawl, j.vid IN (SELECT vid FROM s1 WHERE base IN (SELECT base FROM s3)) AS spread, starts_with(nettype,'data center') OR starts_with(nettype,'Yandex') AS server,
  nettype IN ('mobile operator','RU access provider','foreign access provider') AS home, regexp_matches(j.ua,'Windows 9[58]|Win 9x|Windows NT 4\\.0') OR coalesce(TRY_CAST(nullif(regexp_extract(j.ua,'(?:iPhone|CPU) OS (\\d+)_',1),'') AS INT)<7, false)
   OR coalesce(TRY_CAST(nullif(regexp_extract(j.ua,'Gecko/(20\\d\\d)\\d\\d\\d\\d\\b',1),'') AS INT) > (SELECT year(DATE '1970-01-01' + CAST(max("end") // 86400 AS INT)) FROM vs), false) AS imp
  FROM j JOIN ff USING (vid) JOIN c4 ON c4.ip=j.ip AND c4.ua=j.ua),
e2 AS (SELECT *, (imp OR crawl OR repeats OR many OR spread) AND NOT neighbours AS b, (neighbours OR office OR one) AND NOT (imp OR crawl OR repeats OR many OR spread OR server) AS p, ng>=1 AND ng>=0.8*n AS missing FROM fev),
e3 AS (SELECT vid, CASE WHEN imp AND ng=n THEN 'bots|files only: asks for files that do not exist' WHEN imp THEN 'bots|files only: scraper' WHEN own THEN 'own|own systems' WHEN neighbours THEN 'people|'
  WHEN taken THEN CASE WHEN p THEN 'people|took a document' WHEN crawl OR repeats THEN 'bots|files only: scraper' ELSE 'suspects|took a document' END WHEN se THEN 'people|from image search'
  WHEN missing THEN CASE WHEN p THEN 'people|old link' WHEN b THEN 'bots|files only: asks for files that do not exist' ELSE 'suspects|' END
  WHEN inn THEN CASE WHEN p THEN 'people|' WHEN b THEN 'bots|files only: scraper' ELSE 'suspects|' END
  WHEN ext_ THEN CASE WHEN p THEN 'people|hotlink' WHEN b THEN 'bots|files only: scraper' ELSE 'external_sites|hotlink' END
  WHEN p THEN 'people|opened a file by a direct link' WHEN b THEN 'bots|files only: scraper' ELSE 'suspects|' END AS v,
  {_named([("neighbours", "neighbours at the address"), ("office", "office: many browsers, working hours, weekdays"), ("one", "assets of one page"), ("home", "home or mobile network"), ("refused", "closed by the site (403)")])} AS ep,
  {_named([("imp", "impossible browser version"), ("crawl", "list crawl"), ("repeats", "repeats"), ("many", "many 404"), ("spread", "one file from many IPs"), ("server", "data center"), ("refused", "closed by the site (403)")])} AS eb FROM e2)
SELECT vs.vid, CASE WHEN v IS NULL THEN "group" ELSE split_part(v,'|',1) END AS "group", CASE WHEN v IS NULL THEN subgroup ELSE split_part(v,'|',2) END AS subgroup, coalesce(ep,'') AS evidence_people, coalesce(eb,'') AS evidence_bot
FROM vs LEFT JOIN e3 USING (vid)"""


class Rule(str):
    """A twin that also knows its own part, which the chain of rules repeats on the groups left by the rules before."""

    body: str


def rule(body: str) -> Rule:
    text = Rule(sql("rules", body))
    text.body = body
    return text


SQL = {
    "r06_files_only": rule(_FILES),
    "r03_signatures": rule(_SIG + " SELECT vid, signature, strong FROM sg WHERE signature IS NOT NULL"),
    "r03_mark_scanners": rule(_KIND + f""" SELECT vid, CASE WHEN m THEN 'bots' ELSE "group" END AS "group", CASE WHEN m THEN concat(CASE WHEN strong>=10 THEN {lit(scanners.SCANNER)} ELSE kind END, ': ', nm) ELSE subgroup END AS subgroup
        FROM (SELECT vs.vid, vs."group", subgroup, strong, kind, {_names} AS nm, signature IS NOT NULL AND vs."group"='people' AS m FROM vs LEFT JOIN sg USING (vid) LEFT JOIN kk USING (ip, ua))"""),
    "r04_actor_kind": rule(_KIND + " SELECT ip, ua, kind, score FROM kk"),
    "r05_backups": rule(_STAFF + f""", n AS (SELECT ip, count(DISTINCT base) AS paths FROM rg WHERE {_SENS} GROUP BY 1), tv AS (SELECT DISTINCT vid FROM rg WHERE ({_SENS} OR {_ARCH}) AND ip IN (SELECT ip FROM n WHERE paths>=2)),
        got AS (SELECT * FROM rg WHERE {_SENS} AND status=200 AND bytes>0), d AS (SELECT ip, ua, base, min(ts) AS t FROM got GROUP BY 1,2,3), cr AS (SELECT base, count(DISTINCT ip) AS crowd FROM got GROUP BY 1),
        lg AS (SELECT * FROM rg WHERE base LIKE '/admin/%' AND status=200 AND ip IN (SELECT ip FROM staff)), mv AS (SELECT * FROM rg WHERE {_MOVE} AND status<400),
        e AS (SELECT d.*, crowd, paths, least((SELECT min(ts) FROM lg WHERE lg.ip=d.ip),(SELECT min(ts) FROM lg WHERE lg.ua=d.ua)) AS login, greatest((SELECT max(ts) FROM mv WHERE mv.ip=d.ip),(SELECT max(ts) FROM mv WHERE mv.ua=d.ua)) AS moved FROM d JOIN cr USING (base) JOIN n USING (ip)),
        f AS (SELECT *, CASE WHEN login<=t AND moved>=login THEN 2 WHEN paths-1>=2 OR crowd>=3 THEN 1 ELSE 0 END AS rank FROM e), v AS (SELECT got.vid, max(rank) AS rank FROM got JOIN f USING (ip, ua, base) GROUP BY 1)
        SELECT vs.vid, CASE WHEN rank IS NOT NULL AND "group" NOT IN ('robots','monitors') THEN CASE rank WHEN 0 THEN 'suspects' WHEN 1 THEN 'bots' ELSE 'own' END WHEN vs.vid IN (SELECT vid FROM tv) AND "group"='people' THEN 'bots' ELSE "group" END AS "group",
        CASE WHEN rank IS NOT NULL AND "group" NOT IN ('robots','monitors') THEN 'took a backup' WHEN vs.vid IN (SELECT vid FROM tv) AND "group"='people' THEN 'scanner under a browser: backup search' ELSE subgroup END AS subgroup FROM vs LEFT JOIN v USING (vid)"""),
    "j19_rendered_static": rule(_REN + " SELECT vid, rendered FROM rn"),
    "r07_unrendered": rule(_REN + _lab("\"group\"='people' AND n_pages>=1 AND n_static>0 AND vid NOT IN (SELECT vid FROM rn)", "bots", "masked: loads no resources")),
    "r08_service_checks": rule(_WK + _lab("vid IN (SELECT vid FROM wk) AND asn=15169 AND \"group\"<>'own'", "robots", "service check")),
    "r09_agents": rule(_WK + _lab("(contains(ua,'Telegram-Android') OR (contains(ua,'iPhone') AND vid IN (SELECT vid FROM wk))) AND \"group\"<>'own'", "people", "")),
    "r10_own_server": rule(", o AS (SELECT DISTINCT ip FROM rg WHERE base='/wp-cron.php' AND ua IN ('','-')) " + _lab("ip IN (SELECT ip FROM o) AND \"group\"<>'own'", "own", "site server")),
    "j05_same_user": rule(", cnd AS (SELECT * FROM vs WHERE n_goal>0 AND entry_ref_internal) SELECT vid FROM " + _same("cnd", 86400)),
    "j06_ip_switch": rule(", cnd AS (SELECT * FROM vs WHERE entry_ref_internal) SELECT vid FROM " + _switch("cnd")),
    "j07_caught_week": rule(", cnd AS (SELECT * FROM vs WHERE n_goal>0 AND n_pages<=2 AND dur<120), cgt AS (SELECT * FROM vs WHERE n_goal>0 AND entry_status=404) SELECT vid FROM " + _week("cnd", "cgt")),
    "r11_form_spam": rule(_SPAM + f""" SELECT vid, CASE WHEN s IS NOT NULL AND "group" IN ('people','bots') THEN 'bots' ELSE "group" END AS "group",
        CASE WHEN s IS NOT NULL AND "group" IN ('people','bots') THEN [{', '.join(_spam)}][s+1] ELSE subgroup END AS subgroup FROM f5"""),
    "j08_confirm_forms": rule(f""", p AS (SELECT * FROM rg WHERE goal<>'' AND method='POST'), h AS (SELECT p.req_id, arg_min(CASE WHEN {_MARK.replace('query', 'n.query').replace('base', 'n.base')} THEN 'page with a success mark' ELSE 'back on the form page' END, (n.ts, n.req_id)) AS how
          FROM p JOIN rg n ON n.ip=p.ip AND n.method<>'POST' AND NOT n.is_static AND n.ts BETWEEN p.ts AND p.ts+10 AND ({_MARK.replace('query', 'n.query').replace('base', 'n.base')} OR (p.ref_path<>'' AND n.base=p.ref_path)) GROUP BY 1)
        SELECT req_id, goal, status, goal_success AND NOT (status IN (302,303) AND how IS NULL) AS goal_success, coalesce(how,'') AS confirmed_by FROM p LEFT JOIN h USING (req_id)"""),
    "a07_leads": sql("grouped", """, p AS (SELECT * FROM rg WHERE goal<>'') SELECT p.req_id, p.ip, p.ts, goal, status, p."group", p.channel, CASE WHEN goal_success THEN 'accepted' WHEN status=499 THEN 'visitor left (499)' WHEN status>=500 THEN 'server error' WHEN status>=400 THEN 'refused by the server'
          WHEN status IN (302,303) THEN 'redirected, not confirmed' ELSE 'refused by the form' END AS outcome,
        CASE WHEN goal_success THEN '' WHEN EXISTS (SELECT 1 FROM p q WHERE q.goal_success AND q.ip=p.ip AND q.ts>p.ts AND q.ts<=p.ts+1800) THEN 'sent successfully later' ELSE 'did not send again' END AS "then",
        n_pages, n_static, p.ts-vs."start" AS seconds_from_entry, entry, vs.nettype FROM p JOIN vs USING (vid)"""),
    "r12_gov": rule(f""", so AS (SELECT vid FROM rg GROUP BY vid HAVING bool_and(regexp_matches(base,{lit(special.SERVICE_ONLY)}))), a AS (SELECT *, {_OPER} AS gov_op FROM vs),
        b AS (SELECT *, CASE WHEN gov_op<>'' AND fam='' AND n_goal=0 AND (vid IN (SELECT vid FROM so) OR n_pages>=100) THEN 'scanner under a browser' ELSE '' END AS k FROM a),
        c AS (SELECT vid, gov_op, k, CASE WHEN k<>'' THEN 'bots' ELSE "group" END AS "group", CASE WHEN k<>'' THEN 'government robots' ELSE subgroup END AS subgroup FROM b),
        d AS (SELECT *, gov_op<>'' AND k='' AND "group"='bots' AND regexp_matches(subgroup,'^(scanner under a browser|masked|explicit)') AS ordinary FROM c)
        SELECT vid, "group", CASE WHEN ordinary THEN 'government robots' ELSE subgroup END AS subgroup, gov_op, CASE WHEN k<>'' THEN k WHEN gov_op='' THEN '' WHEN "group"='people' THEN 'visitor' WHEN ordinary THEN 'scanner under a browser' ELSE 'other' END AS gov_kind,
        CASE WHEN ordinary THEN subgroup ELSE '' END AS gov_was FROM d"""),
    "r13_web_archive": sql("base", ", a AS (SELECT *, asn=8359 AND fam='' AND n_pages=1 AND n_req>=5 AND dur<=120 AND \"group\"<>'own' AS m FROM vs) SELECT vid, CASE WHEN m THEN 'robots' ELSE \"group\" END AS \"group\", CASE WHEN m THEN 'Web archive: page save' ELSE fam END AS fam, CASE WHEN m THEN 'yes' ELSE fam_verified END AS fam_verified FROM a"),
    "r18_ip_sets": sql("grouped", _REN + """ SELECT ip, bool_or("group"='people' AND n_pages>=1 AND rendered IS NOT NULL) AS has_people, bool_and(subgroup='hotlink') AS hotlink_only, bool_or("group"='own' AND subgroup='took a backup') AS own_backup, bool_and(subgroup='service check') AS service_check_only,
        bool_or("group"='suspects') AND NOT bool_or("group" IN ('bots','utilities')) AS suspect FROM vs LEFT JOIN rn USING (vid) GROUP BY ip"""),
    "p23_hosts": sql("grouped", _HOSTS + " SELECT * FROM hd"),
    "p24_split_error_log": sql("grouped", _HOSTS + f",{ERROR_LINES} SELECT host, coalesce(kind,'site') AS host_kind, count(*) AS n FROM el LEFT JOIN hd ON hd.vhost=el.host GROUP BY 1,2"),
    "j13_ip_host": sql("grouped", """, o AS (SELECT * FROM rg WHERE vhost='10.9.9.9') SELECT count(*) AS requests, count(DISTINCT ip) AS ips, count_if(status BETWEEN 200 AND 399) AS answered, count(DISTINCT ip) FILTER (WHERE "group"='people') AS people_ips,
        (SELECT count(DISTINCT a.ip) FROM o a WHERE a."group"='people' AND EXISTS (SELECT 1 FROM rg b WHERE b.host_site AND b.ip=a.ip AND b.ts BETWEEN a.ts AND a.ts+600)) AS reached_site_ips FROM o"""),
    "r_chain_groups": sql("visits", 'SELECT "group", subgroup, count(*) AS visits FROM vs GROUP BY 1,2'),
    "r_chain_visits": sql("visits", 'SELECT vid, "group", subgroup, n_goal, n_conv FROM vs'),
    "r_chain_demoted": sql("visits", 'SELECT demoted.req_id, vid, "group", n_goal, n_conv FROM demoted JOIN vs USING (vid)'),
}
