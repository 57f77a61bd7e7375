"""Check queries for marketing."""

from oracles.prelude import in_list, lit, sql
from weblens.functions import ads
from weblens.plans.queries_marketing import REGIONS

_val = lambda k: f"coalesce(list_last([substr(p, {len(k) + 2}) FOR p IN string_split(entry_query,'&') IF lower(split_part(p,'=',1))='{k}' AND contains(p,'=')]),'')"
_dec = lambda x: f"url_decode(replace({x},'+',' '))"
_tld = in_list(ads.PLACEMENT_TLDS)


def _ptype(s, system):
    return f"""CASE WHEN {system}='search' OR lower({s}) IN ('none','') THEN CASE WHEN {system} IN ('search','') THEN 'search' ELSE 'not given' END
      WHEN len(string_split(lower({s}),'.'))>=2 AND string_split(lower({s}),'.')[-1] IN {_tld} AND string_split(lower({s}),'.')[1] NOT IN {_tld} THEN 'network: sites'
      WHEN regexp_matches(lower({s}), {lit(ads.OWN_APPS)}) THEN 'network: own apps' ELSE 'network: other apps' END"""


_METRIC = """count(*) AS visits, count(DISTINCT ip) AS ips, round(avg(n_pages),4) AS pages_per_visit, round(count_if(n_pages<=1 AND dur<10)/count(*)*100,4) AS bounce_pct,
  CAST(sum(n_goal) AS BIGINT) AS sent, CAST(sum(n_conv) AS BIGINT) AS accepted, round(sum(n_conv)/count(*)*100,4) AS conversion_pct"""
_P = ", hp AS (SELECT * FROM vs WHERE \"group\"='people')"
_AD = f""", ad0 AS (SELECT *, {_val('utm_source')} AS utm_source, {_val('utm_medium')} AS utm_medium, {_dec(_val('utm_campaign'))} AS campaign, {_dec(_val('utm_term'))} AS phrase,
  contains(entry_query,'{{') OR contains(entry_query,'%7B') AS raw_macro FROM vs WHERE channel='ads'),
ad AS (SELECT *, CASE WHEN channel_sub='Yandex Direct' THEN 'search' ELSE channel_sub END AS placement_type FROM ad0),
adp AS (SELECT * FROM ad WHERE "group"='people')"""
_W = "(\"group\"='bots' OR (\"group\"='people' AND entry_status>=400 AND entry_status<>499))"
_regs = ", ".join(f"({lit(c)},{lit(n)},{lit(p) if p else 'NULL'},{v})" for c, n, p, v in REGIONS)
_cut = lambda name, expr: f"SELECT '{name}' AS cut, CAST({expr} AS VARCHAR) AS value, {_METRIC} FROM hc GROUP BY 2"

SQL = {
    "p14_parse_ad": sql("visits", _AD + " SELECT vid, utm_source, utm_medium, campaign, phrase, raw_macro, placement_type FROM ad"),
    "p15_placement_type": sql("features", f"SELECT DISTINCT ref_host, {_ptype('ref_host', lit('context'))} AS kind FROM rf"),
    "p16_phrase_labels": sql("visits", _AD + """ SELECT CASE WHEN lower(trim(phrase)) LIKE '---autotargeting%' THEN 'autotargeting' WHEN phrase LIKE '{%}' THEN '(macro not replaced)' WHEN phrase='' THEN '(phrase not given)' ELSE trim(phrase) END AS label, count(*) AS n FROM adp GROUP BY 1"""),
    "p16_region_names": sql("visits", _AD + f""", rg_(code, name, parent, level) AS (VALUES {_regs}), cc AS (SELECT DISTINCT {_dec(_val('utm_campaign'))} AS region FROM vs WHERE {_val('utm_campaign')}<>''),
        wk AS (WITH RECURSIVE w AS (SELECT region, region AS at, 0 AS d FROM cc UNION ALL SELECT region, parent, d+1 FROM w JOIN rg_ ON w.at=rg_.code WHERE parent IS NOT NULL AND d<8) SELECT region, arg_min(name, d) AS area FROM w JOIN rg_ ON w.at=rg_.code WHERE level=2 GROUP BY region)
        SELECT region, coalesce(name,'') AS name, CASE WHEN area<>name THEN area ELSE '' END AS area FROM cc LEFT JOIN rg_ ON region=code LEFT JOIN wk USING (region)"""),
    "r15_form_goals": sql("sessions", "SELECT gkey AS key, posts, ips, first_ts, last_ts, rule FROM goals"),
    "a52_visit_metrics": sql("visits", f"SELECT channel, channel_sub, {_METRIC} FROM vs WHERE \"group\"='people' GROUP BY 1,2"),
    "a53_cuts": sql("visits", _P + ", hc AS (SELECT *, \"start\">min(\"start\") OVER (PARTITION BY ip) AS rt FROM hp) " + " UNION ALL ".join([
        _cut("device", "CASE WHEN ua_mobile THEN 'mobile' ELSE 'desktop' END"), _cut("browser", "CASE WHEN ua_webview THEN 'in-app browser' ELSE 'browser' END"),
        _cut("hour", "hour"), _cut("weekday", "weekday"), _cut("visit", "CASE WHEN rt THEN 'returning' ELSE 'first' END")])),
    "a53_entry_pages": sql("visits", f"SELECT entry, {_METRIC} FROM vs WHERE \"group\"='people' GROUP BY 1"),
    "a54_channel_cleaning": sql("visits", """SELECT channel, count(*) AS visits, count_if("group"='people') AS people, count_if("group"='bots') AS bots, CAST(sum(n_pages_raw) AS BIGINT) AS pages_raw,
        CAST(sum(n_pages) AS BIGINT) AS pages, CAST(sum(n_dup) AS BIGINT) AS double_loads, CAST(sum(n_redirect) AS BIGINT) AS redirects FROM vs GROUP BY 1"""),
    "a54_channel_quality": sql("visits", """, q AS (SELECT channel, count_if("group"='people') AS people, count_if("group"='bots') AS bots, CAST(coalesce(sum(n_conv) FILTER (WHERE "group"='people'),0) AS BIGINT) AS people_leads,
        CAST(coalesce(sum(n_conv) FILTER (WHERE "group"='bots'),0) AS BIGINT) AS bot_leads FROM vs WHERE "group" IN ('people','bots') GROUP BY 1)
        SELECT *, round(bots/greatest(people+bots,1)*100,4) AS bots_pct, round(bot_leads/greatest(people_leads+bot_leads,1)*100,4) AS false_leads_pct, round(people_leads/greatest(people,1)*100,4) AS conversion_pct FROM q"""),
    "a55_organic": sql("visits", "SELECT day, channel_sub, count(*) AS visits FROM vs WHERE \"group\"='people' AND channel='search' GROUP BY 1,2"),
    "a56_ads_by_campaign": sql("visits", _AD + f" SELECT channel_sub, campaign, {_METRIC} FROM adp GROUP BY 1,2"),
    "a56_ads_by_placement_type": sql("visits", _AD + f" SELECT channel_sub, placement_type, {_METRIC} FROM adp GROUP BY 1,2"),
    "a57_placements": sql("visits", _AD + """, t AS (SELECT campaign AS placement, count_if("group"='people') AS people, count_if("group"='bots') AS bots, CAST(coalesce(sum(n_conv) FILTER (WHERE "group"='people'),0) AS BIGINT) AS accepted, count(*) AS visits FROM ad GROUP BY 1)
        SELECT *, CASE WHEN lower(placement)='none' THEN 'search, not a placement' WHEN bots/visits*100>=50 AND people+bots>=20 THEN 'switch off: mostly bots' WHEN people>=30 AND accepted=0 THEN 'switch off: traffic without leads' WHEN accepted>0 THEN 'works' ELSE 'too little data' END AS verdict FROM t"""),
    "a58_landings": sql("visits", _AD + f" SELECT entry, entry_status, {_METRIC} FROM adp GROUP BY 1,2"),
    "a58_broken_labels": sql("visits", _AD + """ SELECT 'macro not replaced' AS problem, count(*) AS clicks, min(entry_query) AS example FROM adp WHERE raw_macro HAVING count(*)>0
        UNION ALL SELECT 'click id without UTM', count(*), min(entry_query) FROM adp WHERE contains(entry_query,'yclid=') AND NOT contains(entry_query,'utm_') HAVING count(*)>0"""),
    "a59_ad_bots": sql("visits", _AD + f""" SELECT campaign AS value, count(*) AS visits, count_if("group"='bots') AS bots, count_if("group"='robots') AS robots, count_if("group"='people' AND {_W}) AS landing_errors, count_if({_W}) AS wasted,
        CAST(coalesce(sum(n_conv) FILTER (WHERE "group"='bots'),0) AS BIGINT) AS bot_leads, round(count_if("group"='bots')/count(*)*100,4) AS bots_pct FROM ad GROUP BY 1"""),
    "a60_week_heat": sql("visits", "SELECT weekday, hour, count(*) AS visits, CAST(sum(n_conv) AS BIGINT) AS accepted FROM vs WHERE \"group\"='people' GROUP BY 1,2"),
    "a60_marketing_journal": sql("visits", f"""SELECT day, count_if("group"='people') AS people, count_if("group"='people' AND channel='ads') AS people_ads, count_if("group"='people' AND channel='search') AS people_search,
        count_if("group"='people' AND channel NOT IN ('ads','search')) AS people_other, count_if(channel='ads' AND "group"='bots') AS ad_bots, count_if(channel='ads' AND {_W}) AS ad_wasted,
        CAST(coalesce(sum(n_goal) FILTER (WHERE "group"='people'),0) AS BIGINT) AS sent, CAST(coalesce(sum(n_conv) FILTER (WHERE "group"='people'),0) AS BIGINT) AS accepted,
        CAST(coalesce(sum(n_conv) FILTER (WHERE "group"='people' AND channel='ads'),0) AS BIGINT) AS accepted_ads, CAST(coalesce(sum(n_conv) FILTER (WHERE "group"='bots'),0) AS BIGINT) AS accepted_bots FROM vs GROUP BY ROLLUP (day)"""),
    "a61_goal_funnel": sql("grouped", "SELECT goal, count(DISTINCT vid) AS visits, count(*) AS sent, count_if(goal_success) AS accepted FROM rg WHERE goal<>'' AND \"group\"='people' GROUP BY 1"),
    "a61_order_funnel": sql("grouped", """, h AS (SELECT * FROM rg WHERE "group"='people') SELECT 0 AS no, 'people' AS step, count(DISTINCT vid) AS visits FROM h
        UNION ALL SELECT 1, 'action', count(DISTINCT vid) FROM h WHERE base LIKE '/cart/add/%' UNION ALL SELECT 2, 'cart', count(DISTINCT vid) FROM h WHERE base LIKE '/cart/%'
        UNION ALL SELECT 3, 'checkout', count(DISTINCT vid) FROM h WHERE base LIKE '/cart/checkout/%' UNION ALL SELECT 4, 'order', count(DISTINCT vid) FROM h WHERE base LIKE '/cart/success/%'"""),
}
