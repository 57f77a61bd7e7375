"""The rules one after another, in SQL: each one's twin runs on the groups that the rules before it left."""

from oracles.prelude import BASE, CHAIN, FIELDS, plain_counts
from oracles.rules import SQL

#: Rules that relabel visits, in order; what stands for a rule is the name of its twin.
ORDER = ["app_agents", "r03_mark_scanners", "r05_backups", "r06_files_only", "r07_unrendered", "r08_service_checks", "r09_agents", "r10_own_server", "r11_form_spam"]
_APP = """ SELECT vid, CASE WHEN contains(ua,'Telegram-Android') AND "group"<>'own' THEN 'people' ELSE "group" END AS "group", CASE WHEN contains(ua,'Telegram-Android') AND "group"<>'own' THEN '' ELSE subgroup END AS subgroup FROM vs"""


def _on(visits: str, body: str) -> str:
    body = body.strip()
    return "(WITH " + BASE.replace("vs0", visits) + "," + FIELDS + (body if body.startswith(",") else "\n" + body) + ")"


def _chain() -> str:
    parts, last = [], "vs0"
    for k, name in enumerate(ORDER, 1):
        body = _APP if name == "app_agents" else SQL[name].body
        parts.append(f"lab{k} AS MATERIALIZED {_on(last, body)}")
        parts.append(f'vs{k} AS MATERIALIZED (SELECT p.* REPLACE (l."group" AS "group", l.subgroup AS subgroup) FROM {last} p JOIN lab{k} l USING (vid))')
        last = f"vs{k}"
    parts.append(f"confirmed AS MATERIALIZED {_on(last, SQL['j08_confirm_forms'].body)}")
    parts.append("demoted AS MATERIALIZED (SELECT c.req_id, rq.vid FROM confirmed c JOIN rq USING (req_id) WHERE rq.goal_success AND NOT c.goal_success)")
    parts.append(f"vs AS MATERIALIZED (SELECT p.* REPLACE (p.n_conv - coalesce(lost, 0) AS n_conv) FROM {last} p LEFT JOIN (SELECT vid, count(*) AS lost FROM demoted GROUP BY vid) USING (vid))")
    return plain_counts(",\n".join(parts))


TEXT = _chain()


def whole(text: str) -> str:
    return str(text).replace(CHAIN, TEXT)
