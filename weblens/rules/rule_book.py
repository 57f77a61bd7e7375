"""Fifteen rules on form spam, scouting, scrapers, scanners, false robots and ad clicks, for ``signatures.apply_signatures``.

Addresses of the site are parameters: pages that spam visits start at, handlers of forms
that are gone, networks of robots, known addresses.
"""

from __future__ import annotations

# fixed values: patterns, limits and severities that results depend on
PROBED = (r"(?i)/(\.env|\.git|\.aws|\.ssh|\.DS_Store|wp-login|wp-admin|wp-config|xmlrpc|phpmyadmin|docker-compose|secrets?\.ya?ml|config\.ya?ml|database\.ya?ml"
          r"|\.gitlab-ci|serverless\.ya?ml|actuator|cgi-bin|server-status|\.sql|backup\.|debug/default)")
HEADLESS = "HeadlessChrome|Lightpanda|PhantomJS|Puppeteer|Playwright"
TEL_LINK = "/tel:[0-9+]"
SEVERITY = {"spam_dead_entry": 4, "spam_ip_switch": 4, "form_without_pages": 3, "fast_pages_and_forms": 3, "form_agents": 3, "removed_handlers": 2, "known_spam_ip": 3,
            "scouting": 1, "no_browser": 1, "tel_as_page": 2, "probing": 3, "false_robot": 3, "robot_rotation": 3, "headless": 1, "ad_clicks": 2}


def rules(entry: str, admin: str) -> list[dict]:
    """``entry`` and ``admin`` are patterns of paths: where spam visits start, and what only staff opens. Lists: allowed, removed_handlers, spam_ips, rare_entries, robot_networks."""
    allowed = {"ip": {"not_in_list": "allowed"}}
    form, no_staff = {"is_form_post": True}, {"agg": "count", "match": {"base": {"re": admin}}, "op": "==", "value": 0}
    some_form = {"agg": "count", "match": form, "op": ">=", "value": 1}
    dead = {"method": "GET", "status": 404, "ref": "-"}
    return [
        {"id": "spam_dead_entry", "scope": "session", "where": allowed, "require": [no_staff], "sequence": [
            {"first_page_in_session": True, "match": {**dead, "base": {"re": entry}}}, {"within": 900, "match": {"method": "GET", "base": "/", "status": 200}},
            {"within": 300, "max_pages_between": 4, "match": form}]},
        {"id": "spam_ip_switch", "scope": "session", "where": allowed, "require": [no_staff], "sequence": [
            {"first_page_in_session": True, "match": {"ref_internal": True, "ref_seen_404_other_ip": {"lte": 1800}, "ref_path": {"re": entry}}},
            {"within": 900, "max_pages_between": 4, "match": form}]},
        {"id": "form_without_pages", "scope": "session", "where": allowed, "require": [no_staff, some_form, {"agg": "count", "match": {"is_page": True}, "op": "==", "value": 0}]},
        {"id": "fast_pages_and_forms", "scope": "session", "where": allowed, "require": [
            no_staff, {"agg": "burst", "match": {"is_page": True}, "window": 15, "op": ">=", "value": 6}, some_form, {"agg": "burst", "match": form, "window": 60, "op": ">=", "value": 2}]},
        {"id": "form_agents", "scope": "window", "window": "day", "where": {**form, **allowed}, "require": [{"agg": "distinct", "field": "ua", "op": ">=", "value": 3}]},
        {"id": "removed_handlers", "scope": "request", "match": {"method": "POST", "base": {"in_list": "removed_handlers"}, "status": 404}},
        {"id": "known_spam_ip", "scope": "request", "match": {"ip": {"in_list": "spam_ips"}, **form}},
        {"id": "scouting", "scope": "request", "match": {**dead, "base": {"in_list": "rare_entries"}}},
        {"id": "no_browser", "scope": "session", "where": {"is_bot_ua": False}, "sequence": [
            {"first_page_in_session": True, "match": {"ref": "-", "is_desktop": True, "yclid": {"exists": False}, "status": {"not_in": [500, 502, 503, 504]}}}], "require": [
            {"agg": "count", "match": {"is_page": True}, "op": ">=", "value": 1}, {"agg": "count", "match": {"is_static": True}, "op": "==", "value": 0},
            {"agg": "count", "match": {"is_form_get": True}, "op": "==", "value": 0}]},
        {"id": "tel_as_page", "scope": "request", "match": {"path": {"re": TEL_LINK}}},
        {"id": "probing", "scope": "window", "window": "hour", "where": {"base": {"re": PROBED}}, "require": [{"agg": "distinct", "field": "base", "op": ">=", "value": 3}]},
        {"id": "false_robot", "scope": "request", "match": {"fam_verified": "no"}},
        {"id": "robot_rotation", "scope": "window", "window": "day", "where": {"is_bot_ua": True, "asn": {"not_in_list": "robot_networks"}}, "require": [
            {"agg": "distinct", "field": "fam", "op": ">=", "value": 4}]},
        {"id": "headless", "scope": "request", "match": {"ua": {"re": HEADLESS}}},
        {"id": "ad_clicks", "scope": "window", "window": "day", "key": "ip_ua", "where": {"is_bot_ua": False}, "require": [
            {"agg": "distinct", "field": "yclid", "op": ">=", "value": 8}, {"agg": "count", "match": {"is_item_card": True}, "op": "==", "value": 0}]},
    ]
