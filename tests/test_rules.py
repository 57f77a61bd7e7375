"""Scenarios of visit rules."""
from pyspark.sql import functions as F

from weblens.marts import errors, findings
from weblens.rules import files_only, forms, scanners, special
from tests.conftest import BROWSER

T0 = 1704067200


def group_of(visits, ip):
    return [(r.group, r.subgroup) for r in visits.where(F.col("ip") == ip).collect()]


def page_with_assets(t, ip, base="/"):
    ref = {"ref": f"https://site.ru{base}"}
    return [(t, ip, base), (t + 1, ip, "/a.css", ref), (t + 1, ip, "/b.js", ref), (t + 2, ip, "/c.png", ref)]


def test_people_scanners_and_masked_bots(spark, make_log, weblog):
    rows = page_with_assets(T0, "5.5.5.1")
    rows += page_with_assets(T0, "5.5.5.2") + [(T0 + 10 + i, "5.5.5.2", p, {"status": 404}) for i, p in enumerate(["/.env", "/.git/config"])]
    rows += [(T0 + i, "5.5.5.3", f"/nothing{i}/", {"status": 404}) for i in range(6)] + [(T0 + 9, "5.5.5.3", "/x.css", {"status": 404})]
    rows += [(T0, "5.5.5.4", "/")]
    rows += [(T0, "5.5.5.5", "/", {"ua": "curl/8.4.0"}), (T0, "5.5.5.6", "/", {"ua": "Googlebot/2.1"})]
    w = weblog(make_log(rows))
    assert group_of(w.visits, "5.5.5.4") == [("bots", "masked: loads no resources")]
    assert group_of(w.visits, "5.5.5.5") == [("utilities", "curl")] and group_of(w.visits, "5.5.5.6") == [("bots", "fake robots")]
    v = scanners.mark_scanners(w.visits, w.rq, scanners.probe_dim(w.log))
    assert group_of(v, "5.5.5.1") == [("people", "")]
    assert group_of(v, "5.5.5.2") == [("bots", "human researcher, once: strong probe")] or group_of(v, "5.5.5.2")[0][1].endswith("strong probe")
    assert group_of(v, "5.5.5.3") == [("bots", "scanner under a browser: fan of 404")]


def test_site_links_to_missing_pages_are_not_a_scan(make_log, weblog):
    rows = page_with_assets(T0, "5.5.5.1") + [(T0 + 5 + i, "5.5.5.1", f"/gone{i}/", {"status": 404, "ref": "https://site.ru/"}) for i in range(8)]
    w = weblog(make_log(rows))
    assert group_of(scanners.mark_scanners(w.visits, w.rq, scanners.probe_dim(w.log)), "5.5.5.1") == [("people", "")]


def test_unrendered_and_own_server(make_log, weblog):
    rows = [(T0, "5.5.5.1", "/"), (T0 + 1, "5.5.5.1", "/foreign.css")] + page_with_assets(T0, "5.5.5.2")
    rows += [(T0, "5.5.5.9", "/wp-cron.php", {"ua": "-", "method": "POST"})]
    w = weblog(make_log(rows))
    v = special.own_server(special.mark_unrendered(w.visits, w.rq), w.rq)
    assert group_of(v, "5.5.5.1") == [("bots", "masked: loads no resources")] and group_of(v, "5.5.5.2") == [("people", "")]
    assert group_of(v, "5.5.5.9") == [("own", "site server")]


def form_rows():
    """Three ordinary forms make the goal; then spam by two behaviours."""
    rows = []
    for i in range(4):
        ip = f"7.7.7.{i}"
        rows += page_with_assets(T0 + i * 5000, ip, "/contacts/") + [(T0 + i * 5000 + 30, ip, "/contacts/send/", {"method": "POST", "status": 302, "ref": "https://site.ru/contacts/"}),
                                                               (T0 + i * 5000 + 31, ip, "/thanks/", {"query": "success=1", "ref": "https://site.ru/contacts/"})]
    rows += [(T0 + 100, "8.8.8.1", "/broken/x", {"status": 404}), (T0 + 101, "8.8.8.1", "/a.css"), (T0 + 110, "8.8.8.1", "/contacts/send/", {"method": "POST", "status": 302, "ref": "https://site.ru/"})]
    rows += [(T0 + 200, "8.8.8.2", "/contacts/send/", {"method": "POST", "status": 302, "ref": "https://site.ru/other/"})]
    return rows


def test_form_spam_and_confirmation(make_log, weblog):
    w = weblog(make_log(form_rows()))
    assert {r.key: r.rule for r in w.goals.collect()} == {"/contacts/send/": "goal: success is 3xx"}
    v = forms.mark_form_spam(w.visits, w.rq)
    assert group_of(v, "8.8.8.1") == [("bots", forms.SPAM_SIGNS[0])] and group_of(v, "8.8.8.2") == [("bots", forms.SPAM_SIGNS[1])]
    assert group_of(v, "7.7.7.1") == [("people", "")]
    confirmed = {r.vid: (r.goal_success, r.confirmed_by) for r in forms.confirm_forms(w.rq).collect()}
    assert sorted(confirmed.values()) == [(False, "")] * 2 + [(True, "page with a success mark")] * 4


def test_same_user_switching_ip_is_not_spam(make_log, weblog):
    rows = form_rows() + page_with_assets(T0 + 9000, "9.9.9.1", "/contacts/") + [
        (T0 + 9050, "9.9.9.2", "/contacts/send/", {"method": "POST", "status": 302, "ref": "https://site.ru/contacts/"})]
    w = weblog(make_log(rows))
    v = forms.mark_form_spam(w.visits, w.rq)
    assert group_of(v, "9.9.9.2") != [("bots", forms.SPAM_SIGNS[1])]


def test_hosts(make_log, weblog):
    rows = [(T0 + i, "1.1.1.1", f"/p{i}/", {"vhost": "north.site.ru"}) for i in range(12)] + [(T0, "1.1.1.1", "/", {"vhost": h}) for h in ("guess.site.ru", "copy.example", "1.2.3.4", "www.site.ru")]
    kinds = {r.vhost: r.kind for r in special.host_dim(weblog(make_log(rows)).features, ["site.ru"]).collect()}
    assert kinds == {"north.site.ru": "site", "guess.site.ru": "guessed subdomain", "copy.example": "other domain", "1.2.3.4": "ip", "site.ru": "site"}


def test_soft_errors_group_same_sizes(make_log, weblog):
    rows = [(T0 + i, "5.5.5.1", f"/item{i:03d}x", {"bytes": 5000 + i % 50}) for i in range(250)] + [(T0 + i, "5.5.5.1", f"/big{i}y/", {"bytes": 30000}) for i in range(250)]
    found = errors.soft_groups(weblog(make_log(rows)).rq).collect()
    assert [(r.start, r.addresses, r.kind) for r in found] == [(5000, 250, "same page, check")]


def test_findings_keep_the_worst_and_alarms_can_be_repeated(spark):
    mart = spark.createDataFrame([("/a", 3), ("/b", 30), ("/c", 1)], "p string, n int")
    f = findings.collect(findings.detect(mart, "errors", "5xx", F.col("p"), F.col("n") >= 2, "important", F.col("n")),
                         findings.detect(mart, "errors", "5xx", F.col("p"), F.col("n") >= 20, "urgent", F.col("n")),
                         findings.detect(mart, "security", "webshell", F.col("p"), F.col("n") == 1, "urgent", F.col("n")))
    assert {r.key: r.severity for r in f.collect()} == {"errors:5xx:/a": "important", "errors:5xx:/b": "urgent", "security:webshell:/c": "urgent"}
    none = spark.createDataFrame([], "base string")
    once = findings.alarms(f, none)
    assert {(r.key, r.severity) for r in once.collect()} == {(r.key, r.severity) for r in findings.alarms(once, none).collect()}
    assert once.where("severity = 'alarm'").count() == 1


def test_visits_of_files_only(make_log, weblog):
    agent = lambda n: {"ua": BROWSER.replace("Chrome/120", f"Chrome/12{n}")}
    direct, future = {}, {"ua": "Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20990101 Firefox/115.0"}
    ref = lambda url: {"ref": url}
    noon = T0 + 13 * 3600
    rows = page_with_assets(T0, "7.7.7.1") + [(T0 + 60, "7.7.7.1", "/upload/a.jpg", agent(3))]
    rows += [(T0, "7.7.7.2", "/docs/a.pdf", direct)]
    rows += [(T0 + i, "7.7.7.3", f"/img/{i}.jpg", direct) for i in range(12)]
    rows += [(T0, "7.7.7.4", "/old.jpg", {"status": 404})]
    rows += [(T0 + i, "7.7.7.5", f"/none-{i}/x.jpg", {"status": 404}) for i in range(6)]
    rows += [(T0, "7.7.7.6", "/img/one.jpg", ref("https://blog.example/post"))]
    rows += [(T0, "7.7.7.7", "/img/one.jpg", ref("https://www.google.com/"))]
    rows += [(T0, "7.7.7.8", "/img/one.jpg", future), (T0, "7.7.7.9", "/img/one.jpg", ref("https://crm.example/"))]
    rows += [(T0, "7.7.8.1", "/img/one.jpg", ref("https://blog.example/post")), (T0 + 1, "7.7.8.1", "/s.css", ref("https://blog.example/post"))]
    for n in (1, 2, 3):
        rows += [(r[0], r[1], r[2], {**(r[3] if len(r) > 3 else {}), **agent(n)}) for r in page_with_assets(T0 + 9 * 3600, "7.7.8.2")]
    rows += [(noon, "7.7.8.2", "/img/one.jpg", agent(4))]
    rows += [(T0 + i * 60, "7.7.8.3", "/img/one.jpg", direct) for i in range(3)]
    rows += [(T0, "7.7.8.4", "/robots.txt", direct), (T0, "7.7.8.5", "/.env.zip", direct), (T0, "7.7.8.6", "/img/big.jpg", {"bytes": 9000})]
    rows += [(T0, "7.7.8.7", "/img/one.jpg", ref("https://site.ru/page/"))]
    w = weblog(make_log(rows))
    v = files_only.mark_files_only(w.visits, w.rq, w.addresses, ["crm.example"]).where("n_pages = 0").cache()
    scraper, missing = ("bots", "files only: scraper"), ("bots", "files only: asks for files that do not exist")
    expected = {"7.7.7.1": ("people", ""), "7.7.7.2": ("suspects", "took a document"), "7.7.7.3": scraper, "7.7.7.4": ("suspects", ""), "7.7.7.5": missing,
                "7.7.7.6": ("external_sites", "hotlink"), "7.7.7.7": ("people", "from image search"), "7.7.7.8": scraper, "7.7.7.9": ("own", "own systems"),
                "7.7.8.1": ("people", "hotlink"), "7.7.8.2": ("people", "opened a file by a direct link"), "7.7.8.3": scraper, "7.7.8.4": ("people", ""),
                "7.7.8.5": ("people", ""), "7.7.8.6": ("suspects", "took a document"), "7.7.8.7": ("suspects", "")}
    found = {r.ip: r for r in v.collect()}
    assert {ip: (r.group, r.subgroup) for ip, r in found.items()} == expected
    assert found["7.7.7.3"].evidence_bot == "list crawl" and found["7.7.8.1"].evidence_people == "assets of one page" and found["7.7.8.4"].evidence_bot == ""
