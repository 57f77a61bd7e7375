"""The book of fifteen rules over the whole log, and severities by address."""

from weblens.plans.queries_core import _log
from weblens.rules import rule_book, signatures

ENTRY, ADMIN, FORMS, CARD = "^/(catalog|old)/", "^/admin/", "^/contacts/(old-)?send/", "^/catalog/item-"
LISTS = {"allowed": [], "removed_handlers": ["/xmlrpc.php", "/contacts/old-send/"], "spam_ips": ["10.1.0.7", "10.3.0.9", "10.2.0.5"],
         "rare_entries": ["/old/page-1/", "/old/page-2/", "/.env"], "robot_networks": [13238, 15169, 8075, 714]}


def _hits(w):
    return signatures.apply_signatures(signatures.with_rule_fields(w.rq, FORMS, CARD), rule_book.rules(ENTRY, ADMIN), LISTS)


def _ips(w):
    ranks = w.spark.createDataFrame(list(rule_book.SEVERITY.items()), "sig string, rank int")
    return signatures.signature_ips(_hits(w), ranks)


QUERIES = {
    "r25_rule_book": _log(_hits),
    "r25_rule_book_ips": _log(_ips),
    "r25_seen_404": _log(lambda w: signatures.seen_404(w.rq)),
}
