"""Personal data, secrets and outside links in query strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblens.functions import columns as C
from weblens.functions import fixed_values as fv
from weblens.functions.ads import decode_plus

# fixed values: keys and shapes of personal data, secrets and links
PERSONAL_KEYS = r"(?i)^(phone|tel|telephone|mobile|email|e-mail|mail|fio|surname|lastname|last_name|passport|snils|inn)$"
TEXT_KEYS = r"(?i)^(name|fio|message|comment)$"
PHONE_KEYS = r"(?i)phone|tel|mobile"
SECRET_KEYS = "sessid phpsessid token access_token api_key apikey key password passwd user_checkword checkword".split()
LINK_KEYS = (r"(?i)^(goto|url|uri|redirect|redirect_?url|redirect_?uri|redir|back_?url|return|return_?url|return_?to|next|continue"
             r"|target|dest|destination|link|to|u|r)$")
LINK_VALUE = r"(?i)^(https?:|//|www\.)"
EMAIL_VALUE = r"(?i)@[\w-]+\.[a-z]{2,}"
PROBE_VALUE = r"(?i)autodiscover|/|\\.json"


def _key(pair: Column) -> Column:
    return F.regexp_replace(F.trim(decode_plus(F.split(pair, "=", 2)[0])), r"(?i)^(amp;)+", "")


def _raw(pair: Column) -> Column:
    return F.when(pair.contains("="), F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1)).otherwise("")


def is_phone(value: Column) -> Column:
    v = F.trim(value)
    digits = F.regexp_replace(v, r"\D", "")
    n = F.length(digits)
    plus = v.startswith("+")
    local = n.isin(10, 11) & F.substring(digits, 1, 1).isin("7", "8")
    return v.rlike(r"^\+?[\d\s()-]+$") & F.when(plus, n.between(10, 15)).otherwise(local)


def is_link(key: Column, raw: Column) -> Column:
    twice = F.trim(decode_plus(decode_plus(raw)))
    return key.rlike(LINK_KEYS) | twice.rlike(LINK_VALUE)


def pd_kind(pair: Column) -> Column:
    """'email', 'phone', 'field' or NULL for one key=value pair; ad identifiers never count."""
    key, value = _key(pair), F.trim(decode_plus(_raw(pair)))
    skip = (value == "") | F.lower(key).isin(fv.AD_PARAMS) | value.rlike(PROBE_VALUE)
    return (F.when(skip, F.lit(None)).when(value.rlike(EMAIL_VALUE), "email").when(is_phone(value), "phone")
            .when(key.rlike(PERSONAL_KEYS), "field"))


def has_pd(query: Column) -> Column:
    """Personal data by value. A link with its own '?' ends the check: the rest belongs to another address."""
    pairs = F.split(query, "&")
    ends = F.transform(pairs, lambda p: is_link(_key(p), _raw(p)) & decode_plus(_raw(p)).contains("?"))
    stop = F.array_position(ends, True)
    usable = F.when(stop > 0, F.slice(pairs, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(pairs)
    return (query != "") & F.exists(usable, lambda p: ~is_link(_key(p), _raw(p)) & pd_kind(p).isNotNull())


def is_secret(pair: Column) -> Column:
    return F.lower(_key(pair)).isin(SECRET_KEYS) & (_raw(pair) != "")


def _mask_digits(value: Column) -> Column:
    d = F.regexp_replace(value, r"\D", "")
    plus = F.when(F.trim(value).startswith("+"), "+").otherwise("")
    second = F.when(F.length(d) >= 10, F.concat(F.lit(" "), F.substring(d, 2, 1))).otherwise("")
    return F.when(F.length(d) < 4, "***").otherwise(F.concat(plus, F.substring(d, 1, 1), second, F.lit("** ***-**-"), F.substring(d, -2, 2)))


def mask_pair(pair: Column) -> Column:
    key, raw = _key(pair), _raw(pair)
    value = F.trim(decode_plus(raw))
    kind = pd_kind(pair)
    name = F.split(pair, "=", 2)[0]
    masked = (
        F.when(is_secret(pair), F.concat(F.substring(raw, 1, 4), F.lit("…")))
        .when(key.rlike(TEXT_KEYS) & (value != "") & ~F.lower(key).isin(fv.AD_PARAMS), "***")
        .when(kind == "phone", _mask_digits(value))
        .when(kind == "email", F.regexp_replace(value, r"([\w.-])[\w.-]*@([\w-])[\w.-]*", "$1***@$2***"))
        .when((kind == "field") & key.rlike(PHONE_KEYS), _mask_digits(value)).when(kind == "field", "***"))
    return F.when(pair.contains("=") & masked.isNotNull(), F.concat(name, F.lit("="), masked)).otherwise(pair)


def mask_query(query: Column) -> Column:
    """Personal data and secrets masked; other parameters, order and separators stay."""
    return F.array_join(F.transform(F.split(query, "&"), mask_pair), "&")


def secret_key(query: Column) -> Column:
    rx = r"(?i)(?:^|&)(" + "|".join(SECRET_KEYS) + ")="
    return F.lower(F.regexp_extract(query, rx, 1))


def external_link(query: Column, site_hosts) -> Column:
    """The query carries a link parameter that leads to a foreign host."""

    def outside(pair):
        url = F.trim(decode_plus(decode_plus(_raw(pair))))
        full = F.when(url.contains("://"), url).when(url.startswith("//"), F.concat(F.lit("http:"), url)).otherwise(F.concat(F.lit("http://"), url))
        host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(full, F.lit("HOST")), F.lit(""))), r"^www\.", "")
        return is_link(_key(pair), _raw(pair)) & host.contains(".") & ~C.host_is_internal(host, site_hosts)

    candidate = query.rlike(r"(?i)(?:https?(?::|%3A)|//|%2F%2F)")
    return candidate & F.exists(F.split(query, "&"), outside)
