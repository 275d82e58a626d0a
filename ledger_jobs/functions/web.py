"""Fields of request logs: addresses, devices, referrers, visitor ids, feedback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Addresses and address prefixes of private networks (``172.2`` takes some public
# addresses too).
PRIVATE = ("127.0.0.1", "::1", "0.0.0.0", "")
PRIVATE_PREFIXES = (
    "10.", "192.168.", "169.254.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.30.", "172.31.", "fc", "fd",
)


def hash_ip(ip: Column, salt: str) -> Column:
    """First 16 hex digits of the SHA-256 of salt and address."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), ip), 256), 1, 16)


def device(agent: Column) -> Column:
    """``Mobile · Chrome`` and the like from a user agent; null is Unknown."""
    low = F.lower(agent)
    has = lambda *words: low.rlike("|".join(words))
    form = F.when(has("ipad", "tablet"), "Tablet").when(has("mobi", "android", "iphone"), "Mobile").otherwise("Desktop")
    browser = (
        F.when(has("edg/", "edga"), "Edge").when(has("opr/", "opera"), "Opera").when(has("firefox"), "Firefox")
        .when(has("chrome", "crios"), "Chrome").when(has("safari"), "Safari").otherwise("Other")
    )
    return F.when(agent.isNull(), "Unknown").otherwise(F.concat(form, F.lit(" · "), browser))


def referrer_host(referrer: Column) -> Column:
    """Host of a referrer, with or without scheme, without leading ``www.``; empty is ``direct``."""
    bare = F.coalesce(F.try_element_at(F.split(F.trim(referrer), "://"), F.lit(2)), F.trim(referrer))
    host = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), r"^(www\.)+", "")
    return F.when(F.coalesce(F.trim(referrer), F.lit("")) == "", "direct").otherwise(host)


def clean_visitor(visitor: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` of a visitor id, 64 at most; nothing left is ``anon``."""
    kept = F.substring(F.regexp_replace(F.coalesce(visitor, F.lit("")), "[^A-Za-z0-9_-]", ""), 1, 64)
    return F.when(kept == "", "anon").otherwise(kept)


def short_visitor(visitor: Column) -> Column:
    return F.substring(visitor, 1, 8)


def base_name(path: Column) -> Column:
    """File name without folders of either kind of slash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def clip(text: Column, most: int) -> Column:
    return F.trim(F.substring(text, 1, most))


def client_ip(*headers: Column) -> Column:
    """The first address in the first header that has one."""
    first = [F.nullif(F.trim(F.element_at(F.split(h, ","), 1)), F.lit("")) for h in headers]
    return F.coalesce(*first, F.lit("0.0.0.0"))


def is_private(ip: Column) -> Column:
    hit = ip.isin(*PRIVATE)
    for prefix in PRIVATE_PREFIXES:
        hit = hit | ip.startswith(prefix)
    return hit


def header_country(country: Column) -> Column:
    """A country header, or null if it is empty, XX or unknown."""
    kept = F.trim(country)
    return F.when((kept != "") & (kept != "XX") & (F.lower(kept) != "unknown"), kept)


def stars(n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(5), n))


def would_pay(answer: Column) -> Column:
    low = F.lower(answer)
    return F.when(low.isin("yes", "maybe", "no"), low).otherwise("")
