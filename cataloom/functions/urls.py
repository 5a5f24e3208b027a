"""Addresses: product keys, cleaning, codes and the hosts that matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = r"utm_[a-z]+|gclid|fbclid|yclid|ref|affid|tag"


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")


def product_key(url: Column, kinds: str = r"products?|items?|goods", three_part_hosts: str = r"(^|\.)onepiece-cardgame\.com$", versioned_hosts: str = r"(^|\.)1kuji\.com$") -> Column:
    """host/kind/slug of a page of one product, else null. Hosts may have three-part paths, or slugs with a version to drop."""
    h, p = host(url), F.transform(path_parts(url), F.lower)
    three = h.rlike(three_part_hosts) & (F.size(p) == 3) & (F.get(p, F.lit(0)) == "products")
    two = (F.size(p) == 2) & F.get(p, F.lit(0)).rlike(f"^(?:{kinds})$")
    slug = F.when(h.rlike(versioned_hosts), F.regexp_replace(F.get(p, F.lit(1)), r"_\d+$", "")).otherwise(F.get(p, F.lit(1)))
    return F.when(three, F.concat_ws("/", h, F.array_join(p, "/"))).when(two, F.concat_ws("/", h, F.get(p, F.lit(0)), slug))


def page_key(url: Column) -> Column:
    """host/path without scheme, www, query, fragment or a slash at the end."""
    return F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", ""))


def cleaned(url: Column) -> Column:
    """Without tracking parameters or a fragment of them; a second question mark begins what is dropped."""
    u = F.regexp_replace(url, r"^([^?]*\?[^?]*)\?.*$", "$1")
    u = F.regexp_replace(u, rf"(?i)([?&])(?:{TRACKING})=[^&#]*(?=&|#|$)", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"&{2,}", "&"), r"\?&+", "?")
    return F.regexp_replace(F.regexp_replace(u, r"[?&]+(?=#|$)", ""), r"#(?:utm_|:~).*$", "")


def is_secure(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https://[^/\s]+"), F.lit(False))


def image_code(url: Column) -> Column:
    """The 13-digit article code in an image's address."""
    return F.nullif(F.regexp_extract(url, r"(?<!\d)(4[59]\d{11})(?!\d)", 1), F.lit(""))


def search_url(base: str, words: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(words))


def pseudonym(text: Column) -> Column:
    """A short stable code of a name that doesn't tell it: base 36 of a 32-bit hash."""
    return F.lower(F.conv(F.crc32(text).cast("string"), 10, 36))


#: Agents that aren't readers (fixed values).
AUTOMATION = r"headless|puppeteer|playwright|selenium|phantomjs|curl/|wget/|python-requests|node-fetch|axios"
CRAWLERS = r"bot|crawl|spider|slurp|facebookexternalhit|preview"


def is_countable_agent(agent: Column) -> Column:
    return F.coalesce(~F.lower(agent).rlike(AUTOMATION) & ~F.lower(agent).rlike(CRAWLERS), F.lit(False))


def log_decision(opted_out: Column, production: Column, agent: Column) -> Column:
    """skip or store, and why; the first reason that holds."""
    why = F.when(opted_out, "opted_out").when(~production, "not_production").when(F.lower(agent).rlike(AUTOMATION), "automation").when(F.lower(agent).rlike(CRAWLERS), "crawler")
    return F.struct(F.when(why.isNull(), "store").otherwise("skip").alias("action"), why.alias("reason"))


#: Names of one's own machine, and the ends of names of development and preview hosts (fixed values).
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "[::1]")
TRIAL_HOSTS = (".localhost", ".local", ".vercel.app")


def is_production_host(name: Column) -> Column:
    h = F.lower(name)
    trial = h.isin(*LOCAL_HOSTS)
    for end in TRIAL_HOSTS:
        trial |= h.endswith(end)
    return ~trial


def is_verified_shop(source: Column, addresses: list[Column], pairs: list[tuple[str, str, str]]) -> Column:
    """Whether one of a row's addresses is a page of a shop that was checked for its source. `pairs`: source, host, pattern of the path."""
    found = F.lit(False)
    for url in addresses:
        own = F.regexp_replace(host(url), r"^www\.", "")
        for shop, name, path in pairs:
            there = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).rlike(path)
            found |= F.coalesce((source == shop) & (own == name) & there, F.lit(False))
    return found
