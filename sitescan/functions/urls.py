"""URL parts, as plain text operations.

`parse_url` is not used: it gives NULL for authorities that a lenient reader
accepts, and the rules here only need scheme and authority.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import EMPTY_URL_WORDS, NOISE_DOMAINS
from .text import strip


def url_authority(url):
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def normalize_url(raw, strict_host: bool = False) -> Column:
    """The usable URL in a raw cell, or NULL.

    The only test on the host is a dot somewhere in the authority.
    `strict_host` asks for a real dotted host name instead.
    """
    text = strip(raw)
    url = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    authority = url_authority(url)
    brackets_match = authority.contains("[") == authority.contains("]")
    usable = ~F.lower(text).isin(*EMPTY_URL_WORDS) & authority.contains(".") & brackets_match
    if strict_host:
        usable = usable & authority.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(:[0-9]+)?$")
    return F.when(usable, url)


def url_origin(url) -> Column:
    """Scheme and authority; `://` when there is neither."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.concat(scheme, F.lit("://"), authority)


def host_key(url) -> Column:
    """The host that rate limits apply to: no user part, no port, lower case."""
    place = F.lower(F.regexp_replace(url_authority(url), "^.*@", ""))
    host = F.when(
        place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)
    ).otherwise(F.regexp_extract(place, "^[^:]*", 0))
    return F.when(host != "", host).otherwise(url)


def is_noise(href, mode: str = "contains", domains=NOISE_DOMAINS) -> Column:
    """Does the link point at a noise domain?

    `contains` looks for the domain anywhere in the link, so `x.com` also hits
    `netflix.com`; `host_suffix` compares whole host labels.
    """
    escaped = "|".join(d.replace(".", r"\.") for d in domains)
    if mode == "contains":
        return href.rlike(escaped)
    if mode == "host_suffix":
        return F.regexp_replace(host_key(href), r"\.$", "").rlike(rf"(?:^|\.)(?:{escaped})$")
    raise ValueError(f"unknown noise mode: {mode!r}")


def resolve_link(href, page_url) -> Column:
    """An absolute form of `href` as found on `page_url`, or NULL for non-links."""
    link = strip(href)
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    directory = F.regexp_extract(page_url, r"^([a-z]+://[^/?#]*/(?:[^?#]*/)?)", 1)
    base = F.when(directory != "", directory).otherwise(F.concat(url_origin(page_url), F.lit("/")))
    return (
        F.when(link.isNull() | (link == "") | link.startswith("#"), None)
        .when(link.rlike("^(?i)https?://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(url_origin(page_url), link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(page_url, r"^([^?#]*)", 1), link))
        .otherwise(F.concat(base, link))
    )
