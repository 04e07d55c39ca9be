"""URL checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def http_url(url: Column | str) -> Column:
    """True for an absolute http(s) URL with a host."""
    return F.coalesce(F.rlike(col(url), F.lit(r"(?i)^https?://[^/?#\s]+")), F.lit(False))


def _reserved_address(h: Column) -> Column:
    # Address blocks that are never globally routable.
    blocks = (
        r"^(?:0|10|127)\.", r"^192\.168\.", r"^169\.254\.", r"^172\.(?:1[6-9]|2\d|3[01])\.",
        r"^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.", r"^(?:22[4-9]|2[3-5]\d)\.", r"^192\.0\.[02]\.",
        r"^198\.1[89]\.", r"^198\.51\.100\.", r"^203\.0\.113\.",
    )
    numeric = F.rlike(h, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$"))
    return (numeric & F.rlike(h, F.lit("|".join(blocks)))) | h.contains(":")


def public_https(url: Column | str) -> Column:
    """True for an https URL on a public host: no credentials, odd port or private name."""
    u = col(url)
    h = host(u)
    port = F.regexp_extract(u, r"^https://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    fine = (
        F.rlike(u, F.lit(r"^https://"))
        & h.isNotNull()
        & F.try_parse_url(u, F.lit("USERINFO")).isNull()
        & port.isin("", "443")
        & h.contains(".")
        & ~F.rlike(h, F.lit(r"\.(?:local|internal|localhost)$"))
        & ~_reserved_address(h)
    )
    return F.coalesce(fine, F.lit(False))


def host_within(url: Column | str, roots: tuple[str, ...]) -> Column:
    """True when the host equals one of ``roots`` or is a subdomain of it."""
    h = host(url)
    hits = [(h == r) | h.endswith("." + r) for r in roots]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return F.coalesce(out, F.lit(False))


def bare_host(url: Column | str) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")
