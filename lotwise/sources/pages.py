"""Bulk extraction from raw HTML pages with built-in expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_SCRIPT = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
_NEXT_DATA = r"(?is)<script\b(?=[^>]*\bid\s*=\s*[\"']?__NEXT_DATA__[\"'\s>])[^>]*>(.*?)</script\s*>"


def _character(reference: Column) -> Column:
    """Character of one reference, by number or by its standard name; an unknown name stays as it is."""
    names = F.create_map(*(F.lit(x) for name, point in name2codepoint.items() for x in (name, chr(point))), F.lit("apos"), F.lit("'"))
    body = F.substring(reference, F.lit(2), F.char_length(reference) - 2)
    digits = F.regexp_extract(body, r"^#[xX]?([0-9a-fA-F]+)$", 1)
    point = F.when(F.rlike(body, F.lit("^#[xX]")), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
    usable = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    numbered = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise("\ufffd")
    return F.when(body.startswith("#"), numbered).otherwise(F.coalesce(F.try_element_at(names, body), reference))


def unescape(text: Column) -> Column:
    """Character references decoded once: what a decoded ampersand begins stays text."""
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))), lambda r: F.struct((_character(r) == "&").alias("last"), r.alias("from"), _character(r).alias("to")))
    decoded = F.aggregate(F.array_sort(found), text, lambda out, r: F.replace(out, r["from"], r["to"]))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def plain_text(html: Column | str) -> Column:
    """Text of an HTML fragment; br, p and li start a new line, other tags vanish."""
    body = F.regexp_replace(col(html), r"(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?i)<(?:br|p|li)\b[^>]*>", "\n")
    body = F.regexp_replace(body, r"(?s)</?[a-zA-Z][^>]*>", "")
    return F.coalesce(F.regexp_replace(unescape(body), r"(?U)^\s+|\s+$", ""), F.lit(""))


def visible_text(html: Column | str) -> Column:
    """:func:`plain_text` without scripts and styles, for whole pages."""
    return plain_text(F.regexp_replace(col(html), _SCRIPT, ""))


def page_title(html: Column | str) -> Column:
    """Text of the only h1 of a page; NULL when there is none or more than one."""
    bare = F.regexp_replace(F.regexp_replace(col(html), _SCRIPT, ""), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"), F.lit(1))
    text = unescape(F.regexp_replace(F.element_at(found, 1), r"(?s)</?[a-zA-Z][^>]*>", " "))
    return F.when(F.size(found) == 1, F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def page_props(html: Column | str, country: str = "it") -> Column:
    """The page properties JSON as VARIANT: exactly one data script, for the expected country."""
    found = F.regexp_extract_all(col(html), F.lit(_NEXT_DATA), F.lit(1))
    data = F.when(F.size(found) == 1, F.try_parse_json(F.element_at(found, 1)))
    props = F.try_variant_get(data, "$.props.pageProps", "variant")
    iso = F.try_variant_get(props, "$.marketplace.country.iso", "string")
    return F.when(iso == country, props)


def declared_language(html: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(col(html), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, language, visible text and data script of every page."""
    return pages.withColumns({
        "page_title": page_title(html), "page_lang": declared_language(html), "page_text": visible_text(html), "page_props": page_props(html)
    })


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Distinct link targets of every page."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return pages.select(key, F.explode(F.array_distinct(found)).alias("href"))
