"""JSON originals: typed path access and canonical signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dotted(path: str) -> str:
    """``a.0.b`` as a variant path: digits index arrays, names index objects."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))


def at(document: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(col(document), dotted(path), kind)


def kind_of(document: Column | str, path: str) -> Column:
    """Type name of a value: BIGINT, STRING, BOOLEAN, DOUBLE, DECIMAL(..), OBJECT.., ARRAY.."""
    return F.schema_of_variant(F.try_variant_get(col(document), dotted(path), "variant"))


def strict_int(document: Column | str, path: str) -> Column:
    """The value only when the document states a whole JSON number, not text, 1.0 or true."""
    return F.when(kind_of(document, path) == "BIGINT", at(document, path, "bigint"))


def lenient_int(document: Column | str, path: str) -> Column:
    """A whole JSON number or a text of digits."""
    k = kind_of(document, path)
    text = at(document, path)
    return F.when(k == "BIGINT", at(document, path, "bigint")).when(
        (k == "STRING") & F.rlike(text, F.lit(r"^\d+$")), text.try_cast("bigint")
    )


def instant(text: Column | str) -> Column:
    """Timestamp of an ISO text that states its offset; NULL without one."""
    c = col(text)
    return F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}[T ].*(?:Z|[+-]\d{2}:?\d{2})$")), c.try_cast("timestamp"))


def signature(*columns: str) -> Column:
    """sha256 of the named columns as JSON in name order; missing values leave no key."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
