"""Text normalisation, accent folding and negation-aware matching, all inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ABSENT_MARKS


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Anything a plain lower-casing leaves untidy: runs of spaces or characters beyond plain ASCII.
_UNTIDY = r"  |[^ -~]"


def _tidy(value: Column | str) -> Column:
    lowered = F.lower(col(value))
    spaced = F.regexp_replace(F.replace(lowered, F.lit("ß"), F.lit("ss")), r"(?U)\s+", " ")
    return F.trim(F.when(F.rlike(lowered, F.lit(_UNTIDY)), spaced).otherwise(lowered))


def squash(value: Column | str) -> Column:
    """Lower-cased, trimmed text with single spaces; NULL when blank."""
    return F.nullif(_tidy(value), F.lit(""))


def _accent_table() -> tuple[str, str]:
    # Derived from the Unicode rule itself: a letter whose decomposition is one base plus marks.
    accented, plain = [], []
    for point in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFKD", chr(point).lower())
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(point).lower():
            accented.append(chr(point).lower())
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def _plain(value: Column | str) -> Column:
    lowered = F.lower(col(value))
    spaced = F.regexp_replace(F.replace(lowered, F.lit("ß"), F.lit("ss")), r"(?U)\s+", " ")
    bare = F.regexp_replace(F.translate(spaced, _ACCENTED, _PLAIN), r"\p{M}+", "")
    return F.trim(F.when(F.rlike(lowered, F.lit(_UNTIDY)), bare).otherwise(lowered))


def fold(value: Column | str) -> Column:
    """Accent-insensitive form of :func:`squash`."""
    return F.nullif(_plain(value), F.lit(""))


def known(value: Column | str) -> Column:
    """Folded text, with placeholder words read as NULL."""
    return F.nullif(F.regexp_replace(_plain(value), r"^(?:unknown|n/a|-|sconosciuto)$", ""), F.lit(""))


def present(value: Column | str) -> Column:
    """True when a value is neither NULL nor an 'unknown' placeholder."""
    c = col(value)
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin(*ABSENT_MARKS), F.lit(False))


def full_text(*columns: Column | str) -> Column:
    """Title and description joined by one space; a missing part counts as empty text."""
    return F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in columns])


# How many characters before a phrase are looked at, and the negations they may end with.
NEGATIONS = r"\b(?:non|no|nessun[oa]?|senza|mai)\s+"
WIDE_NEGATION = (40, NEGATIONS + r"(?:(?:e|è|stata|stato|sono|ha|avuto)\s+)*$")
NARROW_NEGATION = (24, NEGATIONS + r"(?:(?:è|stata|stato)\s+)?$")
TRAILING_NEGATION = (20, r"\b(?:non|no|senza)\s*$")


def unpreceded(text: Column, pattern: str, before: tuple[int, str], group: int = 0) -> Column:
    """What ``group`` holds in each match of ``pattern`` whose preceding text doesn't end with ``before``.

    ``before`` is a number of characters and a pattern that ends with ``$``; it is tried on just that many
    characters before the match. Matches are found from left to right, whatever precedes them. Texts
    without a match are scanned once.
    """
    window, ending = before
    full = F.lit("(?iuU)" + pattern)
    whole, wanted = F.regexp_extract_all(text, full, F.lit(0)), F.regexp_extract_all(text, full, F.lit(group))
    # The piece before a match and what came before that piece: enough to know the last characters.
    steps = F.arrays_zip(F.slice(F.split(text, "(?iuU)" + pattern, -1), 1, F.size(whole)).alias("piece"), whole.alias("whole"), wanted.alias("wanted"))
    start = F.struct(F.lit("").alias("tail"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, m: Column) -> Column:
        tail = F.right(F.concat(state["tail"], m["piece"]), F.lit(window))
        kept = F.when(F.rlike(tail, F.lit("(?iuU)" + ending)), state["kept"]).otherwise(F.array_append(state["kept"], m["wanted"]))
        return F.struct(F.right(F.concat(tail, m["whole"]), F.lit(window)).alias("tail"), kept.alias("kept"))

    return F.when(F.rlike(text, full), F.aggregate(steps, start, step, lambda s: s["kept"])).otherwise(
        F.when(text.isNotNull(), F.array().cast("array<string>"))
    )


def declared(text: Column, pattern: str, negation: tuple[int, str] = WIDE_NEGATION) -> Column:
    """Matches of ``pattern`` that no negation precedes, as an array of excerpts."""
    return unpreceded(text, pattern, negation)


def says(text: Column, pattern: str) -> Column:
    """Case-insensitive Unicode regex test; NULL text says nothing."""
    return F.coalesce(F.rlike(text, F.lit("(?iuU)" + pattern)), F.lit(False))


def labels(**conditions: Column) -> Column:
    """Array of the names whose condition holds, in the stated order."""
    return F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()]),
        lambda x: x.isNotNull(),
    )


def first_failure(*checks: tuple[str | Column, Column]) -> Column:
    """Text of the first failing check, NULL when all pass. A NULL condition does not fail."""
    return F.coalesce(*[F.when(bad, F.lit(message) if isinstance(message, str) else message) for message, bad in checks])


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer copies projected expressions into every later use, which repeats costly text
    scans. A one-element explode is a boundary it does not copy across; it adds no shuffle.
    """
    stage = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    keep = [c for c in df.columns if c not in columns]
    return df.withColumn("_stage", stage).select(*keep, *[F.col(f"_stage.{n}").alias(n) for n in columns])
