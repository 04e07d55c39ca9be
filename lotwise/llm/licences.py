"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, copyright lines dropped, punctuation and white
space made single spaces, equivalent spellings made one. Whole canonical texts, of a document and of
each of its lines, are then looked up by SHA-256 among those of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import _bound

# Pairs of spellings that licence texts use for the same word; the second is kept.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("cancelled", "canceled"), ("centre", "center"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("licence", "license"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("https", "http"),
)
_SPELLED = r"\b(" + "|".join(a for a, _ in SPELLINGS) + r")(?=s?\b)"
_COPYRIGHT = r"^[^\p{L}\p{N}©]*(copyright\b|\(c\)|©|all rights reserved)"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
# Known licences and notices, by their public identifiers.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("0BSD", _ZERO_BSD),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
)
#: Known texts up to which their digests are sent to every executor; more are shuffled.
BROADCAST_ROWS = 100_000


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for copyright lines and lines without letters or digits."""

    def spelled(plain: Column) -> Column:
        out = plain
        for a, b in SPELLINGS:
            out = F.regexp_replace(out, rf"\b{a}(?=s?\b)", b)
        return F.when(plain.rlike(_SPELLED), out).otherwise(plain)

    low = F.lower(line)
    plain = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    return F.when(low.rlike(_COPYRIGHT), F.lit("")).otherwise(_bound(plain, spelled))


def _canonical_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_remove(F.transform(lines, canonical_line), "")


def _digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_licences(spark: SparkSession) -> DataFrame:
    """The built-in licences: licence, text."""
    return spark.createDataFrame(list(KNOWN), "licence string, text string")


def licence_digests(known: DataFrame) -> DataFrame:
    """licence, digest and length of the canonical text, for ``known`` with licence and text; of several names for one text the least."""
    whole = F.concat_ws(" ", _canonical_lines(F.col("text")))
    return known.select("licence", whole.alias("t")).where("t <> '' and licence is not null").groupBy(_digest(F.col("t")).alias("digest"), F.length("t").alias("size")).agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document row: doc_id, whole_licence, n_notices, licences (sorted), canonical_sha256.

    ``whole_licence`` names the licence whose text the whole document is; ``n_notices`` counts lines that
    are a known text by themselves, ``licences`` names all of these. Null, empty and mark-only texts
    match nothing. Null ids and repeated rows are rows of their own; an empty table gives no rows, an
    empty list of licences no matches; extra columns are not read.
    """
    digests = licence_digests(known)
    sizes = sorted(r["size"] for r in digests.select("size").distinct().limit(BROADCAST_ROWS + 1).collect())
    if digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    # A text of another length than any known one can't be equal to it: it need not be looked up. A long list of lengths is left out.
    near = (lambda t: F.length(t).isin(sizes)) if len(sizes) <= 1000 else (lambda t: F.lit(True))

    def looked_up(lines: Column) -> Column:
        whole = F.concat_ws(" ", lines)
        own = F.struct(F.lit(True).alias("whole"), _digest(whole).alias("digest"))
        notices = F.transform(F.filter(lines, near), lambda t: F.struct(F.lit(False).alias("whole"), _digest(t).alias("digest")))
        return F.concat(F.array(own), notices)

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _bound(_canonical_lines(F.col("text")), looked_up).alias("texts"))
    rows = numbered.select("doc_id", "row", F.explode_outer("texts").alias("e")).select("doc_id", "row", "e.*")
    met = rows.join(digests.select(F.col("digest").alias("k_digest"), "licence"), F.col("digest") == F.col("k_digest"), "left").where(F.col("whole") | F.col("licence").isNotNull())
    notice = F.when(~F.col("whole"), F.col("licence"))
    return met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max(F.when(F.col("whole"), F.col("licence"))).alias("whole_licence"), F.count(notice).alias("n_notices"),
        F.concat_ws(",", F.sort_array(F.collect_set(notice))).alias("licences"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("canonical_sha256"),
    ).drop("row")
