"""Periodic runs of words: stretches whose words repeat at a fixed distance three times or more.

Texts of a batch become one sequence of numbers in which words of different texts differ, so nothing
matches across texts. Prefix doubling ranks every stretch of 1, 2, 4, ... words and ends in the suffix
array. A block of 2^k words that starts at a multiple of its length is looked up in the window that
follows it: its stretch of the suffix array, in a wavelet tree, gives the first and last start there.
Starts of one block in a window of its own length form an arithmetic progression. Up to two are
candidate periods; of a longer one, whose step is a period of the block, only the starts that put the
ends of that inner periodic stretch upon each other can be periods of something longer. Candidates are
extended to both sides by the ranks of equal stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are worked on side by side; a longer text is a batch of its own.
BATCH_WORDS = 1 << 17
#: A run has at least this many words and periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The smallest block, as a power of two: a run of 24 words has a whole block of 8 in its first 15.
FIRST_BLOCK = 3

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Stretches:
    """Ranks of all stretches of 2^k symbols of a sequence, its suffix array, and what is asked of them."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank, open_at = self._named(order, np.diff(symbols[order], prepend=symbols[order[:1]] - 1) != 0, n)
        self.ranks, step = [rank], 1
        #: Positions of the suffix array whose suffixes are equal so far, in groups that follow one another.
        while len(open_at) and step < n:
            rank = rank.copy()
            suffix = order[open_at]
            later = suffix + step
            second = np.where(later < n, self.ranks[-1][np.minimum(later, n - 1)], -1)
            first = self.ranks[-1][suffix]
            by = np.lexsort((second, first))
            order[open_at] = suffix[by]
            first, second = first[by], second[by]
            new = np.ones(len(by), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            begins = np.flatnonzero(new)
            sizes = np.diff(np.append(begins, len(by)))
            rank[order[open_at]] = np.repeat(open_at[begins], sizes)
            self.ranks.append(rank)
            open_at = open_at[np.repeat(sizes > 1, sizes)]
            step *= 2
        self.suffixes = order
        self._bits = max(1, int(n - 1).bit_length())
        self._zeros, self._split = [], []
        level = order
        for bit in range(self._bits - 1, -1, -1):
            zero = (level >> bit) & 1 == 0
            self._zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            self._split.append(int(self._zeros[-1][-1]))
            level = np.concatenate([level[zero], level[~zero]])

    @staticmethod
    def _named(order: np.ndarray, new: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, n))
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(begins, sizes)
        return rank, np.flatnonzero(np.repeat(sizes > 1, sizes))

    def interval(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of the suffix array that begins with the 2^k symbols at each position."""
        rank = self.ranks[k]
        sizes = np.bincount(rank, minlength=len(rank))
        return rank[at], rank[at] + sizes[rank[at]]

    def below(self, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many starts in each part of the suffix array lie before ``start``."""
        low, high, count = low.astype(np.int64), high.astype(np.int64), np.zeros(len(low), np.int64)
        for depth in range(self._bits):
            zeros, split = self._zeros[depth], self._split[depth]
            one = (start >> (self._bits - 1 - depth)) & 1 == 1
            zl, zh = zeros[low], zeros[high]
            count += np.where(one, zh - zl, 0)
            low, high = np.where(one, split + low - zl, zl), np.where(one, split + high - zh, zh)
        return np.where(start >= 1 << self._bits, count + high - low, count)

    def nth(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The start with ``place`` others of its part of the suffix array before it."""
        low, high, place, value = low.astype(np.int64), high.astype(np.int64), place.copy(), np.zeros(len(low), np.int64)
        for depth in range(self._bits):
            zeros, split = self._zeros[depth], self._split[depth]
            zl, zh = zeros[low], zeros[high]
            one = place >= zh - zl
            place -= np.where(one, zh - zl, 0)
            value = value * 2 + one
            low, high = np.where(one, split + low - zl, zl), np.where(one, split + high - zh, zh)
        return value

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from ``a`` and from ``b`` (a < b) on."""
        n, length = len(self.suffixes), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + length, b + length
            whole = y + (1 << k) <= n
            same = whole & (self.ranks[k][np.where(whole, x, 0)] == self.ranks[k][np.where(whole, y, 0)])
            length += np.where(same, 1 << k, 0)
            # Beyond the longest ranked stretch, the same step may hold again.
            while k == len(self.ranks) - 1 and same.any():
                x, y = a + length, b + length
                whole = same & (y + (1 << k) <= n)
                same = whole & (self.ranks[k][np.where(whole, x, 0)] == self.ranks[k][np.where(whole, y, 0)])
                length += np.where(same, 1 << k, 0)
        return length

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends just before ``a`` and just before ``b`` (a < b)."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            same = np.ones(len(a), bool)
            while same.any():
                x, y = a - length - (1 << k), b - length - (1 << k)
                whole = same & (x >= 0)
                same = whole & (self.ranks[k][np.where(whole, x, 0)] == self.ranks[k][np.where(whole, y, 0)])
                length += np.where(same, 1 << k, 0)
                if k < len(self.ranks) - 1:
                    break
        return length


def _candidates(text: Stretches, k: int, at: np.ndarray, from_: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of 2^k symbols and distances from them to starts in [from, to) that may be periods."""
    low, high = text.interval(k, at)
    some = high - low > 1  # a block that occurs once has no other start
    at, low, high, from_, to = at[some], low[some], high[some], from_[some], to[some]
    before = text.below(low, high, from_)
    count = text.below(low, high, to) - before
    some = count > 0
    at, low, high, before, count = at[some], low[some], high[some], before[some], count[some]
    first = text.nth(low, high, before)
    out = [(at, first - at)]
    two = count == 2
    out.append((at[two], text.nth(low[two], high[two], before[two] + 1) - at[two]))
    many = count > 2
    at, first = at[many], first[many]
    step = text.nth(low[many], high[many], before[many] + 1) - first
    # The block and its starts in the window lie in stretches of period ``step``; a longer period maps their ends.
    out.append((at, first - text.behind(first, first + step) - (at - text.behind(at, at + step))))
    out.append((at, first + text.ahead(first, first + step) - (at + text.ahead(at, at + step))))
    at, period = (np.concatenate([pair[i] for pair in out]) for i in (0, 1))
    fits = (period > 0) & (at + period < len(text.suffixes))
    return at[fits], period[fits]


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """All runs of a sequence, rows of start, length and smallest period, by start and then period."""
    n = len(symbols)
    none = np.zeros((0, 3), np.int64)
    if n < LEAST_WORDS:
        return none
    text = Stretches(symbols)
    found = []
    for k in range(FIRST_BLOCK, len(text.ranks)):
        block = 1 << k
        at = np.arange(0, n - block, block)
        if not len(at):
            break
        # Periods from the block's length to less than twice it; the smallest blocks have those below as well.
        windows = [(at + block, at + 2 * block)] + ([(at + 1, at + block)] if k == FIRST_BLOCK else [])
        for from_, to in windows:
            start, period = _candidates(text, k, at, from_, to)
            back = text.behind(start, start + period)
            length = back + period + text.ahead(start, start + period)
            good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(np.column_stack([start - back, length, period])[good])
    runs = np.concatenate([none, *found])
    # The smallest period of a stretch is found as well as its multiples; it comes first.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batched(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of neighbouring texts, so many that a batch has about ``BATCH_WORDS``."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
        if held and total + len(words) > BATCH_WORDS:
            yield first, held
            first, held, total = i, [], 0
        held.append(words)
        total += len(words)
    if held:
        yield first, held


def _judged(documents: list[list[bytes]]) -> Iterator[tuple[list[dict], str]]:
    """Runs of each document, and its words without those that a run repeats."""
    sizes = np.array([len(d) for d in documents])
    words, vocabulary = pd.factorize(np.array([w for d in documents for w in d] or [b""], object)[: sizes.sum()])
    owner = np.repeat(np.arange(len(documents)), sizes)
    runs = runs_of(owner * max(1, len(vocabulary)) + words)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    of = np.searchsorted(starts, runs[:, 0], side="right") - 1
    change = np.zeros(len(owner) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    edges = np.searchsorted(of, np.arange(len(documents) + 1))
    for i, document in enumerate(documents):
        own = runs[edges[i] : edges[i + 1]]
        rest = document if not len(own) else [w for w, k in zip(document, kept[starts[i] : starts[i + 1]], strict=True) if k]
        listed = [{"start": int(s - starts[i]), "length": int(length), "period": int(q)} for s, length, q in own]
        yield listed, b" ".join(rest).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with runs (start, length, period, in words, by start and then period) and collapsed, the text without repeats.

    Words are what white space of ASCII (space, tab, line feed, vertical tab, form feed, return) parts.
    A run is a stretch of words with smallest period q, of 24 words and 3 q or more, that no neighbouring
    word extends. Words that a run has after its first q are left out of ``collapsed``, whose words are
    joined by one space.

    Nothing is looked up across texts, so there is no shuffle; a text of any length is worked on whole, at
    some 200 bytes a word. Null and empty texts have no runs and an empty ``collapsed``. Repeated rows and
    null ids are judged like others. Empty tables give no rows. Columns named runs or collapsed are
    replaced; any other column stays.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]

    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            rows = [r for _, documents in _batched(list(series)) for r in _judged(documents)]
            yield pd.DataFrame({"runs": [r for r, _ in rows], "collapsed": [c for _, c in rows]})

    judge = F.pandas_udf(judged, f"runs {RUNS}, collapsed string")
    return docs.select(*kept).withColumn("__found", judge(F.col(text))).select(*kept, F.col("__found.runs").alias("runs"), F.col("__found.collapsed").alias("collapsed"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` whose text, in a tenth of the documents, goes on periodically from some word on; by a checksum of the id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("__words").cast("bigint")
    start = g % n
    period = F.lit(1) + F.floor((n - F.col("__a")) / (F.lit(3) + g % 8))
    moved = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(F.col("__words"), F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")))
    chosen = docs.withColumn("__words", F.when(h % 10 == 0, words)).withColumn("__a", F.when(n > 0, start)).withColumn("__p", F.when(n > 0, period))
    return chosen.withColumn("text", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text"))).select(*docs.columns)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exact length / period, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    # Products of exact decimals compare the fractions; the first of equals, by start and period, stays.
    wide = lambda c: c.cast("decimal(19,0)")
    better = lambda best, r: F.when(best.isNull() | (wide(r["length"]) * wide(best["period"]) > wide(best["length"]) * wide(r["period"])), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    return found.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("__best.start").alias("start"), F.col("__best.length").alias("length"), F.col("__best.period").alias("period"),
        F.expr("(1000 * __best.length) div __best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
