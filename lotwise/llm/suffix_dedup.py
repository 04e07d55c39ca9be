"""Removal of repeated byte strings with sharded suffix arrays.

Which strings can be equal is decided by content, so that equal ones meet in one shard:

* Every string of ``length`` bytes has an anchor, its byte 16-gram of least hash (the leftmost of
  equals). Neighbouring strings with one anchor are a segment; equal strings have equal anchors. An
  anchor seen once has no repeats, and equal segments travel once, with their number.
* Segments of an anchor are cut by the distance of string and anchor into slots of ``SLOT`` strings. All
  strings of a slot share a core; only members with equal cores can hold equal strings.
* A member is written as the bytes before the core, a code for the core, and the bytes after it, so
  it takes some 50 symbols for its 400 bytes and more. A shard's members make one text; its suffix
  array is built by induced sorting and its common prefixes by the permuted array. A string is repeated
  if its suffix shares as many symbols as the string has with a neighbour in the array.
* An anchor with more than ``MANY`` different segments isn't brought together: digests of its strings are
  counted, which combines before the shuffle and spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lotwise.session import cut_lineage

GRAM = 16
SLOT = 24
#: Symbols of a core's code; code digits are apart from bytes, so no other alignment can match.
CODE, DIGITS = 4, 256
_SEPARATOR, _BYTE, _DIGIT = 1, 2, 258
_ALPHABET = _DIGIT + DIGITS
#: Symbols that one suffix array takes, about.
SHARD_SYMBOLS = 400_000
#: Different segments of an anchor that one task takes.
MANY = 1000


def suffix_array(s: list[int], alphabet: int) -> list[int]:
    """Suffix array by induced sorting. ``s`` ends with its only 0; symbols are below ``alphabet``."""
    n = len(s)
    if n == 1:
        return [0]
    smaller = [False] * n  # whether the suffix is less than the next one
    smaller[-1] = True
    for i in range(n - 2, -1, -1):
        smaller[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and smaller[i + 1])
    leftmost = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]
    counts = np.bincount(s, minlength=alphabet)
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()

    def induced(order: list[int]) -> list[int]:
        out = [-1] * n
        tail = tails[:]
        for i in reversed(order):
            tail[s[i]] -= 1
            out[tail[s[i]]] = i
        head = heads[:]
        for i in out:  # grows while it is read
            if i > 0 and not smaller[i - 1]:
                c = s[i - 1]
                out[head[c]] = i - 1
                head[c] += 1
        tail = tails[:]
        for at in range(n - 1, -1, -1):
            i = out[at]
            if i > 0 and smaller[i - 1]:
                c = s[i - 1]
                tail[c] -= 1
                out[tail[c]] = i - 1
        return out

    end_of = dict(zip(leftmost, [*leftmost[1:], n - 1], strict=True))
    name, last, names = -1, None, {}
    for i in induced(leftmost):
        if i in end_of:
            piece = s[i : end_of[i] + 1]
            if piece != last:
                name, last = name + 1, piece
            names[i] = name
    if name + 1 < len(leftmost):
        order = [leftmost[i] for i in suffix_array([names[i] for i in leftmost], name + 1)]
    else:
        order = sorted(leftmost, key=names.__getitem__)
    return induced(order)


def permuted_common_prefixes(s: list[int], array: list[int]) -> tuple[list[int], list[int]]:
    """For every suffix: symbols shared with the one before it in the array, and that one (-1 for the first)."""
    before = [-1] * len(s)
    for a, b in zip(array, array[1:], strict=False):
        before[b] = a
    shared, k = [0] * len(s), 0
    for i, j in enumerate(before):
        if j < 0:
            k = 0
            continue
        while s[i + k] == s[j + k]:  # ends at the 0, which is there once
            k += 1
        shared[i] = k
        k = max(0, k - 1)
    return shared, before


def repeated_suffixes(s: list[int], least: int, alphabet: int) -> np.ndarray:
    """Whether each suffix shares its first ``least`` symbols with another."""
    shared, before = map(np.array, permuted_common_prefixes(s, suffix_array(s, alphabet)))
    found = shared >= least
    out = found.copy()
    out[before[found]] = True
    return out


def segments(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: its anchor's hash and place, its first string's start and the end of the starts."""
    if len(text) < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    factor, width = 0x9E3779B97F4A7C15, 1
    while width < GRAM:  # hash of twice the width from two of one
        x = x[:-width] + x[width:] * np.uint64(factor)
        factor, width = factor * factor % 2**64, 2 * width
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    # The upper half of the hash, then the place: the least is the leftmost of the least.
    least = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return x[at[first]], at[first], first, np.append(first[1:], len(at))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segment_rows(length: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                hashes, places, firsts, ends = segments(raw, length)
                n = len(firsts)
                # Equal texts at another distance from the anchor can't be: the anchor is part of the text.
                digests = [_signed(xxhash.xxh3_64_intdigest(raw[a : b + length - 1])) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
                for column, values in zip(out, (np.full(n, k1), np.full(n, k2), hashes.view(np.int64), np.array(digests, np.int64), firsts, ends - firsts, places - firsts), strict=True):
                    column.append(values)
            yield pd.DataFrame({name: np.concatenate(c) if c else np.zeros(0, np.int64) for name, c in zip(("k1", "k2", "anchor", "digest", "start", "strings", "place"), out, strict=True)})

    return rows


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rows += [(w["anchor"], w["digest"], w["copies"], w["strings"], w["place"], raw[w["start"] : w["end"]]) for w in wanted]
        yield pd.DataFrame(rows, columns=["anchor", "digest", "copies", "strings", "place", "bytes"])


class _Shard:
    """Members of many anchors; their repeated strings are found together."""

    def __init__(self, length: int):
        self.length = length
        self.symbols: list[np.ndarray] = []
        self.size, self.cores = 0, 0
        self.uses: list[tuple[int, int, list]] = []  # first symbol, strings, and the (found, start) of each use

    def add_anchor(self, held: list[tuple[int, int, int, bytes]], found: list[np.ndarray]) -> None:
        """``held``: copies, strings, place of the anchor and bytes of each distinct segment; ``found``: its flags, filled in."""
        inner = self.length - SLOT
        cores: dict[tuple, dict[tuple, list]] = {}
        for (copies, strings, place, raw), flags in zip(held, found, strict=True):
            if copies > 1:
                flags[:] = True
            first, last = place, place - strings + 1  # distance of a string's start to the anchor, from the left
            for slot in range(last // SLOT, first // SLOT + 1):
                # Strings whose distance is slot * SLOT + t share the bytes from slot * SLOT before the anchor on.
                high, low = min(first - slot * SLOT, SLOT - 1), max(last - slot * SLOT, 0)
                core_at = place - slot * SLOT
                start = core_at - high
                before, core, after = raw[start:core_at], raw[core_at : core_at + inner], raw[core_at + inner : core_at + self.length - low]
                member = cores.setdefault((slot, xxhash.xxh3_128_digest(core)), {}).setdefault((before, after), [0, []])
                member[0] += copies
                member[1].append((flags, start, high - low + 1))
        for members in cores.values():
            for copies, uses in members.values():
                if copies > 1:
                    for flags, start, strings in uses:
                        flags[start : start + strings] = True
            if len(members) > 1:
                self._write(members)

    def _write(self, members: dict[tuple, list]) -> None:
        code = [_DIGIT + (self.cores // DIGITS**i) % DIGITS for i in range(CODE)]
        self.cores += 1
        for (before, after), (_, uses) in members.items():
            row = np.concatenate([np.frombuffer(before, np.uint8).astype(np.int64) + _BYTE, code, np.frombuffer(after, np.uint8).astype(np.int64) + _BYTE, [_SEPARATOR]])
            self.uses.append((self.size, uses[0][2], uses))
            self.symbols.append(row)
            self.size += len(row)

    def solve(self) -> None:
        if not self.symbols:
            return
        text = [*np.concatenate(self.symbols).tolist(), 0]
        again = repeated_suffixes(text, SLOT + CODE, _ALPHABET)
        for first, strings, uses in self.uses:
            flags_here = again[first : first + strings]
            for flags, start, n in uses:
                flags[start : start + n] |= flags_here


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the runs that are set."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()


def _repeats(length: int):
    """Segments sorted by anchor give the runs of repeated strings of each."""

    def repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, done, open_anchor, held = _Shard(length), [], None, {}

        def close() -> None:
            if held:
                flags = [np.zeros(h[1], bool) for h in held.values()]
                shard.add_anchor(list(held.values()), flags)
                done.extend((open_anchor, digest, f) for digest, f in zip(held, flags, strict=True))

        def finished() -> pd.DataFrame:
            shard.solve()
            rows = [(anchor, digest, _runs(f)) for anchor, digest, f in done if f.any()]
            return pd.DataFrame(rows, columns=["anchor", "digest", "runs"]).astype({"anchor": "int64", "digest": "int64"})

        for batch in batches:
            for anchor, digest, copies, strings, place, raw in batch.itertuples(index=False):
                if anchor != open_anchor:
                    close()
                    open_anchor, held = anchor, {}
                    if shard.size >= SHARD_SYMBOLS or len(done) >= 50_000:
                        yield finished()
                        shard, done = _Shard(length), []
                held[digest] = (copies, strings, place, raw)
        close()
        yield finished()

    return repeats


def _strings(length: int):
    """Digest and place of every string of each segment."""
    names = ["d1", "d2", "anchor", "digest", "at", "copies"]

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _cut(batches):
            for anchor, digest, copies, n, _, raw in batch.itertuples(index=False):
                pairs = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(n)]), "<i8").reshape(-1, 2)
                yield pd.DataFrame(dict(zip(names, (pairs[:, 0], pairs[:, 1], np.full(n, anchor), np.full(n, digest), np.arange(n, dtype=np.int32), np.full(n, copies)), strict=True)))

    return strings


def _counted(holders: DataFrame, length: int) -> DataFrame:
    """anchor, digest and runs of the segments that ``holders`` want, by counts of string digests."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def runs(places: pd.Series) -> pd.Series:
        flags = (np.bincount(np.asarray(p)) > 0 for p in places)
        return pd.Series([_runs(f) for f in flags])

    strings = holders.mapInPandas(_strings(length), "d1 bigint, d2 bigint, anchor bigint, digest bigint, at int, copies bigint")
    again = strings.groupBy("d1", "d2").agg(F.sum("copies").alias("all_copies")).where("all_copies > 1").select("d1", "d2")
    repeated = strings.select("d1", "d2", "anchor", "digest", "at").join(again, ["d1", "d2"], "left_semi")
    return repeated.groupBy("anchor", "digest").agg(F.collect_list("at").alias("places")).select("anchor", "digest", runs("places").alias("runs"))


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, text, found in zip(batch["name"], batch["text"], batch["found"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for pair in [] if found is None else sorted(map(int, found)):
                a, b = pair >> 32, pair & 0xFFFFFFFF
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            at, left = 0, []
            for a, b in spans:
                left.append(raw[at:a])
                at = b
            rest = b"".join([*left, raw[at:]])
            rows.append((name, len(raw), len(raw) - len(rest), [{"start": a, "end": b} for a, b in spans], rest))
        yield pd.DataFrame(rows, columns=["name", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Takes out every byte covered by a string of ``length`` bytes that starts elsewhere too.

    Elsewhere is any other place of any document, the same one included; strings don't cross
    documents and are judged on the input. Returns for each row doc_id, n_bytes, n_removed, ``spans``
    (start, end; maximal runs of removed bytes) and ``kept`` (binary: what is left, which may cut
    characters). Null texts are empty; null ids and repeated rows are rows like any, so a repeated row is
    a repeat; an empty table gives no rows; extra columns are not read.

    Texts are shuffled once, by a hash of id and text, and read from there twice. Segments are told
    apart by 128 bits of hashes.
    """
    if length < GRAM + SLOT:
        raise ValueError(f"length must be {GRAM + SLOT} or more")
    text, name = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("string")
    keyed = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.coalesce(name, F.lit("null")), text).alias("k2"), name.alias("name"), text.alias("text"))
    found = keyed.select("k1", "k2", "text").mapInPandas(_segment_rows(length), "k1 bigint, k2 bigint, anchor bigint, digest bigint, start bigint, strings bigint, place bigint")
    places = cut_lineage(found, "segments")

    classes = places.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.max("strings").alias("strings"), F.max("place").alias("place"), F.min(F.struct("k1", "k2", "start")).alias("at"))
    met = classes.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("copies").alias("all_copies"))
    met = met.where("all_copies > 1").select("anchor", (F.col("n") > 1).alias("mixed"), (F.col("n") > MANY).alias("many"))
    classes = cut_lineage(classes.join(met, "anchor"), "segment-classes")

    end = F.col("at.start") + F.col("strings") + (length - 1)
    wanted = F.struct("anchor", "digest", "copies", "strings", "place", F.col("at.start").alias("start"), end.alias("end"))

    def holders(chosen: str) -> DataFrame:
        by_doc = classes.where(chosen).groupBy(F.col("at.k1").alias("w1"), F.col("at.k2").alias("w2")).agg(F.collect_list(wanted).alias("wanted"))
        # All joins read these columns of the texts, so they share one shuffle.
        return keyed.join(by_doc, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).select("name", "text", "wanted")

    cut = holders("mixed and not many").mapInPandas(_cut, "anchor bigint, digest bigint, copies bigint, strings bigint, place bigint, bytes binary")
    mixed = cut.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_repeats(length), "anchor bigint, digest bigint, runs array<int>")
    if not classes.where("many").isEmpty():
        mixed = mixed.union(_counted(holders("many"), length))
    # A segment that is alone with its anchor, but in several places, is repeated as a whole.
    alone = classes.where("not mixed").select("anchor", "digest", F.array(F.lit(0), F.col("strings").cast("int")).alias("runs"))

    hits = places.select("k1", "k2", "anchor", "digest", "start").join(mixed.union(alone), ["anchor", "digest"])
    pair = F.transform(
        F.sequence(F.lit(0), (F.size("runs") / 2 - 1).cast("int")),
        lambda i: F.shiftleft(F.col("start") + F.get("runs", 2 * i), 32).bitwiseOR(F.col("start") + F.get("runs", 2 * i + 1) + (length - 1)),
    )
    per_doc = hits.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.flatten(F.collect_list(pair)).alias("found"))
    both = keyed.join(per_doc, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left").select("name", "text", "found")
    done = both.mapInPandas(_kept, "name string, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return done.select(F.col("name").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")
