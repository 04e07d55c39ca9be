"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most three of 64 bits agree in one of four 16-bit blocks, so equal
blocks bring together what may link. There, fingerprints are sorted by Gray rank; leaves of
neighbours, and nodes over leaves, keep the bits on which all below agree. Two nodes whose agreed bits
already differ too often are left with all they hold. What links is joined at once, so a group of near
copies sends a link for each fingerprint, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.session import cut_lineage

from .components import connected

BITS, BLOCKS, SEED = 64, 4, 42
LEAF, FAN_OUT = 16, 8
#: Node pairs opened at a time.
PAIRS_AT_ONCE = 8192


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text: A-Z lower-cased, words between ASCII white space, repeated shingles counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()
    ends = (ends - 1).tolist()
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts, ends[shingle - 1 :], strict=False)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fingerprint (bigint of the same bits) of every row."""

    @F.pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), hashed("text").alias("fingerprint"))


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _roots(label: np.ndarray) -> np.ndarray:
    while not np.array_equal(label, up := label[label]):
        label = up
    return label


def _opened(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of what the nodes of each pair hold; within one node each pair once."""
    wide, high = last[b] - first[b], (last[a] - first[a]) * (last[b] - first[b])
    pair = np.repeat(np.arange(len(a)), high)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(high) - high, high)
    x, y = first[a][pair] + at // wide[pair], first[b][pair] + at % wide[pair]
    keep = (a[pair] != b[pair]) | (x <= y)
    return x[keep], y[keep]


def link_groups(group: np.ndarray, bits: np.ndarray, distance: int = 3) -> np.ndarray:
    """For fingerprints sorted by group and Gray rank: the row that each row is linked to, directly or not.

    Groups are apart from each other. The index has leaves of LEAF rows and nodes of FAN_OUT nodes; a
    level's node holds the bits that all of its rows share. Pairs of nodes are opened depth first.
    """
    n = len(bits)
    label = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    levels = []  # from the leaves up: first and last below, agreed bits, their mask
    below_start, below_count, low, high = starts, np.diff(np.append(starts, n)), bits, bits
    width = LEAF
    while True:
        count = -(-below_count // width)
        node_group = np.repeat(np.arange(len(starts)), count)
        node_start = np.cumsum(count) - count
        ordinal = np.arange(len(node_group)) - node_start[node_group]
        first = below_start[node_group] + ordinal * width
        last = np.minimum(first + width, below_start[node_group] + below_count[node_group])
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        levels.append((first, last, low, ~(low ^ high)))
        if (count == 1).all():
            break
        below_start, below_count, width = node_start, count, FAN_OUT

    def near(level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, agreed, mask = levels[level]
        keep = np.bitwise_count((agreed[x] ^ agreed[y]) & mask[x] & mask[y]) <= distance
        return x[keep], y[keep]

    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            stack.append((level, a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]))
            a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE]
        first, last = levels[level][:2]
        if level:
            x, y = near(level - 1, *_opened(a, b, first, last))
            if len(x):
                stack.append((level - 1, x, y))
            continue
        # Leaves whose rows are all joined already can add nothing.
        least, most = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
        new = (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
        x, y = _opened(a[new], b[new], first, last)
        close = np.bitwise_count(bits[x] ^ bits[y]) <= distance
        x, y = x[close], y[close]
        while len(x):
            p, q = label[x], label[y]
            apart = p != q
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            if not len(x):
                break
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            label = _roots(label)
    return label


def _linked(distance: int):
    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(level1, level2, bits):
            if not len(bits):
                return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
            order = np.lexsort((gray_rank(bits), level2, level1))
            level1, level2, bits = level1[order], level2[order], bits[order]
            group = np.cumsum(np.concatenate(([0], (level1[1:] != level1[:-1]) | (level2[1:] != level2[:-1]))))
            label = link_groups(group, bits, distance)
            joined = np.flatnonzero(label != np.arange(len(label)))
            return pd.DataFrame({"a": bits[joined].view(np.int64), "b": bits[label[joined]].view(np.int64)})

        for batch in batches:
            if not len(batch):
                continue
            new = batch["block"].to_numpy(np.int64), batch["part"].to_numpy(np.int64), batch["fingerprint"].to_numpy(np.int64).view(np.uint64)
            rows = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
            open_from = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1 if ((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).any() else 0
            held = tuple(r[open_from:] for r in rows)  # the last group may go on
            if open_from:
                yield links(*(r[:open_from] for r in rows))
        yield links(*held)

    return linked


def _block(bits: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))


def near_links(prints: DataFrame, distance: int = 3, split_above: int = 50_000) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints at ``distance`` or fewer differing bits, directly or not.

    Rows meet by an equal 16-bit block. A block with more than ``split_above`` fingerprints is dealt out
    by a second equal 12-bit part of its other 48 bits, which the same reasoning allows; all links stay.
    """
    if distance >= BLOCKS:
        raise ValueError(f"distance must be below {BLOCKS}")
    bits = F.col("fingerprint")
    blocks = F.array(*(F.struct((_block(bits, 16 * i, 16) + F.lit(i << 16)).alias("block"), F.lit(i).alias("i")) for i in range(BLOCKS)))
    met = prints.select("fingerprint", F.explode(blocks).alias("k")).select("fingerprint", "k.block", "k.i")
    # At most 4 * 2^16 rows by the width of a block, so these may be broadcast.
    large = met.groupBy("block").count().where(F.col("count") > split_above).select(F.col("block").alias("large"))
    turned = F.lit(None).cast("bigint")
    for i in range(BLOCKS):
        turned = F.when(F.col("i") == i, F.shiftleft(bits, 48 - 16 * i).bitwiseOR(F.shiftrightunsigned(bits, 16 * i + 16)) if i < 3 else bits).otherwise(turned)
    parts = F.array(*(_block(F.col("turned"), 12 * j, 12) + F.lit(j << 12) for j in range(BLOCKS)))
    dealt = met.join(F.broadcast(large), F.col("block") == F.col("large"), "left").withColumn("turned", turned)
    dealt = dealt.select("fingerprint", "block", F.explode(F.when(F.col("large").isNotNull(), parts).otherwise(F.array(F.lit(-1).cast("bigint")))).alias("part"))
    return dealt.repartition("block", "part").sortWithinPartitions("block", "part").mapInPandas(_linked(distance), "a bigint, b bigint")


def components(prints: DataFrame, distance: int = 3) -> DataFrame:
    """fingerprint and root (a fingerprint of its component) of every distinct fingerprint."""
    distinct = prints.select("fingerprint").distinct()
    roots = connected(near_links(distinct, distance))
    return distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the least doc_id that
    links reach, the document's own included. Null and empty texts have fingerprint zero and link like
    any. A null doc_id never names a component (it is null if all are); repeated rows are rows of one
    component; empty tables give no rows; extra columns are not read.
    """
    prints = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    ids = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    root_of = cut_lineage(components(ids, distance), "roots")
    least = ids.join(root_of, "fingerprint").groupBy("root").agg(F.min("least").alias("component_id"))
    named = root_of.join(least, "root").select("fingerprint", "component_id")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(named, "fingerprint").select("doc_id", hexed.alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, keys: DataFrame, root_of: DataFrame, node: str) -> DataFrame:
    """One document of each root: ``keys`` has doc_id, text_key and node of every row, ``root_of`` the root of every node."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("first")
    by_node = keys.groupBy(node).agg(first)
    kept = by_node.join(root_of, node).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__kept"))
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    stay = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["__id"]) & (keyed["__key"] == kept["__kept"]), "left_semi")
    return stay.dropDuplicates(["doc_id", "__key"]).drop("__key")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One document of each component, with all its columns: the least doc_id, null last, then the least hash of the text.

    Of rows that repeat both, one stays.
    """
    prints = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    root_of = cut_lineage(components(prints, distance), "roots")
    return first_of_each(docs, prints, root_of, "fingerprint")
