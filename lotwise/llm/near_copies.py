"""Near copies: SimHash groups, completed to all pairs of exact Jaccard similarity 0.8 or more of five-word shingles.

Sets of shingles get 64-bit SimHash fingerprints. Those that differ in few bits are grouped by the index of
``simhash``; each group's sets are compared with one of it. That joins most near copies, but at 0.8 two
fingerprints differ in some ten bits, which no index of 64 bits bridges, so what is still apart is completed:

Two sets of at least that similarity differ in at most a ninth of their sizes' sum. Sets of similar
sizes are cut by hash into a few more parts than that, so at least one part is equal on both sides and no
near copy is missed. A signature is the digest of a part. What shares one is compared with one member of the
signature, by several orders, so that a group of near copies joins without its pairs. Members of a signature
that still lie in different groups then meet in blocks within a task. Sets are compared by a byte for each
part first: only pairs with as many equal parts as near copies must have are compared by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StructField, StructType

from lotwise.session import cut_lineage

from . import simhash
from .components import connected

SHINGLE, SEED = 5, 42
#: Similarity of near copies: NEAR / OF.
NEAR, OF = 4, 5
#: Differing bits at which fingerprints are of one SimHash group.
BITS_APART = 3
#: Orders by which a signature's members are compared with one of them before the rest meet in blocks.
ROUNDS = 2
#: Members of a signature that one block holds; more are dealt to pairs of blocks.
BLOCK = 512
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z lower-cased, words between ASCII white space; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    n = min(SHINGLE, len(words))
    many = len(words) - n + 1
    out = np.full(many, n, np.uint64)
    for i in range(n):
        out += hashes[i : i + many] * _FACTORS[i]
    return np.unique(_mixed(out))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity of near copies."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OF * shared >= NEAR * (len(a) + len(b) - shared)


def _sizes() -> np.ndarray:
    """Least size of each class; a set's near copies are in its class or the next ones up and down."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(least[-1] * OF // NEAR + 1)
    return np.array(least, np.int64)


_LEAST = _sizes()


def size_class(n: int) -> int:
    """The class of a set of ``n`` elements."""
    return int(np.searchsorted(_LEAST, n, "right")) - 1


def cuts(level: int) -> tuple[int, int]:
    """The most elements by which near copies of a class differ, and the number of parts their sets are cut into."""
    most = int(_LEAST[level + 1]) - 1
    apart = (most + most * OF // NEAR) * (OF - NEAR) // (OF + NEAR)
    return apart, 1 if apart == 0 else -(-(apart + 1) * 27 // 25) + 3


def _parts(found: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that hold elements of a set, and the sum of each one's hashes."""
    part = ((found >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascends with the hashes
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return part[starts], np.add.reduceat(_mixed(found + _FACTORS[0]), starts)


def part_bytes(found: np.ndarray, level: int) -> np.ndarray:
    """A byte for each part of a set in a class: equal parts have equal bytes, empty ones 0."""
    parts = cuts(level)[1]
    out = np.zeros(parts, np.uint8)
    held, sums = _parts(found, parts)
    out[held] = (_mixed(sums) >> np.uint64(56)).astype(np.uint8) | np.uint8(1)
    return out


def signatures(found: np.ndarray) -> np.ndarray:
    """Digests of the parts of a set, in its own size class and as partner of the class below; the last bit is the class's."""
    if not len(found):
        return np.zeros(0, np.uint64)
    own, out = size_class(len(found)), []
    for level in {own, max(own - 1, 0)}:
        apart, parts = cuts(level)
        held, sums = _parts(found, parts)
        # Parts that are empty on both sides are equal too; they count only where both sets have this many.
        if parts - len(held) >= parts - apart:
            empty = np.setdiff1d(np.arange(parts), held)
            held, sums = np.append(held, empty), np.append(sums, np.zeros(len(empty), np.uint64))
        digests = _mixed(sums + held.astype(np.uint64) * _FACTORS[1] + np.uint64(level * int(_FACTORS[2]) % 2**64))
        out.append((digests & ~np.uint64(1)) | np.uint64(level & 1))
    return np.concatenate(out)


def _marks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (a hash of the shingle set) and fingerprint (the set's SimHash) of every row."""

    @F.pandas_udf("node bigint, fingerprint bigint")
    def marks(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(text) for text in texts]
        node = np.array([xxhash.xxh3_64_intdigest(found.tobytes()) for found in sets], np.uint64)
        return pd.DataFrame({"node": node.view(np.int64), "fingerprint": np.array([simhash.majority(found) for found in sets], np.uint64).view(np.int64)})

    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", text_key.alias("text_key"), marks("text").alias("m")).select("doc_id", "text_key", "m.*")


def _signed(docs: DataFrame) -> DataFrame:
    """signature and node of every set, once a task for each node."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            nodes, found = [], [np.zeros(0, np.uint64)]
            for text in batch["text"]:
                held = shingles(text)
                node = xxhash.xxh3_64_intdigest(held.tobytes())
                if node not in seen:
                    seen.add(node)
                    found.append(signatures(held))
                    nodes.append(np.full(len(found[-1]), node, np.uint64))
            yield pd.DataFrame({"signature": np.concatenate(found).view(np.int64), "node": np.concatenate([np.zeros(0, np.uint64), *nodes]).view(np.int64)})

    return docs.select("text").mapInPandas(signed, "signature bigint, node bigint")


@F.pandas_udf(BooleanType())
def _confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
    held: dict[str, np.ndarray] = {}

    def of(text: str) -> np.ndarray:
        if text not in held:
            if len(held) >= 64:
                held.clear()
            held[text] = shingles(text)
        return held[text]

    return pd.Series([similar(of(x), of(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(StructType([StructField("size_class", IntegerType()), StructField("own", BinaryType()), StructField("below", BinaryType())]))
def _sketched(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = shingles(text)
        level = size_class(len(found))
        rows.append((level, part_bytes(found, level).tobytes(), part_bytes(found, max(level - 1, 0)).tobytes()))
    return pd.DataFrame(rows, columns=["size_class", "own", "below"])


@F.pandas_udf(BooleanType())
def _may_be_near(class_a: pd.Series, own_a: pd.Series, below_a: pd.Series, class_b: pd.Series, own_b: pd.Series, below_b: pd.Series) -> pd.Series:
    out = []
    for ca, oa, la, cb, ob, lb in zip(class_a, own_a, below_a, class_b, own_b, below_b, strict=True):
        low = min(ca, cb)
        if abs(ca - cb) > 1:
            out.append(False)
            continue
        apart, parts = cuts(low)
        a, b = (np.frombuffer(own if level == low else below, np.uint8) for level, own, below in ((ca, oa, la), (cb, ob, lb)))
        out.append(int((a == b).sum()) >= parts - apart)
    return pd.Series(out, dtype=bool)


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) with as many equal parts as near copies must have."""
    both, columns = pairs, ("size_class", "own", "below")
    for k in "ab":
        both = both.join(sketches.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns)), k)
    return both.where(_may_be_near(*(f"{c}_{k}" for k in "ab" for c in columns))).select("a", "b")


def _gathered(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many stretches of a buffer, one after another."""
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return buffer[at]


def possible_pairs(rows: pd.DataFrame, group: list[str]) -> pd.DataFrame:
    """Pairs (a, b) within whole groups that may be near copies and have different roots; where a group has two sides, across these.

    ``rows`` are sorted by group; all of a group have a sketch in one class, which is ``own`` for some. Near
    copies of which the lower is in that class have all but ``apart`` parts equal.
    """
    new = np.ones(len(rows), bool)
    new[1:] = (rows[group].to_numpy()[1:] != rows[group].to_numpy()[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(rows)))
    end_of = np.repeat(starts + sizes, sizes)
    node, root, level, own, side = (rows[c].to_numpy() for c in ("node", "root", "level", "own", "side"))
    two_sided = np.repeat(np.maximum.reduceat(side, starts) > 0, sizes)
    first_byte = np.concatenate([[0], np.cumsum([len(v) for v in rows["sketch"]])])
    buffer = np.frombuffer(b"".join(rows["sketch"]), np.uint8)
    limits = np.array([cuts(c) for c in range(int(level.max()) + 1)])
    found, at, offset = [np.zeros((0, 2), np.int64)], np.arange(len(rows)), 1
    while len(at := at[at + offset < end_of[at]]):
        a, b = at, at + offset
        meet = (root[a] != root[b]) & (level[a] == level[b]) & (own[a] | own[b]) & (~two_sided[a] | (side[a] != side[b]))
        a, b = a[meet], b[meet]
        offset += 1
        parts = limits[level[a], 1]
        chunk = np.cumsum(parts) // (1 << 22)
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(chunk)) + 1):
            if len(part):
                x, y, n = a[part], b[part], parts[part]
                sketch = [_gathered(buffer, first_byte[i], n) for i in (x, y)]
                equal = np.add.reduceat((sketch[0] == sketch[1]).astype(np.int64), np.cumsum(n) - n)
                near = equal >= n - limits[level[x], 0]
                found.append(np.column_stack([node[x[near]], node[y[near]]]))
    pairs = np.concatenate(found)
    pairs.sort(axis=1)
    return pd.DataFrame(np.unique(pairs, axis=0), columns=["a", "b"])


def _blocked(left: DataFrame, sketches: DataFrame) -> DataFrame:
    """Possible pairs of all signatures: members by blocks, each pair of blocks whole in one task."""
    sizes = left.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = left.select("signature", "node", "root").join(sizes, "signature").join(sketches, "node").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("one"), F.greatest("mine", o).alias("two")))
    # A signature is of the set's own class or the one below, as its last bit says; the sketch of that class is enough.
    is_own = F.col("signature").bitwiseAND(F.lit(1)) == F.col("size_class").bitwiseAND(F.lit(1))
    sketch = F.struct(is_own.alias("own"), F.when(is_own, F.col("size_class")).otherwise(F.col("size_class") - 1).alias("level"), F.when(is_own, F.col("own")).otherwise(F.col("below")).alias("sketch"))
    dealt = dealt.withColumn("s", sketch).withColumn("p", F.explode(pair)).select("signature", "p.one", "p.two", (F.col("mine") != F.col("p.one")).cast("int").alias("side"), "node", "root", "s.*")
    group = ["signature", "one", "two"]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            rows = pd.concat([*held, rows], ignore_index=True)
            last = (rows[group] == rows[group].iloc[-1]).all(axis=1)
            if not last.all():
                yield possible_pairs(rows[~last], group)
            held = [rows[last]]
        if held:
            yield possible_pairs(held[0], group)

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInPandas(compared, "a bigint, b bigint").distinct()


def _simhash_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of a node and the least node of its SimHash group."""
    roots = cut_lineage(simhash.components(prints, BITS_APART), "simhash-roots")
    grouped = prints.join(roots, "fingerprint").select("node", "root")
    least = grouped.groupBy("root").agg(F.min("node").alias("a"))
    return grouped.join(least, "root").where("node <> a").select("a", F.col("node").alias("b"))


def near_links(marks: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links (a, b) of nodes that join all near copies, directly or not; None if no two sets share a signature."""
    # Signatures that one node alone has are most of them; they are shuffled once.
    same = Window.partitionBy("signature")
    signed = _signed(docs).withColumns({"low": F.min("node").over(same), "high": F.max("node").over(same)})
    members = cut_lineage(signed.where("low < high").select("signature", "node").distinct(), "members")
    if members.isEmpty():
        return None
    # Nodes without a shared signature have no near copy, whatever their fingerprints.
    held = cut_lineage(members.select("node").distinct(), "member-nodes")
    chosen = marks.join(held, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("fingerprint").alias("fingerprint"))
    chosen = cut_lineage(chosen, "members-texts")
    keyed = docs.select(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), "text")
    texts = cut_lineage(keyed.join(chosen.select("node", "text_key"), "text_key").groupBy("node").agg(F.first("text").alias("text")), "texts")
    sketches = cut_lineage(texts.select("node", _sketched("text").alias("s")).select("node", "s.*"), "sketches")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs, "possible")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        open_texts = texts.join(ends, "node", "left_semi")
        text_a, text_b = (open_texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
        return cut_lineage(pairs.join(text_a, "a").join(text_b, "b").where(_confirmed("text_a", "text_b")).select("a", "b"), "near")

    links = confirmed(_possible(_simhash_pairs(chosen.select("node", "fingerprint")), sketches))
    for turn in range(ROUNDS + 1):
        roots = connected(links).withColumnRenamed("node", "__node")
        rooted = members.join(roots, members["node"] == roots["__node"], "left").select("signature", "node", F.coalesce("root", "node").alias("root"))
        # A signature whose members are all joined can add nothing.
        pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "root")).alias("pivot")
        by_signature = rooted.groupBy("signature").agg(pivot, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("signature", "pivot")
        left = cut_lineage(rooted.join(by_signature, "signature"), "left")
        if left.isEmpty():
            break
        if turn < ROUNDS:
            met = left.where("root <> pivot.root").select("node", F.col("pivot.node").alias("other"))
            pairs = _possible(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), sketches)
        else:
            pairs = _blocked(left, sketches)
        links = links.union(confirmed(pairs))
    return links


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns: the least doc_id, null last, then the least hash of the text.

    Near copies link directly or through others, found by SimHash and completed exactly. Null texts and texts without words are one group. Shingles
    and sets are told apart by 64-bit hashes. Rows with a null id count like others and are kept last;
    repeated rows are one group, of which one stays. Texts of any length are compared whole. An empty
    table gives no rows. Columns may have any names.
    """
    marks = cut_lineage(_marks(docs), "marks")
    links = near_links(marks, docs)
    nodes = marks.select("node").distinct()
    if links is None:
        root_of = nodes.withColumn("root", F.col("node"))
    else:
        roots = connected(links).withColumnRenamed("node", "__node")
        root_of = nodes.join(roots, nodes["node"] == roots["__node"], "left").select("node", F.coalesce("root", "node").alias("root"))
    return simhash.first_of_each(docs, marks.select("doc_id", "text_key", "node"), cut_lineage(root_of, "roots"), "node")
