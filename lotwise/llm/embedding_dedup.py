"""Near-duplicate embeddings within a label, by cross-polytope hashing.

A unit vector is turned by sign flips and fast Hadamard transforms; the axis it then points along most,
with its sign, is its hash. A table's code joins the hashes of several rotations. Apart from its own
bucket, a vector goes to those that it only just missed. Vectors that share a bucket meet in one task,
which compares them in double precision and gives back counts and a spanning forest, never pairs: what
leaves a bucket is linear in what entered. A pair that meets in several buckets counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.session import cut_lineage

from .components import connected

#: Linked pairs whose buckets are compared side by side.
PAIRS = 1 << 15
#: Groups up to this size are compared side by side, larger ones by a matrix product each.
SMALL = 32
#: Matrix products err by less; pairs this near to the threshold are taken anew one by one.
SLACK = 1e-9
#: A bucket's block pair, and what tells a node: its least id and a 128-bit digest of its vector.
BUCKET = ("label", "size", "tab", "code")
GROUP = (*BUCKET, "one", "two")
NODE = ("node", "h1", "h2")


@dataclass(frozen=True)
class HashSettings:
    """The hash family. A bucket beyond ``block`` vectors is compared in pairs of blocks, each a task's group."""

    tables: int = 3
    rotations: int = 2
    probes: int = 3
    block: int = 1024
    seed: int = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows by the Hadamard matrix of their length, a power of two, without its scale."""
    rows, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(rows, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, size)
        step *= 2
    return x


def _rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for flips in signs:
        x = hadamard(x * flips) / math.sqrt(x.shape[1])
    return x


def bucket_codes(units: np.ndarray, settings: HashSettings) -> np.ndarray:
    """Codes of each unit vector, rows by tables by (own bucket, then those it nearly fell into)."""
    rows, length = units.shape
    padded = np.zeros((rows, 1 << max(0, (length - 1).bit_length())))
    padded[:, :length] = units
    size = padded.shape[1]
    rng = np.random.default_rng([settings.seed, size])
    wanted, near = 1 + settings.probes, min(size, 1 + settings.probes)
    tables = []
    for _ in range(settings.tables):
        codes, losses = np.zeros((rows, 1), np.int64), np.zeros((rows, 1))
        for _ in range(settings.rotations):
            turned = _rotated(padded, rng.choice([-1.0, 1.0], (3, size)))
            axes = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :near]
            along = np.take_along_axis(turned, axes, axis=1)
            loss = (np.abs(along[:, :1]) - np.abs(along)) ** 2
            codes = (codes[:, :, None] * (2 * size) + (2 * axes + (along < 0))[:, None, :]).reshape(rows, -1)
            losses = (losses[:, :, None] + loss[:, None, :]).reshape(rows, -1)
            best = np.argsort(losses, axis=1, kind="stable")[:, :wanted]
            codes, losses = np.take_along_axis(codes, best, axis=1), np.take_along_axis(losses, best, axis=1)
        if codes.shape[1] < wanted:  # so short a vector has fewer buckets: repeat its own
            codes = np.concatenate([codes, np.repeat(codes[:, :1], wanted - codes.shape[1], axis=1)], axis=1)
        tables.append(codes)
    return np.stack(tables, axis=1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows over their norms; the largest entry goes first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of code matrices (pairs, tables, codes), the first table they share a code in, and the least such code."""
    never = np.iinfo(np.int64).max
    shared = np.where((a[:, :, :, None] == b[:, :, None, :]).any(axis=3), a, never).min(axis=2)
    table = (shared != never).argmax(axis=1)
    return np.column_stack([table, shared[np.arange(len(a)), table]])


def _forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by label propagation with pointer jumping."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _near_pairs(units: np.ndarray, side: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within a group (across its sides, where it has two) at a cosine of ``threshold`` or more."""
    found = []
    sizes = ends - starts
    end_of = np.repeat(ends, sizes)
    two_sided = np.repeat(np.maximum.reduceat(side, starts) > 0, sizes)
    offset, small = 1, np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    while len(small := small[small + offset < end_of[small]]):
        a, b = small, small + offset
        meet = ~two_sided[a] | (side[a] != side[b])
        a, b = a[meet], b[meet]
        found.append((a, b))
        offset += 1
    for start, end in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
        split = start + int((side[start:end] == 0).sum())
        for at in range(start, split, block):
            until = min(split, at + block)
            first = at if split == end else split
            a, b = np.nonzero(units[at:until] @ units[first:end].T >= threshold - SLACK)
            a, b = a + at, b + first
            found.append((a[a < b], b[a < b]))
    pairs = []
    for a, b in found:
        for part in range(0, len(a), PAIRS):
            x, y = a[part : part + PAIRS], b[part : part + PAIRS]
            near = (units[x] * units[y]).sum(axis=1) >= threshold
            pairs.append((x[near], y[near]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in pairs)]), np.concatenate([none, *(b for _, b in pairs)])


def compare_groups(rows: pd.DataFrame, threshold: float, settings: HashSettings, entry: type) -> pd.DataFrame:
    """What whole groups of bucket members give: for every linked member, links that count here and the least node reached here."""
    rows = rows.sort_values([*GROUP, "side"], kind="stable", ignore_index=True)
    new = np.zeros(len(rows), bool)
    for c in GROUP:
        new[1:] |= rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1]
    starts = np.concatenate([[0], np.flatnonzero(new)]) if len(rows) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(rows))
    units = np.zeros((len(rows), int(rows["size"].max()) if len(rows) else 0))
    for size, at in rows.groupby("size").indices.items():  # zeros behind a shorter vector change no product
        units[at, :size] = unit_rows(np.stack([np.frombuffer(v, entry) for v in rows["vector"].to_numpy()[at]]).astype(np.float64))
    side, weight = rows["side"].to_numpy(), rows["weight"].to_numpy()
    a, b = _near_pairs(units, side, starts, ends, threshold, settings.block)
    links = np.zeros(len(rows), np.int64)
    linked = np.zeros(len(rows), bool)
    linked[a] = linked[b] = True
    codes = np.zeros((len(rows), settings.tables, 1 + settings.probes), np.int64)
    for i in np.flatnonzero(linked):
        codes[i] = np.frombuffer(rows["codes"].iat[i], np.int64).reshape(codes.shape[1:])
    here = rows[["tab", "code"]].to_numpy()
    for part in range(0, len(a), PAIRS):
        x, y = a[part : part + PAIRS], b[part : part + PAIRS]
        first = (_first_shared(codes[x], codes[y]) == here[x]).all(axis=1)
        np.add.at(links, x[first], weight[y[first]])
        np.add.at(links, y[first], weight[x[first]])
    # Numbers in order of the nodes, so that the least position is the least node.
    order = rows.sort_values(list(NODE), kind="stable").index.to_numpy()
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    root = order[_forest(len(rows), place[a], place[b])[place]]
    least = rows.loc[root[linked], list(NODE)].set_axis([f"root_{c}" for c in NODE], axis=1).reset_index(drop=True)
    return pd.concat([rows.loc[linked, list(NODE)].reset_index(drop=True), pd.Series(links[linked], name="n"), least], axis=1)


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows cut where a group ends; only the last group of a batch waits for the next."""
    kept: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        last = np.ones(len(rows), bool)
        for c in GROUP:
            last &= (rows[c] == rows[c].iloc[-1]).to_numpy()
        if not last.all() or (kept and (kept[-1][list(GROUP)].iloc[-1] != rows[list(GROUP)].iloc[0]).any()):
            yield pd.concat([*kept, rows[~last]], ignore_index=True)
            kept = []
        kept.append(rows[last])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def _digested(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, vector and its digest; vector and digest are null for rows that link with nothing."""
    double = F.transform(F.col(vector).cast("array<double>"), lambda c: c)
    whole = F.forall(double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(double, lambda c: c != 0.0)
    links = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))
    # Adding zero makes one of the two zeros.
    rows = table.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(links, F.transform(vector, lambda c: c + F.lit(0).cast("float"))).alias("vector"))
    digest = F.when(F.col("vector").isNotNull(), F.xxhash64("vector")), F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector"))
    return rows.withColumns({"h1": digest[0], "h2": digest[1]})


def near_duplicates(table: DataFrame, key: str, vector: str, label: str, threshold: float = 0.98, settings: HashSettings = HashSettings()) -> DataFrame:
    """``key``, n_links, component_id and kept of every row: links to rows of one label at a cosine of ``threshold`` or more.

    Pairs that share a bucket are compared exactly; none below the threshold is linked, and equal vectors
    always are. ``n_links`` counts the other rows linked directly, ``component_id`` is the least key
    reachable, ``kept`` tells whether that is the row's own.

    Rows with a null key or label, or with a vector that is null, empty, zero or has null or non-finite
    entries, link with nothing: no links, their own component, kept (all but n_links null without a key).
    Vectors of unequal length aren't compared. Rows that repeat a key are rows of their own. Empty tables
    give no rows; other columns aren't read. Links within a crowd of unequal near copies are counted one
    by one, in blocks, so that work (not memory, nor what is shuffled back) grows with its square.
    """
    rows = _digested(table, key, vector, label)
    entry = np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64
    same = rows.where(F.col("h1").isNotNull()).groupBy("label", "h1", "h2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"), F.any_value("vector").alias("vector"))
    nodes = cut_lineage(same, "vectors")
    kind = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for size, part in some.groupby(some["vector"].map(len)):
                x = np.stack(part["vector"].to_numpy()).astype(entry)
                codes = bucket_codes(unit_rows(x.astype(np.float64)), settings)
                at, tab, slot = np.nonzero(np.ones(codes.shape, bool))
                # A code of a short vector may repeat within its table; a vector enters a bucket once.
                once = pd.DataFrame({"at": at, "tab": tab, "code": codes[at, tab, slot]}).drop_duplicates()
                at = once["at"].to_numpy()
                data, own = [v.tobytes() for v in x], [c.tobytes() for c in codes]
                yield pd.DataFrame({
                    "label": part["label"].to_numpy()[at], "size": int(size), "tab": once["tab"].to_numpy(), "code": once["code"].to_numpy(),
                    **{c: part[c].to_numpy()[at] for c in (*NODE, "weight")}, "vector": [data[i] for i in at], "codes": [own[i] for i in at],
                })

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in hashed(batches):
            yield part[list(BUCKET)]

    in_bucket = f"label {kind['label']}, size int, tab int, code bigint"
    as_node = f"node {kind['node']}, h1 bigint, h2 bigint"
    entries = nodes.mapInPandas(hashed, f"{in_bucket}, {as_node}, weight bigint, vector binary, codes binary")
    shared = nodes.mapInPandas(buckets, in_bucket).groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # Blocks of a large bucket: a vector goes to the pairs of blocks that have its own.
    dealt = entries.join(shared, list(BUCKET)).withColumn("blocks", F.ceil(F.col("members") / settings.block).cast("int")).withColumn("mine", F.pmod("h1", F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("mine", other).alias("one"), F.greatest("mine", other).alias("two")))
    dealt = dealt.withColumn("pair", F.explode(pair)).select(*BUCKET, "pair.one", "pair.two", (F.col("mine") != F.col("pair.one")).cast("int").alias("side"), *NODE, "weight", "vector", "codes")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _whole_groups(batches):
            yield compare_groups(groups, threshold, settings, entry)

    sorted_groups = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = cut_lineage(sorted_groups.mapInPandas(compared, f"{as_node}, n bigint, {', '.join('root_' + c for c in as_node.split(', '))}"), "links")
    whole, top = F.struct(*NODE), F.struct(*(F.col(f"root_{c}").alias(c) for c in NODE))
    roots = connected(found.select(whole.alias("a"), top.alias("b")))
    counts = found.groupBy(*NODE).agg(F.sum("n").alias("n"))
    judged = (
        nodes.select("label", *NODE, "weight").join(counts, list(NODE), "left").join(roots.select("node.*", F.col("root.node").alias("root")), list(NODE), "left")
        .select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    )
    out = rows.select("id", "label", "h1", "h2").join(judged, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
