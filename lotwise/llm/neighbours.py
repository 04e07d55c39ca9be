"""Approximate nearest neighbours by largest inner product, over a robust-pruned directed graph.

Rows are dealt to shards by a hash of their id, so copies of one vector are spread; within a shard
equal vectors are one node. A component is added to every vector that makes all norms equal, which
turns the largest product into the least distance. Nodes are inserted in batches: a greedy search on
the graph so far proposes neighbours, pruning keeps those that no kept one is nearer to by the factor
``relax``, and edges back are pruned the same way. A query searches every shard's graph with a beam;
products are then taken anew from the original vectors in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import cut_lineage

#: Queries or nodes that are searched side by side.
BATCH = 256
#: Nodes a beam opens at a time.
OPENED = 4


@dataclass(frozen=True)
class GraphSettings:
    """Bounds of the graph and the search; none depends on the size of the table but the number of shards."""

    shard_rows: int = 4096
    degree: int = 32
    build_beam: int = 64
    search_beam: int = 128
    relax: float = 1.2
    queries_per_block: int = 16384


def level_norms(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors with one component more, of which products order like those of ``vectors``."""
    x = vectors.astype(np.float64)
    squares = (x * x).sum(axis=1)
    top = squares.max(initial=0.0) or 1.0
    return (np.column_stack([x, np.sqrt(np.maximum(top - squares, 0.0))]) / math.sqrt(top)).astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and products found for each query, best first; -1 where fewer were reached. ``edges`` is padded with -1."""
    n, rows = len(x), np.arange(len(queries))[:, None]
    seen = np.zeros((len(queries), n + 1), bool)
    seen[:, n] = True  # the padding
    ids = np.full((len(queries), beam), -1)
    near = np.full((len(queries), beam), -np.inf, np.float32)
    opened = np.ones((len(queries), beam), bool)
    k = min(beam, len(entries))
    ids[:, :k] = entries[:k]
    near[:, :k] = queries @ x[entries[:k]].T
    opened[:, :k] = False
    seen[:, entries[:k]] = True
    while True:
        score = np.where(opened, -np.inf, near)
        pick = np.argpartition(-score, min(OPENED, beam - 1), axis=1)[:, :OPENED] if beam > OPENED else np.tile(np.arange(beam), (len(queries), 1))
        fresh = ~opened[rows, pick]
        if not fresh.any():
            order = np.argsort(-near, axis=1, kind="stable")
            return ids[rows, order], near[rows, order]
        nodes = np.where(fresh, ids[rows, pick], n)
        opened[rows, pick] = True
        found = np.where(nodes[..., None] < n, edges[np.minimum(nodes, n - 1)], -1).reshape(len(queries), -1)
        found = np.sort(np.where(found < 0, n, found), axis=1)
        new = ~seen[rows, found]
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen[rows, found] = True
        q_at, f_at = np.nonzero(new)
        products = np.full(found.shape, -np.inf, np.float32)
        products[q_at, f_at] = np.einsum("ij,ij->i", queries[q_at], x[found[q_at, f_at]])
        ids = np.concatenate([ids, np.where(new, found, -1)], axis=1)
        near = np.concatenate([near, products], axis=1)
        opened = np.concatenate([opened, ~new], axis=1)
        best = np.argpartition(-near, beam - 1, axis=1)[:, :beam]
        ids, near, opened = ids[rows, best], near[rows, best], opened[rows, best]


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` of each node's candidates (-1: none), near and diverse; padded with -1.

    The nearest candidate left is kept, and those go that are nearer to it, by the factor, than to the node.
    """
    rows = np.arange(len(nodes))[:, None]
    candidates = np.sort(candidates, axis=1)
    void = (candidates < 0) | (candidates == nodes[:, None])
    void[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    points = x[np.maximum(candidates, 0)]
    apart = np.where(void, np.inf, 2 - 2 * np.einsum("bcd,bd->bc", points, x[nodes]))
    order = np.argsort(apart, axis=1, kind="stable")
    candidates, apart, points = candidates[rows, order], apart[rows, order], points[rows, order]
    between = 2 - 2 * (points @ points.transpose(0, 2, 1))
    alive = np.isfinite(apart)
    kept = np.full((len(nodes), degree), -1)
    at = np.arange(len(nodes))
    for slot in range(degree):
        first = alive.argmax(axis=1)
        some = alive[at, first]
        if not some.any():
            break
        kept[some, slot] = candidates[some, first[some]]
        alive &= (relax * relax) * between[at, first] > apart
        alive[at, first] = False
    return kept


def build_graph(x: np.ndarray, settings: GraphSettings, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a row per node, padded with -1) and entry nodes for unit vectors ``x``."""
    n, degree = len(x), settings.degree
    rng = np.random.default_rng(seed)
    centre = int(np.argmax(x @ x.mean(axis=0)))
    entries = np.unique(np.concatenate([[centre], rng.choice(n, min(n, 7), replace=False)]))
    edges = np.full((n, degree), -1)
    order = np.concatenate([entries, rng.permutation(np.setdiff1d(np.arange(n), entries))])
    # The entries know each other; others are found from there.
    edges[entries, : len(entries) - 1] = [[e for e in entries if e != me] for me in entries]
    # The second round sees the whole graph; without it, a crowd of near copies is hard to leave and to reach.
    grown = [len(entries)]
    while grown[-1] < n:
        grown.append(min(n, grown[-1] + min(BATCH, max(16, grown[-1] // 2))))
    for start, end in [*zip(grown, grown[1:], strict=False), *((i, i + BATCH) for i in range(0, n, BATCH))]:
        batch = order[start:end]
        found, _ = beam_search(x, edges, entries, x[batch], settings.build_beam)
        edges[batch] = robust_prune(x, batch, np.concatenate([found, edges[batch]], axis=1), degree, settings.relax)
        source, slot = np.nonzero(edges[batch] >= 0)
        target, source = edges[batch][source, slot], batch[source]
        by_target = np.lexsort((-np.einsum("ij,ij->i", x[source], x[target]), target))
        target, source = target[by_target], source[by_target]
        nodes, starts = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(starts, np.diff(np.append(starts, len(target))))
        near = place < 2 * degree  # the nearest of those that point here
        back = np.full((len(nodes), 2 * degree), -1)
        back[np.searchsorted(nodes, target[near]), place[near]] = source[near]
        for part in range(0, len(nodes), BATCH):
            some = nodes[part : part + BATCH]
            edges[some] = robust_prune(x, some, np.concatenate([edges[some], back[part : part + BATCH]], axis=1), degree, settings.relax)
    return edges, entries


def _usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vector (floats) of the rows that take part, and their number."""
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    full = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    full = full.where(~bad & F.exists("vector", lambda v: v != 0.0))
    sizes = full.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not sizes:
        return full.limit(0), 0
    # Of rows with one id, that of the least vector.
    one = full.where(F.size("vector") == sizes[0]["size"]).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return one, sizes[0]["n"]


def build_index(vectors: DataFrame, settings: GraphSettings = GraphSettings()) -> tuple[DataFrame, int]:
    """The graph of every shard as rows (shard, node, vector, edges, is_entry, ids), and the number of shards.

    ``vectors`` has vec_id and ``vector``. Every row with an id and a finite vector other than zero, of the
    length that most have, is in it.
    """
    rows, n = _usable(vectors)
    shards = max(1, math.ceil(n / settings.shard_rows))

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        full = np.stack(rows["vector"].to_numpy())
        distinct, of = np.unique(full, axis=0, return_inverse=True)
        edges, entries = build_graph(level_norms(distinct), settings)
        ids = rows["vec_id"].to_numpy()[np.argsort(of.ravel(), kind="stable")]
        ends = np.cumsum(np.bincount(of.ravel(), minlength=len(distinct)))
        return pd.DataFrame({
            "shard": rows["shard"].iloc[0], "node": np.arange(len(distinct)), "vector": list(distinct), "edges": [e[e >= 0] for e in edges],
            "is_entry": np.isin(np.arange(len(distinct)), entries), "ids": np.split(ids, ends[:-1]),
        })

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    # A shard is little data and much work, so each has a task of its own.
    return sharded.repartition(shards, "shard").groupBy("shard").applyInPandas(built, "shard int, node int, vector array<double>, edges array<int>, is_entry boolean, ids array<bigint>"), shards


def search_shard(nodes: pd.DataFrame, queries: pd.DataFrame, top: int, settings: GraphSettings) -> pd.DataFrame:
    """The best ``top`` rows of a shard for each query: query_id, vec_id, score."""
    nodes = nodes.sort_values("node")
    vectors = np.stack(nodes["vector"].to_numpy())
    x = level_norms(vectors)
    edges = np.full((len(nodes), settings.degree), -1)
    for i, e in enumerate(nodes["edges"]):
        edges[i, : len(e)] = e
    entries, ids = np.flatnonzero(nodes["is_entry"].to_numpy()), nodes["ids"].to_numpy()
    out = []
    for at in range(0, len(queries), BATCH):
        block = queries.iloc[at : at + BATCH]
        q = np.stack(block["vector"].to_numpy())
        scaled = np.column_stack([q, np.zeros(len(q))])
        scaled = (scaled / np.sqrt((q * q).sum(axis=1))[:, None]).astype(np.float32)
        found, _ = beam_search(x, edges, entries, scaled, max(settings.search_beam, top + 1))
        for query_id, query, reached in zip(block["vec_id"], q, found, strict=True):
            reached = reached[reached >= 0]
            scores = (vectors[reached] * query).sum(axis=1)
            best = np.lexsort(([ids[r][0] for r in reached], -scores))[: top + 1]
            # Copies of one vector are equally near: the least ids among them count, without the query's own.
            rows = [(-scores[b], v) for b in best for v in ids[reached[b]][: top + 1] if v != query_id]
            out += [(query_id, v, -s) for s, v in sorted(rows)[:top]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, is_query, top: int = 20, settings: GraphSettings = GraphSettings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` rows found nearest to each row for which ``is_query`` holds.

    Nearest first, equal scores by the smaller vec_id, the query's own id left out; fewer where there are
    fewer. Rows without id, and null, zero or non-finite vectors, take no part; of rows that repeat an
    id, one takes part. Tables without such vectors give no rows; extra columns are not read. The index
    is written once to the shared folder. Queries go to the shards in blocks of bounded size.
    """
    index, shards = build_index(vectors, settings)
    index = cut_lineage(index, "graph")
    queries, _ = _usable(vectors.where(is_query))
    blocks = max(1, math.ceil(queries.count() / settings.queries_per_block))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    copied = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def searched(key, nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(asked):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return search_shard(nodes, asked, top, settings)

    tasks = shards * blocks
    copied, dealt = copied.repartition(tasks, "shard", "block"), dealt.repartition(tasks, "shard", "block")
    found = copied.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(searched, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
