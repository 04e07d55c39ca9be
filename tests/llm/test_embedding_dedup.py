"""Links, components and counts against all pairs; the hash family against pairs just at the threshold."""

import math

import numpy as np
import pytest

from lotwise.llm import catalog, embedding_dedup

from .conftest import SF


def brute_force(rows, threshold=0.98):
    """(id, n_links, component, kept) of each row, from all pairs."""
    def usable(v, label, key):
        return key is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)

    vectors = [np.array(v, float) if usable(v, label, key) else None for key, v, label in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2]:
                x, y = a / np.abs(a).max(), b / np.abs(b).max()
                if (x @ y) / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(links):
        for j in own:
            root[top(i)] = top(j)
    parts = {}
    for i, (key, *_) in enumerate(rows):
        parts.setdefault(top(i), []).append(key)
    least = [min((k for k in parts[top(i)] if k is not None), default=None) for i in range(len(rows))]
    return sorted(((key, len(links[i]), least[i], None if key is None else key == least[i]) for i, (key, *_) in enumerate(rows)), key=repr)


def judged(spark, rows, kind="array<float>", **settings):
    table = spark.createDataFrame([(*r, 0, "own") for r in rows], f"id bigint, v {kind}, tag int, weight int, node string").repartition(3)
    return sorted((tuple(r) for r in embedding_dedup.near_duplicates(table, "id", "v", "tag", settings=embedding_dedup.HashSettings(**settings)).collect()), key=repr)


def test_query_against_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in catalog.QUERIES["op12_embedding_dedup"](spark, SF).collect()), key=repr) == brute_force(rows)


@pytest.fixture(scope="module")
def crowd():
    """One crowd of near copies, exact copies, chains of links and rows by themselves."""
    rng = np.random.default_rng(2)
    centre, rows = rng.normal(size=24), []
    rows += [(i, (centre + rng.normal(size=24) * 0.13).tolist(), 1) for i in range(150)]
    rows += [(200 + i, rows[i % 7][1], 1 + i % 2) for i in range(60)]
    turn = [(math.cos(a), math.sin(a)) for a in np.arange(40) * 0.19]
    rows += [(300 + 39 - i, [3 * c, 3 * s] + [0.0] * 22, 3) for i, (c, s) in enumerate(turn)]
    rows += [(400 + i, rng.normal(size=24).tolist(), 1) for i in range(60)]
    return [(k, np.float32(v).tolist(), t) for k, v, t in rows]


@pytest.mark.parametrize("block", [1024, 16])
def test_crowds_copies_and_chains(spark, crowd, block):
    got, expected = judged(spark, crowd, tables=6, block=block), brute_force(crowd)
    assert got == expected and max(r[1] for r in got) > 60


def test_edges(spark):
    huge, tiny = [1e300, 1e300, 0.0], [1e-300, 1e-300, 0.0]
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, -0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
        (7, [1.0, 0.0], 1), (8, [2.0, -0.0], 1), (8, [2.0, 0.0], 1), (8, [0.0, 1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1),
        (10, [1.0, 0.0], 2), (11, huge, 1), (12, tiny, 1), (13, [5.0], 1), (14, [4.0], 1), (15, [-4.0], 1), (2**60 + 1, [1.0, 0.001], 1),
    ]
    assert judged(spark, rows, "array<double>") == brute_force(rows)
    assert judged(spark, []) == []


def test_recall_at_the_threshold():
    """Lone pairs just above the threshold are the hardest: those that no bucket brings together are few."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1)[:, None]
    x, y = (embedding_dedup.bucket_codes(v, embedding_dedup.HashSettings()) for v in (a, b))
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.97


def test_hadamard_is_orthogonal():
    h = embedding_dedup.hadamard(np.eye(16))
    assert (h @ h.T == 16 * np.eye(16)).all()
