"""The SimHash step of the near-copy stage, and what completes it."""

import numpy as np

from lotwise.llm import near_copies, simhash

from .test_near_copies import _groups, _texts


def _prints(texts):
    return {int(np.uint64(n).view(np.int64)): simhash.majority(s) for n, s in ((near_copies.xxhash.xxh3_64_intdigest(s.tobytes()), s) for s in map(near_copies.shingles, texts))}


def test_groups_by_fingerprints_are_compared(spark):
    """Every node but the least of each group of fingerprints within three bits meets the least."""
    texts = _texts(np.random.default_rng(17), 30, 6, 900)
    prints = _prints(texts)
    root = {n: n for n in prints}
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                p, q = sorted((root[a], root[b]))
                root = {n: p if r == q else r for n, r in root.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    marks = near_copies._marks(docs).select("node", "fingerprint").distinct()
    found = {(r["a"], r["b"]) for r in near_copies._simhash_pairs(marks).collect()}
    assert found == {(min(m for m in root if root[m] == r), n) for n, r in root.items() if n != min(m for m in root if root[m] == r)}
    assert len(found) > 10


def test_stage_takes_groups_from_simhash(spark, monkeypatch):
    """Fingerprints are read, and near copies beyond three bits are still found."""
    asked = []
    components = simhash.components
    monkeypatch.setattr(simhash, "components", lambda prints, distance: asked.append(distance) or components(prints, distance))
    texts = _texts(np.random.default_rng(19), 20, 5, 200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in near_copies.one_of_each(docs).collect()} == set(_groups(texts))
    assert asked == [3]


def test_sketches_lose_no_near_copy(spark):
    texts = _texts(np.random.default_rng(23), 8, 6, 150)
    sets = {int(np.uint64(near_copies.xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)): s for s in map(near_copies.shingles, texts) if len(s)}
    docs = spark.createDataFrame([(t,) for t in texts if t and t.split()], "text string")
    nodes = near_copies._marks(docs.selectExpr("1 as doc_id", "text")).select("node")
    held = docs.select(near_copies._sketched("text").alias("s")).select("s.*")
    rows = [(n, *r) for n, r in zip([r[0] for r in nodes.collect()], held.collect(), strict=True)]
    sketches = spark.createDataFrame(rows, "node bigint, size_class int, own binary, below binary").dropDuplicates(["node"])
    pairs = [(a, b) for a in sets for b in sets if a < b]
    found = {tuple(r) for r in near_copies._possible(spark.createDataFrame(pairs, "a bigint, b bigint"), sketches).collect()}
    near = {(a, b) for a, b in pairs if near_copies.similar(sets[a], sets[b])}
    assert near and near <= found and len(found) < len(pairs) / 5
