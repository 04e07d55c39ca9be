"""The near-copy stage of the pipeline against all pairs of its input."""

import numpy as np
import pytest

import corpus_pipeline
from lotwise.llm import near_copies


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _groups(texts):
    sets = _sets(texts)
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                p, q = sorted((group[i], group[j]))
                group = [p if g == q else g for g in group]
    return group


def _texts(rng, bases, copies, longest):
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", "  \t", "one two", "One  two", "one two three"]
    for _ in range(bases):
        base = rng.choice(words, int(rng.integers(1, longest))).tolist()
        for _ in range(copies):
            copy = base[:]
            for _ in range(int(rng.integers(0, 2 + len(base) // 40))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(words))
            out.append(" ".join(copy))
    return out


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    tried = 0
    for _ in range(4000):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        gone, more = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
        a, b = np.unique(base), np.unique(np.concatenate((base[gone:], rng.integers(0, 2**64, more, dtype=np.uint64))))
        if near_copies.similar(a, b):
            tried += 1
            assert np.intersect1d(near_copies.signatures(a), near_copies.signatures(b)).size
    assert tried > 1000


@pytest.mark.parametrize("rounds", [0, 3])
def test_stage_against_all_pairs(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    texts = _texts(np.random.default_rng(5), 40, 6, 300)
    group = _groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()}
    assert kept == set(group) and len(kept) < len(texts) - 100


def test_stage_joins_a_large_group(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if i != at else f"x{n}" for i, w in enumerate(base)) for n, at in enumerate(rng.integers(0, 120, 300))]
    texts += [texts[0]] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert [r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()] == [0]


@pytest.mark.parametrize("block", [3, 512])
def test_blocks_lose_no_near_copy(spark, monkeypatch, block):
    """Without rounds, all near copies meet in blocks, whatever the size of these."""
    monkeypatch.setattr(near_copies, "ROUNDS", 0)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = _texts(np.random.default_rng(11), 12, 9, 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in near_copies.one_of_each(docs).collect()} == set(_groups(texts))


def test_similar_sets_have_enough_equal_bytes():
    rng = np.random.default_rng(13)
    for _ in range(1500):
        n = int(rng.integers(1, 500))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        a = np.unique(base)
        b = np.unique(np.concatenate((base[int(rng.integers(0, n // 6 + 1)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64))))
        if near_copies.similar(a, b):
            levels = sorted((near_copies.size_class(len(a)), near_copies.size_class(len(b))))
            assert levels[1] - levels[0] <= 1
            apart, parts = near_copies.cuts(levels[0])
            assert (near_copies.part_bytes(a, levels[0]) == near_copies.part_bytes(b, levels[0])).sum() >= parts - apart


def test_edges(spark):
    long = "word " * 5000 + " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f", "y"), (4, "A b c d e f", "y"), (4, "A b c d e f", "y"), (5, long, "z"), (6, long + " more", "z"), (None, "only here", None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, lang string, node int, signature int, root int")
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], len(r["text"] or "")) for r in kept.collect()), key=repr) == sorted([(1, 0), (4, 11), (5, len(long)), (None, 9)], key=repr)
    assert near_copies.one_of_each(docs.limit(0)).collect() == []
