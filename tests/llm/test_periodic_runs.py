"""Runs against every period of every text, and the query against a plain statement of it."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lotwise.llm import catalog, periodic_runs

from .conftest import SF


def every_run(words):
    """(start, length, smallest period) of all maximal stretches, by trying each period."""
    words, found = np.asarray(words), {}
    for q in range(1, len(words) // 3 + 1):
        edge = np.diff(np.concatenate([[0], (words[:-q] == words[q:]).astype(int), [0]]))
        for start, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if end - start + q >= max(24, 3 * q):
                found.setdefault((int(start), int(end - start + q)), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_every_run_of_random_sequences():
    rng = np.random.default_rng(3)
    total = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.integers(1, 6)):
            unit = rng.integers(0, rng.integers(1, 4), rng.integers(1, 40))
            inner = np.concatenate([np.tile(unit[:3], rng.integers(1, 9)), rng.integers(0, 2, rng.integers(1, 3))])
            parts += [rng.integers(0, 3, rng.integers(1, 40)), np.tile(unit, rng.integers(1, 8)), np.tile(inner, rng.integers(1, 6))]
        words = np.concatenate(parts)
        expected = every_run(words)
        total += len(expected)
        assert [tuple(r) for r in periodic_runs.runs_of(words).tolist()] == expected
    assert total > 500


def test_long_sequences():
    assert periodic_runs.runs_of(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    words = np.concatenate([np.arange(40_000), np.arange(40_000), np.arange(40_000), [7]])
    assert periodic_runs.runs_of(words).tolist() == [[0, 120_000, 40_000]]


def plain_query(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = every_run([names[w] for w in words])
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapse(words, runs)))


def test_query_against_plain_statement(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in catalog.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    assert got == {d["doc_id"]: plain_query(d["doc_id"], d["text"]) for d in docs}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (None, "a b " * 20, "x"), (4, "a b " * 20, "y"), (4, "a b " * 20, "y"),
        (5, " \t\n lead  " + "x y z\x0bw " * 9 + "tail", "y"), (6, "word " * 400_000, "z"), (7, "one two three", None),
    ]
    return spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id bigint, text string, lang string, collapsed string, start int")


def test_edges(edges):
    got = periodic_runs.find_runs(edges)
    assert got.columns == ["doc_id", "text", "lang", "start", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == 8
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        runs = [tuple(x) for x in r["runs"]]
        if r["doc_id"] != 6:
            names = {w: i for i, w in enumerate(dict.fromkeys(words))}
            assert runs == every_run([names[w] for w in words])
        assert r["collapsed"] == collapse(words, runs)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["collapsed"] == by_id[4]["collapsed"] == "a b" and by_id[6]["collapsed"] == "word"
    assert by_id[5]["collapsed"] == "lead x y z w tail" and by_id[1]["collapsed"] == ""


def test_texts_of_a_batch_stay_apart(spark, monkeypatch):
    texts = [" ".join(map(str, range(30)))] * 6 + ["a " * 30, "a " * 30]
    found = [r for r, _ in periodic_runs._judged([t.encode().split() for t in texts])]
    assert found == [[]] * 6 + [[{"start": 0, "length": 30, "period": 1}]] * 2
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 50)
    assert [(i, len(d)) for i, d in periodic_runs._batched([None, *texts])] == [(0, 2), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 1)]


def test_empty_table(edges):
    assert periodic_runs.run_digests(periodic_runs.find_runs(periodic_runs.with_periods(edges.limit(0)))).collect() == []
    planted = periodic_runs.run_digests(periodic_runs.find_runs(periodic_runs.with_periods(edges.where("doc_id is null or doc_id < 6")))).collect()
    assert len(planted) == 6
