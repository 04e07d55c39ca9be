"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lotwise.llm import toxicity
from lotwise.session import cut_lineage

from .conftest import SF
from .test_brute_force import _distance


@pytest.fixture(scope="module")
def tables(spark):
    """Input of the first stage and output of every stage."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(tables):
    assert [t.columns for t in tables[:5]] == [tables[0].columns] * 5
    assert len(corpus_pipeline.STAGES) == 5


def test_toxic_documents_go(spark, tables):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(tables[0], labels.where(~toxicity.held_out(F.col("doc_id"))))
    assert set(rows(tables[1])) == {d for d, r in rows(tables[0]).items() if model.score(r["text"]) < 0.7}


def test_repeated_lines_go(tables):
    before, after = rows(tables[1]), rows(tables[2])
    first = {}
    for d in sorted(before):
        for n, line in enumerate(before[d]["text"].split("\n")):
            first.setdefault(line, (d, n))
    # Lines a and b within two edits share a third of the shorter at its start, its end or, shifted by one at most, in the middle.
    near, thirds = set(), {}
    lines = [x for x in first if len(x) >= 20]
    for a in lines:
        m = len(a) // 3
        for part in {("s", len(a), a[:m]), ("e", len(a), a[-m:]), ("m", len(a), a[m : 2 * m])}:
            thirds.setdefault(part, []).append(a)
    for b in lines:
        for size in (len(b), len(b) - 1, len(b) - 2):
            m = size // 3
            for part in [("s", size, b[:m]), ("e", size, b[-m:])] + [("m", size, b[m + s : 2 * m + s]) for s in (-1, 0, 1)]:
                for a in thirds.get(part, []):
                    if a != b and _distance(a, b) <= 2:
                        near.add(max(a, b, key=first.__getitem__))
    for d, r in before.items():
        kept = "\n".join(x for n, x in enumerate(r["text"].split("\n")) if x == "" or (first[x] == (d, n) and x not in near))
        assert (after[d]["text"], after[d]["n_chars"], after[d]["source"]) == (kept, len(kept), r["source"])


def test_one_of_each_group_stays(tables):
    """Groups by Jaccard similarity of five-word shingles, over all pairs."""
    before, after = rows(tables[2]), rows(tables[3])
    ids = sorted(before)
    sets = []
    for d in ids:
        w = before[d]["text"].lower().encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(ids)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                p, q = sorted((group[i], group[j]))
                group = [p if g == q else g for g in group]
    assert set(after) == {ids[g] for g in set(group)}


def test_contaminated_documents_go(spark, tables):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9)) if w}
    bad = set()
    for d, r in rows(tables[3]).items():
        w = words(r["text"])
        if any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            bad.add(d)
    assert set(rows(tables[4])) == set(rows(tables[3])) - bad


def test_packed_documents_are_whole(tables):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter()
    for r in tables[5].collect():
        got[r["doc_id"]] += r["length"]
    assert got == {d: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in rows(tables[4]).items()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats and names that the stages use inside."""
    rows = [(1, None), (2, ""), (None, "no id\nhere"), (None, None), (4, "a plain text that is long enough to stay"), (4, "a plain text that is long enough to stay"), (5, "word " * 2000)]
    names = ("score", "predicted", "n_lines", "n_repeated", "n_near", "node", "root", "contaminated", "line")
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names)).repartition(2)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_odd_rows_and_names(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns
    rows = out.collect()
    assert {tuple(r[c] for c in odd.columns[2:]) for r in rows} == {tuple(range(9))}
    # Two groups of copies: the three texts without words, and the repeated row.
    assert len(rows) == (4 if name == "simhash_dedup" else 7)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).collect() == []
