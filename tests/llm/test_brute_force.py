"""Operators that SQL can't state, against brute force, round trips and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from lotwise.llm import components, line_dedup, neighbours, packing, simhash, suffix_dedup, token_counts, toxicity

from .conftest import SF


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    rows = toxicity.score(docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))), model).select("toxic", "predicted").collect()
    hits = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert hits[(1, 1)] / (hits[(1, 1)] + hits[(1, 0)]) > 0.75
    assert hits[(0, 1)] / (hits[(0, 1)] + hits[(0, 0)]) < 0.01


def test_toxicity_ignores_group_names(spark):
    """Labels that hang on a group's name alone move scores less with the penalty."""
    rows = [(i, f"the women met here {'fool' * (i % 2)} today {i}" if i % 2 else f"the men met here today {i}", i % 2) for i in range(80)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert toxicity.counterfactual("The women. A man!") == "The men. A woman!"
    gap = {}
    for penalty in (0.0, 1.0):
        model = toxicity.train(docs, labels, penalty=penalty)
        gap[penalty] = abs(model.score("the women met") - model.score("the men met"))
    assert gap[1.0] < gap[0.0] / 2
    assert model.score("fool") > 0.5 > model.score("the women met here")


def test_token_counts_follow_the_public_library(spark, corpus):
    vocabulary = token_counts.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tokenizer = Tokenizer(models.Unigram([("<unk>", -1e9), *vocabulary], 0, False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = token_counts.count_tokens(corpus, public_tokenizers.path("piece_bpe_32k.model")).join(corpus, "doc_id").select("text", "n_tokens").collect()
    assert [r["n_tokens"] for r in rows] == [len(tokenizer.encode(r["text"]).ids) for r in rows]


def test_token_counts_break_ties_like_the_library():
    rng = random.Random(1)
    for _ in range(20):
        pieces = {"".join(rng.choice("ab▁cé") for _ in range(rng.randint(1, 4))): rng.choice([-1.0, -2.0, -3.0, -0.5]) for _ in range(25)}
        tokenizer = Tokenizer(models.Unigram([("<unk>", -11.0), *pieces.items()], 0, False))
        tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = token_counts.UnigramCounter(tuple(pieces.items()), unknown_penalty=-11.0 * -1 + min(pieces.values()))
        counter.unknown_score = min(-11.0, min(pieces.values())) - 10.0
        for _ in range(100):
            text = "".join(rng.choice("ab▁ cé\n") for _ in range(rng.randint(0, 14)))
            assert counter.text(text) == len(tokenizer.encode(text).ids), (text, pieces)


def test_packing_round_trip(corpus, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts}
    rows = packing.pack_documents(corpus, path, 256, keep_ids=True).collect()
    got, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        got.setdefault(r["doc_id"], []).append((r["start"], list(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in got.items()} == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in rows) / (256 * len(sequences)) > 0.95


def test_chunks_tokenize_like_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, tokenizer, rng = packing._Ids(path), Tokenizer.from_file(path), random.Random(0)
    cases = ["", "  ", "a  b ", "日本語 テスト", "a \n b  c 　d  ", "<|endoftext|>", "a <|endoftext|> b", "it's  we'll", "\x00 \x1c a \x85b"]
    cases += ["".join(rng.choice("ab 1.\n\t'sé  <|") for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    for text in cases:
        assert np.frombuffer(ids.text(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_fingerprints_bit_by_bit():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice("aB é\t\n\x1c\x85x ") for _ in range(rng.randint(0, 40)))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for white in "\t\n\x0b\x0c\r":
            low = low.replace(white, " ")
        words = [w for w in low.split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("split_above", [50_000, 1])
def test_simhash_links_against_all_pairs(spark, split_above):
    rng = np.random.default_rng(0)
    bits = []
    for base in rng.integers(0, 2**64, 60, dtype=np.uint64).tolist():
        for _ in range(8):
            for k in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                base ^= 1 << k
            bits.append(base)
    bits = np.unique(np.array(bits, np.uint64))
    root = list(range(len(bits)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3), strict=True):
        a, b = top(int(i)), top(int(j))
        root[max(a, b)] = min(a, b)
    want = Counter(frozenset(int(bits[j]) for j in range(len(bits)) if top(j) == top(i)) for i in range(len(bits)))
    prints = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "fingerprint bigint")
    links = simhash.near_links(prints, split_above=split_above)
    rows = prints.join(components.connected(links), F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["fingerprint"] % 2**64)
    assert set(map(frozenset, groups.values())) == set(want)


def test_components_of_a_long_chain(spark):
    chain = list(range(60))
    random.Random(1).shuffle(chain)
    links = [*zip(chain, chain[1:], strict=False), (100, 101), (101, 101), (None, 5), (100, 101)]
    rows = components.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in rows} == {**dict.fromkeys(range(1, 60), 0), 101: 100}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_neighbours_recall(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    rows = table.collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["vector"] for r in rows], float)
    settings = neighbours.GraphSettings(shard_rows=700, queries_per_block=40)
    found = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, settings=settings).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    for q, near in found.items():
        scores = (vectors * vectors[ids == q][0]).sum(axis=1)
        scores[ids == q] = -np.inf
        assert sorted(near) == list(range(1, 21)) and all(s == scores[ids == v][0] for v, s in near.values())
        hits += len({v for v, _ in near.values()} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert hits / (20 * len(found)) > 0.97


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randint(0, len(out))
        kind = rng.randint(0, 2)
        if kind == 0 or at == len(out):
            out.insert(at, rng.choice("abc"))
        elif kind == 1:
            out.pop(at)
        else:
            out[at] = rng.choice("abc")
    return "".join(out)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng, pairs = random.Random(threshold), []
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        pairs.append((a, _edited(rng, a, rng.randint(0, 5))))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), threshold).alias("d")).collect()
    for r in rows:
        assert min(r["d"], threshold + 1) == min(_distance(r["a"], r["b"]), threshold + 1), r


@pytest.mark.parametrize("small_group", [24, 2])
def test_line_dedup_against_all_pairs(spark, monkeypatch, small_group):
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", small_group)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(18, 34))) for _ in range(14)]
    docs = [(i, "\n".join(_edited(rng, rng.choice(base), rng.randint(0, 2)) if rng.random() < 0.8 else rng.choice(["", "x", "short"]) for _ in range(rng.randint(0, 7)))) for i in range(40)]
    first = {}
    for d, text in docs:
        for n, line in enumerate(text.split("\n")):
            if line:
                first.setdefault(line, (d, n))
    gone = {b for b in first for a in first if min(len(a), len(b)) >= 20 and first[a] < first[b] and abs(len(a) - len(b)) <= 2 and _distance(a, b) <= 2}
    want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if x == "" or (first[x] == (d, n) and x not in gone)) for d, t in docs}
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert gone and {r["doc_id"]: r["text"] for r in got} == want


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        k = rng.choice([2, 3, 10])
        s = [rng.randint(1, k) for _ in range(rng.randint(0, 60))] + [0]
        array = suffix_dedup.suffix_array(s, k + 1)
        assert array == sorted(range(len(s)), key=lambda i: s[i:])
        shared, before = suffix_dedup.permuted_common_prefixes(s, array)
        for a, b in zip(array, array[1:], strict=False):
            n = next(i for i in range(len(s)) if s[a + i] != s[b + i])
            assert (shared[b], before[b]) == (n, a)


@pytest.mark.parametrize(("length", "shard"), [(60, 400_000), (45, 1000), (70, 1)])
def test_repeats_against_every_window(spark, monkeypatch, length, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_SYMBOLS", shard)
    rng = random.Random(length)
    words = ["ab", "cde", "é", "fghij", "k", "lmn op", "\n"]
    base = ["".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [rng.choice(base)[rng.randint(0, 50) : rng.randint(50, 150)] if rng.random() < 0.6 else "".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
        docs.append((i, "".join(parts)))
    docs += [(100, None), (101, ""), (None, docs[5][1]), (5, docs[5][1]), (102, "a" * 500), (103, "ab" * 300), (104, "x" + "a" * 100)]
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    want = []
    for (d, _), raw in zip(docs, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        want.append((d, len(raw), sum(gone), sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    df = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), length)
    got = [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
