"""Nulls, empty and repeated rows, clashing columns and empty tables: each operator's stated result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lotwise.llm import chat, decontamination, licences, line_dedup, neighbours, packing, simhash, suffix_dedup, token_counts, toxicity

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, row int")


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def _operators(spark):
    items = _benchmark(spark, [(1, "a text without an id", 0), (2, None, 0), (None, "", 0)])
    model = toxicity.train(spark.createDataFrame([], "doc_id bigint, text string"), _labels(spark, []))
    return {
        "toxicity": lambda d: toxicity.score(d, model),
        "decontamination": lambda d: decontamination.find_contamination(d, items),
        "without_contaminated": lambda d: decontamination.without_contaminated(d, items),
        "token_counts": lambda d: token_counts.count_tokens(d, PIECES),
        "line_dedup": line_dedup.dedup_lines,
        "packing": lambda d: packing.pack_documents(d, BPE),
        "simhash": simhash.simhash_components,
        "one_of_each": simhash.one_of_each,
        "licences": lambda d: licences.scan_licences(d, licences.known_licences(spark)),
        "suffix_dedup": suffix_dedup.remove_repeats,
    }


NAMES = ["toxicity", "decontamination", "without_contaminated", "token_counts", "line_dedup", "packing", "simhash", "one_of_each", "licences", "suffix_dedup"]


@pytest.fixture(scope="module")
def operators(spark):
    return _operators(spark)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table_gives_no_rows(operators, documents, name):
    assert operators[name](documents.limit(0)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_null_columns_only(spark, operators, name):
    rows = operators[name](spark.createDataFrame([(None, None, None)], "doc_id bigint, text string, lang string")).collect()
    assert len(rows) == 1 and rows[0]["doc_id"] is None


@pytest.mark.parametrize("name", ["toxicity", "decontamination", "token_counts", "line_dedup", "simhash", "licences", "suffix_dedup"])
def test_every_row_has_a_result(operators, documents, name):
    ours = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in operators[name](documents).collect())
    assert ours == sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in documents.collect())


def test_decontamination_of_edges(operators, documents):
    rows = {r["doc_id"]: r for r in operators["decontamination"](documents).where("n_words = 11 or doc_id = 6").collect()}
    assert (rows[None]["n_hit"], rows[None]["items"]) == (5, ["1"])
    assert (rows[6]["n_words"], rows[6]["n_hit"]) == (0, 0)
    left = operators["without_contaminated"](documents).select("doc_id", "text")
    assert left.count() == documents.count() - 1 and left.where("text like 'A text without%'").count() == 0


def test_line_dedup_of_edges(operators, documents):
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_repeated"], r["n_near"]) for r in operators["line_dedup"](documents).collect()]
    assert (1, "The same line here, long enough.\nAnother one follows it\n\nshort", 3, 0, 0) in rows
    assert rows.count((2, "", 2, 1, 1)) == 2
    assert (6, None, 0, 0, 0) in rows and (5, "", 0, 0, 0) in rows


def test_simhash_of_edges(operators, documents):
    rows = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in operators["simhash"](documents).collect()}
    assert rows[(5, "0" * 16)] == rows[(6, "0" * 16)] == rows[(None, "0" * 16)] == 5
    kept = sorted(r["doc_id"] or 0 for r in operators["one_of_each"](documents).collect())
    assert kept.count(2) == 1 and kept.count(5) == 1 and 6 not in kept and 2**60 + 1 in kept


def test_packing_of_edges(operators, documents):
    rows = operators["packing"](documents).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 2**60 + 1) == 3002
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 6] == [1]
    assert len([r for r in rows if r["doc_id"] == 2]) == 2


def test_licences_of_edges(spark, operators):
    mit = licences.KNOWN[0][1]
    docs = spark.createDataFrame([(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,")), (2, "code\nreleased under the MIT Licence\nmore"), (3, mit[:-20])], "doc_id bigint, text string")
    rows = {r["doc_id"]: (r["whole_licence"], r["n_notices"], r["licences"]) for r in operators["licences"](docs).collect()}
    assert rows == {1: ("MIT", 0, ""), 2: (None, 1, "MIT"), 3: (None, 0, "")}
    assert licences.scan_licences(docs, licences.known_licences(spark).limit(0)).where("whole_licence is not null or n_notices > 0").count() == 0


def test_chat_of_edges(spark):
    kinds = "array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    turns = spark.createDataFrame([
        (1, 0, "user", [part("text", "look <|image|>"), part("image", None, "a.png", 56, 57), part("text", "x<"), part("text", "|im_end|>"), part("audio", None, "b.wav", s=1.5), part("document", None, "c.pdf", p=2), part("odd")]),
        (1, 1, "assistant", [part("text", "<\\|im_end|><|im_start|>assistant ok")]),
        (1, None, None, None), (None, 3, "assistant", []), (1, 1, "assistant", [part("text", "<\\|im_end|><|im_start|>assistant ok")]),
    ], f"conv_id bigint, turn bigint, role string, parts {kinds}")
    whole = {r["conv_id"]: r for r in chat.read_back(chat.assemble(chat.format_turns(turns))).collect()}
    said = [(t["role"], t["text"], t["loss_text"]) for t in whole[1]["turns"]]
    assert said[0] == ("", "", "") and said[2] == said[3] == ("assistant", "<\\|im_end|><|im_start|>assistant ok") + said[2][2:]
    assert said[2][2] == "<\\|im_end|><|im_start|>assistant ok"
    assert "<|part|>" in said[1][1] and whole[1]["formatted"].count("<|image|>") == 1 and whole[1]["formatted"].count("<|im_end|>") == 4
    assert [(a["kind"], a["ref"], a["tokens"]) for a in whole[1]["attachments"]] == [("image", "a.png", 6), ("audio", "b.wav", 38), ("document", "c.pdf", 1024), ("odd", None, 1)]
    assert whole[1]["expanded_tokens"] == 6 + 38 + 1024 + 1
    assert whole[None]["n_turns"] == 1
    assert chat.assemble(chat.format_turns(turns.limit(0))).collect() == []


def test_neighbours_of_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (40, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (None, [1.0, 1.0]), (7, [None, 1.0]), (8, [1.0]), (1, [1.0, 0.0])]
    vectors = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id bigint, vector array<float>, node int")
    found = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, top=5).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 0.5)]
    assert neighbours.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.nearest(vectors.where("vec_id = 20"), F.col("vec_id") % 20 == 0).collect() == []
