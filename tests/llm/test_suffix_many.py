"""Anchors with many different segments are counted by strings, with the same result."""

import random

import pytest

from lotwise.llm import suffix_dedup

from .test_brute_force import test_repeats_against_every_window as against_every_window


@pytest.mark.parametrize("many", [1, 3])
def test_counts_against_every_window(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    against_every_window(spark, monkeypatch, 60, 400_000)


def test_a_shared_passage_does_not_gather_in_one_task(spark, monkeypatch):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(150))
    docs = [(i, f"{rng.random()} {rng.random()} {passage} {rng.random()} {rng.random()}") for i in range(60)]
    repeats = suffix_dedup._repeats
    most = spark.sparkContext.accumulator(0)

    def counted(length):
        inner = repeats(length)

        def rows(batches):
            def seen():
                for batch in batches:
                    most.add(len(batch))
                    yield batch

            yield from inner(seen())

        return rows

    monkeypatch.setattr(suffix_dedup, "_repeats", counted)
    monkeypatch.setattr(suffix_dedup, "MANY", 20, raising=False)
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), 60).collect()
    # Anchors outside the passage have few segments and may gather; those at its ends have one for each document.
    assert min(r["n_removed"] for r in rows) >= 150 and most.value < len(docs)
