"""A sample of registered queries against their SQL oracle on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "latest_as_of", "price_changes", "page_chain_check", "comparables_strict", "broad_peers", "asking_benchmark", "broad_signal", "market_screen", "damage_category",
    "text_claims", "external_claim_fusion", "maximum_offer", "parts_estimate", "holdout_evaluation", "event_sink_outcomes", "change_driven_rescoring", "stream_latest_state",
    "page_ingestion_twice", "published_location", "candidate_cards", "round_robin_bands", "damage_mix_selection", "evidence_balanced_select", "selection_summary", "resume_state",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    theirs = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert sorted(names) == columns
    assert ours == theirs


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140
