"""Ingestion is idempotent, tolerates late rows and never lets a second content win."""

import json

from pyspark.sql import functions as F

from lotwise.session import shared_folder
from lotwise.streaming import ingest

LATER = "2030-01-01"


def record(i, stamp="2026-01-01T00:00:00Z", price=100):
    return dict(source_id=str(i), observed_at=stamp, url="https://a.example/1", active=True, payload=json.dumps(dict(country="IT", price_eur=price)))


def page(page_id, records, cursor=None, after=None, complete=True):
    return dict(source="s", run_id="r", page_id=page_id, mode="initial", scope='{"country":"IT"}', input_cursor=cursor, next_cursor=after, complete=complete, records=records)


def send(spark, folder, name, *pages):
    import os

    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(json.dumps(p) for p in pages))


def test_pages(spark):
    source, log = shared_folder(spark, "p"), shared_folder(spark, "l")
    store = ingest.PageStore(spark, shared_folder(spark, "st"))
    run = lambda: ingest.ingest_stream(spark, source, store, log, F.lit(LATER).cast("timestamp")).awaitTermination()
    send(spark, source, "a.json", page("1", [record(1), record(2), record(3, stamp="2026-01-01T00:00:00")], after="c1", complete=False))
    run()
    # The same page again, an older late row, and a different content for a stored key.
    send(spark, source, "b.json", page("1", [record(1), record(2), record(3, stamp="2026-01-01T00:00:00")], after="c1", complete=False))
    send(spark, source, "c.json", page("2", [record(1, stamp="2025-01-01T00:00:00Z"), record(2, price=999)], cursor="c1"))
    run()
    assert {(r["source_id"], r["observed_at"].year) for r in store.events().collect()} == {("1", 2026), ("2", 2026), ("1", 2025)}
    assert store.manifest().count() == 2
    assert sorted(r["issue"] for r in store.quarantine().collect()) == ["Conflicting immutable event", "Timestamp needs timezone"]
    state = ingest.resume_state(store.manifest()).collect()[0]
    assert state["action"] == "nothing_to_do"


def chain_page(page_id, cursor, after, run="r", **other):
    return dict(page(page_id, [record(page_id)], cursor=cursor, after=after, complete=after is None), run_id=run, **other)


def collect_in(spark, *batches):
    """The store after batches of pages."""
    source, log = shared_folder(spark, "p"), shared_folder(spark, "l")
    store = ingest.PageStore(spark, shared_folder(spark, "st"))
    for n, pages in enumerate(batches):
        send(spark, source, f"{n}.json", *pages)
        ingest.ingest_stream(spark, source, store, log, F.lit(LATER).cast("timestamp")).awaitTermination()
    return store


def test_a_run_is_a_chain_across_and_inside_batches(spark):
    """Names out of order, a fork, a broken link, another setup and a page after the end, in two batches."""
    first = [
        chain_page("c", "1", "2"), chain_page("a", None, "0"), chain_page("z", "0", "1"),
        chain_page("d", "1", "other"), chain_page("e", "other", None),  # a fork, and what follows only the fork
        chain_page("f", "lost", "9"), chain_page("g", "2", "3", mode="incremental"),
        chain_page("h", "0", "5", run="q"), chain_page("k", "x" * 4001, "7"), chain_page("", "2", "8"),
    ]
    second = [chain_page("y", "3", "4", scope='{ "country" : "IT" }'), chain_page("b", "2", "3"), chain_page("x", "4", None), chain_page("w", "5", None), chain_page("a2", None, "1")]
    third = [chain_page("late", "4", None), chain_page("a", None, "0")]
    store = collect_in(spark, first, second, third)
    assert {r["page_id"]: r["sequence"] for r in store.manifest().collect()} == {"a": 1, "z": 2, "c": 3, "b": 4, "y": 5, "x": 6}
    assert {r["source_id"] for r in store.events().collect()} == {"a", "z", "c", "b", "y", "x"}
    refused = {(r["run_id"], r["page_id"]): r["issue"] for r in store.quarantine().collect()}
    off = "page does not continue the saved cursor"
    assert refused == {
        ("r", "d"): off, ("r", "e"): off, ("r", "f"): off, ("r", "g"): "run configuration changed", ("q", "h"): "first page requires a null input cursor",
        ("r", "k"): "cursor must be a nonempty text or null", ("r", ""): "identifiers require text of at most 200 characters",
        ("r", "w"): off, ("r", "a2"): off, ("r", "late"): "run already completed",
    }
    assert ingest.resume_state(store.manifest()).collect()[0]["action"] == "nothing_to_do"


def test_long_chains_in_any_order_of_names(spark):
    from lotwise.streaming.chains import continue_runs, run_tails
    import random

    names = list(range(200))
    random.Random(3).shuffle(names)
    rows = [("s", "r", f"{names[i]:03d}", "x", "initial", "{}", None if i == 0 else f"c{i}", f"c{i + 1}", False) for i in range(200)]
    # A circle: the last page leads back to the middle; a run of its own without a start.
    rows[-1] = (*rows[-1][:7], "c100", False)
    rows += [("s", "loop", "1", "x", "initial", "{}", "a", "b", False), ("s", "loop", "2", "x", "initial", "{}", "b", "a", False)]
    schema = "source string, run_id string, page_id string, checksum string, mode string, scope string, input_cursor string, next_cursor string, complete boolean"
    pages = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r["run_id"], r["page_id"]): r["sequence"] for r in continue_runs(pages, run_tails(spark.createDataFrame([], ingest.MANIFEST))).collect()}
    assert got == {**{("r", f"{names[i]:03d}"): i + 1 for i in range(200)}, ("loop", "1"): None, ("loop", "2"): None}


def test_refused_records_come_back_whole(spark):
    foreign = dict(record(1), payload=json.dumps(dict(country="FR")))
    store = collect_in(spark, [page("1", [foreign, record(2)])])
    back = ingest.read_back(store.quarantine()).collect()
    assert [r["r"].asDict() for r in back] == [foreign]
