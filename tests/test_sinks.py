"""The append-only sink: first content of a key wins, unknown keys and contents are events like others."""

import random

from pyspark.sql import functions as F

from lotwise.sources import sinks

SCHEMA = "source string, source_id string, observed_at timestamp_ntz, content string, at long"


def _plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_new_events_are_those_of_the_outcomes(spark):
    rng = random.Random(3)
    row = lambda i: (rng.choice("ab"), str(rng.randrange(40)), None, rng.choice("xyz"), i)
    day = F.timestamp_add("DAY", F.expr("cast(source_id % 3 as int)"), F.lit("2001-01-01").cast("timestamp"))
    incoming, stored = (spark.createDataFrame([row(i) for i in range(n)], SCHEMA).withColumn("observed_at", day) for n in (200, 30))
    stored = stored.groupBy(*sinks.EVENT_KEY).agg(F.min("content").alias("content"))
    columns = (*sinks.EVENT_KEY, "content")
    want = sinks.event_outcomes(incoming, stored, "content", ["at"]).filter("outcome = 'new'")
    assert _plain(sinks.new_events(incoming, stored, "content", ["at"]), *columns) == _plain(want, *columns) and want.count() > 20


def test_unknown_keys_and_contents_are_written_once(spark, tmp_path):
    path, schema = str(tmp_path / "events"), "source string, source_id string, observed_at timestamp_ntz, content string"
    batch = spark.createDataFrame([("a", "1", None, "x", 2), ("a", "1", None, "y", 1), ("a", None, None, None, 1), ("b", "2", None, None, 1), ("b", "2", None, "z", 2)], SCHEMA)
    for _ in range(2):
        stored = sinks.read_or_empty(spark, path, spark.createDataFrame([], schema).schema)
        sinks.append_new(sinks.new_events(batch, stored, "content", ["at"]), path)
    got = _plain(spark.read.schema(schema).parquet(path), "source", "source_id", "observed_at", "content")
    assert got == sorted([("a", "1", None, "y"), ("a", None, None, None), ("b", "2", None, None)], key=repr)
