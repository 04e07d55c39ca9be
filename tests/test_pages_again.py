"""Pages collected again, from events that repeat and lie in any order."""

import duckdb
import pytest

import __spark_entry__ as entry
from lotwise.catalog import streams


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same events in two orders; most repeat the listing and time of another one."""
    out = []
    rows = spark.range(400).selectExpr("id as event_id", "timestamp'2001-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 90 as int)) as ts", "id % 9 as user_id", "if(id % 2 = 0, 'view', 'click') as event_type", "1.0D as value", "'{}' as props")
    for order in ("event_id", "hash(event_id)"):
        path = str(tmp_path_factory.mktemp("events"))
        rows.selectExpr("*", f"{order} as o").repartitionByRange(4, "o").sortWithinPartitions("o").drop("o").write.parquet(path + "/events.parquet")
        out.append(path)
    return out


def test_pages_have_one_order(spark, folders):
    one, two = (sorted(map(repr, streams._pages(spark, d).collect())) for d in folders)
    assert one == two


def test_stored_once(spark, folders):
    got = sorted(map(tuple, entry.queries()["page_ingestion_twice"](spark, folders[1]).select("source", "pages", "accepted", "rejected").collect()))
    with duckdb.connect() as con:
        con.execute(f"create view events as select * from '{folders[1]}/events.parquet/*.parquet'")
        assert got == sorted(con.execute(entry.oracle_sql()["page_ingestion_twice"]).fetchall())
    assert sum(r[2] for r in got) < 200
