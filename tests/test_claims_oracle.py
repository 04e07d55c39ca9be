"""The SQL of text claims against the queries on whole texts, not only the seller sentences behind them."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = [
    "", "auto a gpl", "impianto a metano", "Gasolio, non diesel", "non  benzina e senza\ngpl", "no, metano", "petrol electric", "xdiesel dieselé ßgpl", "benzina metano", "numero 7926",
    "120.000 km e km 85.000", "km 12.345,6 km: 1234.567 KM=99 999", "tagliando a 50000 km", "tagliando " + "x" * 44 + "50000 km", "sostituita\n60000 km", "non certificati 12 000 000 km", "1 mila km, 90k chilometri, 7k km",
    "5000000 km", "km 5000km 6000.km 7000", "12345678 km", "batteriaéé e cinghia, km 4321", "é50000 kmé 40000 km", "5000 km." * 4, "km 85 000 5", "cambiato km 30000   km 31000",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("claims"))
    rows = [(24 * n + end, text, "it", "web", len(text)) for n, text in enumerate(TEXTS) for end in (0, 3, 10)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(path + "/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["mileage_claims", "fuel_claims"])
def test_whole_texts(spark, folder, name):
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        theirs = dict(con.execute(entry.oracle_sql()[name]).fetchall())
    ours = {r[0]: r[1] for r in entry.queries()[name](spark, folder).collect()}
    assert ours == theirs and len(set(ours.values())) > 5
