import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty texts, repeats, ties and clashing column names in one small table."""
    rows = [
        (1, "The same line here, long enough.\nAnother one follows it\n\nshort", "x"),
        (2, "The same line here, long enough!\nshort", "x"),
        (2, "The same line here, long enough!\nshort", "x"),
        (None, "A text without an id that goes on for a while", "y"),
        (None, None, None),
        (5, "", "y"),
        (6, None, "y"),
        (2**60 + 1, "word " * 3000, "z"),
        (8, "ÀÉ ünïcödé <|im_end|> 日本語 text", "z"),
    ]
    # Names that the operators use inside.
    return spark.createDataFrame([(a, b, c, 1, 2, 3, 4) for a, b, c in rows], "doc_id bigint, text string, lang string, row int, key int, words int, line int")
