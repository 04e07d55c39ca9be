"""Every query with SQL against its SQL on the smallest tables; the others give rows."""

import pytest

from lotwise.llm import catalog

from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    theirs = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert sorted(names) == columns
    assert ours == theirs
