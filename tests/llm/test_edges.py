"""Every query over tables full of nulls, empty and very long texts, ties, repeats and clashing columns; and over empty tables."""

import pytest

from galley.llm import queries

NAMES = sorted(queries.queries())


@pytest.mark.parametrize("name", NAMES)
def test_dirty(spark, dirty, name):
    df = queries.queries()[name](spark, dirty)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
        assert all(v is not None for r in rows for v in r)


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    assert queries.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    from compare import database, same

    folder = "/root/testdata/sf0.001"
    same(queries.queries()[name](spark, folder), database(folder), queries.oracle_sql()[name])
