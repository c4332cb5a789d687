"""Every registered query of the core against its SQL."""

import pytest
from compare import database, same

from galley.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: The tables name none of the desk's entities, and may hold no contradiction.
MAY_BE_EMPTY = {"F16_bridge_keys", "C04_event_conflicts", "J14_contradictions"}


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    sql = catalog.oracle_sql().get(name)
    if sql:
        same(df, con, sql)
    else:  # tested on fixtures; here it must end, with rows where the tables can have any
        rows = df.count()
        assert rows > 0 or name in MAY_BE_EMPTY
