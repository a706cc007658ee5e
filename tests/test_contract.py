"""Every relational query against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tributary.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(row[i] for i in order) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_the_oracles_rows(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    expected = duck.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert multiset(frame.columns, frame.collect()) == multiset(columns, expected.fetchall())
