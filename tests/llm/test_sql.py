"""Queries that SQL can express, against that SQL."""

import pytest

from bibspark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    flat = lambda names, values: sorted((tuple(v[i] for i in sorted(range(len(names)), key=lambda i: names[i])) for v in values), key=repr)
    assert flat(got.columns, [tuple(r) for r in got.collect()]) == flat(cols, want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
