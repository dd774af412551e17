"""Every registered query with a statement gives the statement's rows on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from lexigrain.plans.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_statement(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(rounded(r[c]) for c in columns) for r in df.collect())
    result = tables.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(tuple(rounded(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
