"""Every query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from serospark.plans import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(round(value, 4) + 0.0) if isinstance(value, float) else str(value)


def table(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalogue.ORACLES])
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF_DIR)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert table(got.columns, got.collect()) == table(columns, found.fetchall())


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalogue.ORACLES])
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF_DIR).count() > 0


def test_no_twin_without_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
