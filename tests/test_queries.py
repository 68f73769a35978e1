"""Every registered query with an oracle returns the oracle's rows, over whole tables."""

import decimal
import math

import duckdb
import pytest

from matchgrid.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.10g}")
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(value(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(name, spark, duck, sf):
    got = registry.queries()[name](spark, sf)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_whole_jobs(spark, duck, sf):
    run = lambda name: registry.queries()[name](spark, sf)
    sides = duck.execute("SELECT count(*) FILTER (vec_id % 5 = 0) * count(*) FILTER (vec_id % 5 <> 0) FROM embeddings").fetchone()[0]
    assert run("rerank_blend").count() == sides
    assert run("cross_unit_candidates").groupBy("site_id").count().agg({"count": "max"}).first()[0] > 20
    buyers = duck.execute("SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey").fetchone()[0]
    assert run("class_center_sample").where("positive").count() == buyers


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
