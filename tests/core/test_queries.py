"""Every registered query of the library against its DuckDB twin, on the smallest tables."""

import os

import duckdb
import pytest

from quillon.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    from quillon.operators import bloom

    members = spark.range(1000).selectExpr("cast(id as string) as x")
    others = spark.range(1000, 6000).selectExpr("cast(id as string) as x")
    bits = bloom.build(members, "x", 1000, 0.01)
    assert bloom.probe(bits, members, "x", 1000, 0.01).where("found = 0").count() == 0
    assert bloom.probe(bits, others, "x", 1000, 0.01).where("found = 1").count() < 150


def test_a_built_bloom_keeps_its_rate_beyond_its_capacity(spark):
    from quillon.operators import bloom

    members = spark.range(3000).selectExpr("cast(id as string) as x")
    others = spark.range(3000, 8000).selectExpr("cast(id as string) as x")
    bits = bloom.build(members, "x", 100, 0.01)
    assert bloom.probe(bits, members, "x", 100, 0.01).where("found = 0").count() == 0
    assert bloom.probe(bits, others, "x", 100, 0.01).where("found = 1").count() < 150


@pytest.mark.parametrize("name", ["bf_add_again", "bf_add", "bf_card"])
def test_bloom_queries_deal_items_before_they_make_bits(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    made = [at for at, line in enumerate(plan.splitlines()) if "Generate explode" in line]
    assert made and all(any("REPARTITION_BY_NUM" in line for line in plan.splitlines()[at : at + 5]) for at in made)
