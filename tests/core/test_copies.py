"""Queries against their DuckDB twins where events of one type share their millisecond."""

import os

import duckdb
import pytest

from quillon.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERY_NAMES = """
info keys_overwritten memory_by_type ns_stats ts_agg_overwritten ts_current ts_madd ts_mrange ts_mrange_overwritten
ts_range ts_range_agg_all ts_range_agg_count ts_range_overwritten ts_range_agg_avg ts_range_agg_sum ts_range_agg_min
ts_range_agg_max ts_range_agg_first ts_range_agg_last ts_range_agg_range ts_range_agg_stddev ts_retention ts_get ts_info
ts_incrby sql_group_by
""".split()


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The smallest tables, every event four times with its own id and user, up to 411 microseconds apart."""
    d = str(tmp_path_factory.mktemp("copies"))
    c = duckdb.connect()
    c.execute("set timezone='UTC'; set threads=1")
    apart = "event_id + i * 1000 as event_id, user_id + i * 15 as user_id, ts + to_microseconds(i * 137) as ts"
    for t in TABLES:
        if t == "events":
            c.execute(f"copy (select * exclude (i) replace ({apart}) from '{DATA}/{t}.parquet', (select unnest(range(4)) as i) order by event_id) to '{d}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{DATA}/{t}.parquet", f"{d}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return d, c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_samples_of_one_time_count_each(spark, copies, name):
    d, duck = copies
    df = QUERIES[name](spark, d)
    result = duck.execute(ORACLE[name])
    columns = [x[0] for x in result.description]
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_samples_keep_their_number(spark, tmp_path):
    from quillon.operators import keysview, timeseries
    from quillon.sources import keyspace

    s = spark.createDataFrame([("k", 1000, 1.0, 1, 1), ("k", 1000, 2.0, 2, 2), ("k", 1000, 5.0, 3, 1)], keyspace.SCHEMAS["series"] + ", sample bigint")
    keyspace.save(keyspace.empty(spark).with_(series=s, series_meta=spark.createDataFrame([("k", None, {})], keyspace.SCHEMAS["series_meta"])), str(tmp_path / "snap"))
    again = keyspace.load(spark, str(tmp_path / "snap"))
    assert keysview.keys_view(again).first().length == 2
    plain = spark.createDataFrame([("k", 1000, 8.0, 4), ("k", 1000, 9.0, 5)], keyspace.SCHEMAS["series"])
    for series in (s, again.series):
        assert sorted((r.ts_ms, r.value) for r in timeseries.range_(series, "-", "+").collect()) == [(1000, 2.0), (1000, 5.0)]
        assert timeseries.get(series).first().value == 5.0
        assert sorted(r.value for r in timeseries.range_(timeseries.add(series, plain), "-", "+").collect()) == [2.0, 5.0, 9.0]
        assert timeseries.del_(series, "k", "-", "+")[1].first().n == 2


def test_plain_series_are_aggregated_by_hash(spark):
    from quillon.operators import timeseries
    from quillon.sources import keyspace

    s = spark.createDataFrame([("k", 1000, 1.0, 1), ("k", 2000, 2.0, 2)], keyspace.SCHEMAS["series"])
    df = timeseries.aggregated(s, "-", "+", 5000, "first", "last")
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    assert tuple(df.select("first", "last").first()) == (1.0, 2.0)
