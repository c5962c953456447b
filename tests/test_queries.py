"""A choice of registered queries against their SQL on the smallest tables, and the registry's promises."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import compare
from quern import queries as registry

SF = "/root/testdata/sf0.001"
CHOICE = ["p2_found", "p5_found", "ts_resample", "ts_aggregate_median", "ts_rollup_mean", "ts_uniform_median_absolute_deviation", "txt_search", "log_match_or", "log_correlates", "kv_prune", "kv_gc_any", "kv_as_of_join", "stat_t_test", "mon_latch", "obj_select_map_join", "stack_sequences", "src_log_round_trip", "stream_changes"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in compare.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOICE)
def test_query_matches_its_sql(spark, con, name):
    got = registry.all_queries()[name](spark, SF).toArrow().to_pandas()
    want = con.execute(registry.all_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.rows(got) == compare.rows(want)


def test_registry():
    assert set(registry.all_sql()) <= set(registry.all_queries())
    assert registry.FLAGSHIP in registry.all_queries()
