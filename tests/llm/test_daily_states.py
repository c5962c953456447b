"""Combined daily states bound the exact median."""

import os

import pytest

from quern.llm import keyed_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_bounds_hold_the_exact_median(spark):
    bounds = {r["tag_set"]: (r["least"], r["greatest"]) for r in keyed_queries.p1_daily_states(spark, SF).collect()}
    exact = {r["tag_set"]: r["value"] for r in keyed_queries.p1_exact(spark, SF).filter("pct = 50").collect()}
    assert exact and set(bounds) == set(exact)
    for t, (low, high) in bounds.items():
        assert low <= exact[t] <= high and high - low <= 2**-8 * high
