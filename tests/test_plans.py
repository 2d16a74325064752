"""Plans stay what they should be: pruned, pushed down, without row-wise Python."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_filters_and_columns_reach_the_scan(spark):
    p = plan(entry.queries()["offset_limit"](spark, DATA))
    assert "PushedFilters: [IsNotNull(o_orderkey)" in p and "o_totalprice" not in p
    p = plan(entry.queries()["centroid"](spark, DATA))
    assert "confidence" not in p and "world_timestamp" not in p


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if not re.match(r"p\d+_", n)])
def test_no_row_wise_python_and_no_product(spark, name):
    p = plan(entry.queries()[name](spark, DATA))
    assert "BatchEvalPython" not in p and "CartesianProduct" not in p and "ArrowEvalPython" not in p
