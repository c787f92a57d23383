"""How often plans read stored tables: nested running sums must not multiply their sources."""

import pytest
from flareframe.queries import all_queries

BOUNDS = {"e1_flux_windows": 4, "e2_augmented_clips": 4, "d15_rebalance": 4, "d08_keep_flag": 4, "d10_stratified_split": 4}


@pytest.mark.parametrize("name,most", BOUNDS.items())
def test_scans(spark, name, most):
    plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= most
