"""A spread of checked queries against SQL at the smallest scale (python -m workloads.check runs all of them)."""

import pytest

from workloads import ORACLES, QUERIES
from workloads.check import compare, connect

SAMPLE = ["geo_04_triangulate_pair", "flt_01_filter_stages", "flt_07_precheck", "agg_01_consolidate_observations", "agg_05_residual_stats",
          "grf_03_conflict_free", "jon_04_nearest_by_mode", "jon_05_sample_grid", "win_01_select_evidence", "slv_01_intersect_rays", "cat_01_check_lifecycle"]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf_dir, name):
    state, note = compare(spark, connect(sf_dir), sf_dir, name)
    assert state == "ok", note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
