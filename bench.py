"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

HEADLINE = ["agg_01_consolidate_observations", "grf_01_components", "surface_track_points", "slv_01_intersect_rays", "slv_02_reconstruct_points",
            "flt_05_mad_displacement", "win_01_select_evidence", "agg_09_voxelize", "agg_10_splat", "jon_04_nearest_by_mode", "jon_05_sample_grid",
            "slv_06_block_counts", "ras_03_resample_bilinear", "ras_04_composite", "geo_11_rational_project", "cat_05_build_catalog", "jon_03_match_descriptors", "ras_02_inverse_map_regular"]


def main() -> None:
    import workloads
    from workloads.check import session

    spark = session(CPUS, CPUS)
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{SF_DIR}/nation.parquet").count()  # start the executor threads before timing
    times = {}
    for name in names:
        t = time.time()
        workloads.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
