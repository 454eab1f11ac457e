"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lumenframe.plans.catalog.registry import REGISTRY  # noqa: E402
from lumenframe.session import local_session  # noqa: E402

HEADLINE = [
    "landmark_pairs_within", "landmark_top5", "case_prf", "overall_prf_optimal", "near_dup_kept", "path_merge_kept",
    "landmark_clusters", "branch_numbering", "prediction_documents", "sanity_flags", "distribution_by_status", "youden_cut",
    "threshold_sweep", "verdicts_current", "run_summary", "manifest_check", "calibration", "roi_crop", "dilate26", "contact_voxels",
    "distance_shell", "lumen_depth", "tube_filter", "seed_mask", "components26", "pca_shape", "context_fractions", "plane_radius",
    "detected_branches",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench", os.environ.get("BENCH_MEMORY", "16g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.time()
        REGISTRY[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
