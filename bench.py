"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siltmark.config import ExperimentConfig  # noqa: E402
from siltmark.plans import experiment  # noqa: E402
from siltmark.session import build_session  # noqa: E402
from workloads import bindings  # noqa: E402
from workloads.registry import QUERIES  # noqa: E402

HEADLINE = [
    "zone_table", "severity_from_votes", "majority_vote", "score", "per_class_metrics", "confusion", "paired_significance",
    "group_split", "cap_rows", "moments_train", "quantile_bins", "mi_label", "mi_label_order_lines", "mi_pairs", "mi_pairs_order_lines",
    "select_mrmr", "select_qubo", "pca_train", "linear_alignment", "head_predictions", "linear_head",
    "crop_plan", "annotation_report", "taxonomy_drift", "cache_report", "name_fingerprint", "verify_artifacts",
    "audit_runs", "rank_runs", "retention_plan", "pending_cells", "live_zone_table",
]


def ablation(spark, sf: str) -> None:
    """The experiment end to end: 5 repeats x 6 arms x 3 heads on the stored vectors, with all tables."""
    cfg = ExperimentConfig(
        classes=tuple(f"c{i}" for i in range(10)), n_repeats=5, pca_components=50,
        arms=("A_random", "B_pca", "C_mi", "D_qubo", "F_mrmr", "Z_full"),
    )
    out = experiment.run_experiment(bindings.vectors(spark, sf), cfg, sweeps=200)
    out.summary.collect()
    out.significance.collect()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").count().collect()  # start the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    start = time.perf_counter()
    ablation(spark, sf)
    times["ablation_5x6x3"] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
