"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to completion through the noop sink, so all rows and columns
are computed and nothing is collected. Each is timed once, after a warm-up
query that starts the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from omiclattice.plans import catalog  # noqa: E402

HEADLINE = [
    "deg_multigroup", "deg_two_group", "dam_pairwise", "kruskal_wallis", "quantile_normalise", "size_factors",
    "impute_mean", "benjamini_hochberg", "correlation_screen", "pearson_pairs", "sample_correlation", "soft_threshold",
    "topological_overlap", "clustering_coefficient", "connected_components", "joint_pls_summary", "spectrum_annotation",
    "ppm_range_join", "formula_enumeration", "motif_rollup", "motif_conservation", "over_representation",
    "fuse_evidence", "hypothesis_ranking", "retrieval_top_k", "merge_references", "co_mentions", "stream_windowed_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("omiclattice-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["anova"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "omiclattice_headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
