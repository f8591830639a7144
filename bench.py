"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quillon import registry
from quillon.session import local_session

HEADLINE = ["evidence_level", "headline_answer", "facet_counts", "karyotype_bins", "size_factors", "log2fc", "bh_fdr", "robust_z", "bm25", "lexical_rank", "comparability_class", "rankable_classes", "step_verdict", "left_join_count", "entity_resolution", "rebuild_diff", "first_per_group", "matrix_pivot", "trace_breaks", "balance_by_bucket"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    registry.load()
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in (n for n in HEADLINE if n in registry.QUERIES):
        best = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
