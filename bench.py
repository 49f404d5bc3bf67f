"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is fully materialised (collected) once after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wordloom.plans import registry  # noqa: E402
from wordloom.session import local_session  # noqa: E402

HEADLINE = (
    "tokens_per_doc",
    "top_words_by_label",
    "top_bigrams_by_label",
    "top_words_by_role",
    "nb_metrics",
    "classifier_comparison",
    "cluster_label_alignment",
    "silhouette",
    "cluster_top_ngrams",
    "pca",
    "kmeans",
    "dbscan",
    "embed_documents",
    "compare_runs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="wordloom-bench")
    qs = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # session warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in qs:
            continue
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
