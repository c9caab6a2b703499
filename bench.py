"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from weftgraph.plans import registry  # noqa: E402
from weftgraph.session import get_spark  # noqa: E402

HEADLINE = [
    "triangle_count", "triangle_count_hash", "clean_edges", "degree", "oriented_edges", "adjacency_lists", "edge_support", "relabel_deg_desc",
    "components", "bfs_levels", "sssp", "pagerank", "mat_lowfilter_row_1", "mat_normalise_row_l2", "mat_scale_idf", "knn_cos", "frequent_itemsets", "rank_roc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", shuffle_partitions=2 * int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    queries["degree"](spark, sf_dir).count()  # JIT and file system warm-up
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
