"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from netloom.plans import ENTRIES  # noqa: E402
from netloom.runtime import build_session  # noqa: E402

HEADLINE = (
    "flagship_similarity_network",
    "io_read_delimited",
    "clean_all_steps",
    "profile_numeric",
    "dist_euclidean",
    "dist_cosine",
    "graph_build_edges",
    "measure_degrees",
    "measure_triangles",
    "components_connected",
    "centrality_pagerank_multigraph",
    "path_shortest",
    "community_label_propagation",
    "community_louvain",
    "centrality_pagerank",
    "centrality_closeness",
    "dist_nearest_neighbours",
    "community_blocks_louvain",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
