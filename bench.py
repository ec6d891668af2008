"""Time the nine queries on the purchase graph; prints one JSON line.

The slice is cached and counted before the clock starts, as in the published
runs, and every column of every result is computed. Each query runs three
times in one session; ``queries`` has the median and ``all_runs`` each run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from catalog.folders import name_folder
from graphslice.model import GraphSlice, PropertyGraph
from graphslice.operators import dice
from graphslice.plans import batch
from graphslice.plans.workspace import Workspace, release
from graphslice.session import build_session
from graphslice.sources.starschema import purchase_edges, three_way_graph

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3

RUNS = [
    ("1a_multi_hop_h1", "whole", "multiHopDegreeDistribution", {"hops": 1}),
    ("1a_multi_hop_h2", "whole", "multiHopDegreeDistribution", {"hops": 2}),
    ("1a_multi_hop_h2_popular", "popular", "multiHopDegreeDistribution", {"hops": 2}),
    ("1b_ego_top6", "whole", "egoNetworkAggregation", {"topN": 6}),
    ("1c_rating_min28", "whole", "ratingSummary", {"minReviews": 28}),
    ("2a_shortest_paths_L3", "whole", "shortestPathMetrics", {"landmarks": 3}),
    ("2b_reachability_s3_h3", "whole", "reachabilityCounts", {"seeds": 3, "maxHops": 3}),
    ("2c_path_lengths_n5", "whole", "pathLengthDistribution", {"subsetSize": 5}),
    ("3a_clustering", "whole", "localClusteringCoefficient", {}),
    ("3a_clustering_three_way", "three_way", "localClusteringCoefficient", {}),
    ("3b_kcore_k25", "whole", "kCoreDecomposition", {"maxK": 25}),
    ("3b_kcore_k5_popular", "popular", "kCoreDecomposition", {"maxK": 5}),
    ("3c_pagerank_i7", "whole", "pageRankAggregation", {"iterations": 7}),
    ("3c_pagerank_i7_three_way", "three_way", "pageRankAggregation", {"iterations": 7}),
]


def main() -> None:
    spark = build_session(
        "bench", master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    name_folder(spark)
    workspace = Workspace(spark, "bench")

    def stored(edges, name: str) -> GraphSlice:
        edges.repartition(int(CPUS)).write.parquet(workspace.path(name))
        return GraphSlice(PropertyGraph.from_edges(workspace.read(name, schema=edges.schema)))

    whole = stored(purchase_edges(spark, SF_DIR), "purchases")
    slices = {
        "whole": whole,
        "popular": dice.dice_popularity(whole, 40),
        "three_way": stored(three_way_graph(spark, SF_DIR).edges, "three-way"),
    }
    wanted = sys.argv[1:]
    times: dict[str, list[float]] = {}
    sizes: dict[str, list[int]] = {}
    for name, on, query, params in RUNS:
        if wanted and not any(w in name for w in wanted):
            continue
        with slices[on].cached() as cut:
            size = cut.size().first()
            sizes[on] = [size.vertices, size.edges]
            for _ in range(REPEATS):
                began = time.monotonic()
                for df in batch.evaluate(cut, query, **params).values():
                    batch.drain(df)
                times.setdefault(name, []).append(round(time.monotonic() - began, 3))
    print(
        json.dumps(
            {
                "metric": "graph_rollup_total",
                "value": round(sum(median(runs) for runs in times.values()), 3),
                "unit": "sec",
                "queries": {name: median(runs) for name, runs in times.items()},
                "all_runs": times,
                "slices": sizes,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
