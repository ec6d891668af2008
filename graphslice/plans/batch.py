"""Several queries over several slices, and the sizes and times that go with them."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphslice.model import GraphSlice, PropertyGraph, as_slice
from graphslice.operators import centrality, dice, neighborhood, paths
from graphslice.plans import skew
from graphslice.plans.workspace import Workspace, literal_rows, union_all

PARTS = 1000  # into which a round of counts cuts a range of values

MEASUREMENT_SCHEMA = T.StructType(
    [
        T.StructField("query_class", T.StringType()),
        T.StructField("query_name", T.StringType()),
        T.StructField("vertices_involved", T.LongType()),
        T.StructField("edges_involved", T.LongType()),
        T.StructField("elapsed_ms", T.LongType()),
        T.StructField("result_rows", T.LongType()),
        T.StructField("params", T.StringType()),
    ]
)

Tables = dict[str, DataFrame]


class Query(NamedTuple):
    """One of the nine queries: its class, the ending its parameter gives the
    recorded name, its tables, and how many of those make up ``result_rows``."""

    query_class: str
    ending: str
    run: Callable[..., Tables]
    counted: int = 1


QUERIES: dict[str, Query] = {
    "multiHopDegreeDistribution": Query(
        "neighborhood",
        "_h{hops}",
        lambda s, hops: {"distribution": neighborhood.multi_hop_degree_distribution(s, hops)},
    ),
    "egoNetworkAggregation": Query(
        "neighborhood",
        "_top{topN}",
        lambda s, topN: {"egos": neighborhood.ego_network_aggregation(s, topN)},
    ),
    "ratingSummary": Query(
        "neighborhood",
        "_min{minReviews}",
        lambda s, minReviews: {"products": neighborhood.rating_summary(s, minReviews)},
    ),
    "shortestPathMetrics": Query(
        "path",
        "_L{landmarks}",
        lambda s, landmarks: paths.shortest_path_metrics(s, landmarks)._asdict(),
        counted=2,
    ),
    "reachabilityCounts": Query(
        "path",
        "_h{maxHops}",
        lambda s, seeds, maxHops: paths.reachability(s, seeds, maxHops)._asdict(),
    ),
    "pathLengthDistribution": Query(
        "path",
        "_n{subsetSize}",
        lambda s, subsetSize: paths.path_length_distribution(s, subsetSize)._asdict(),
    ),
    "localClusteringCoefficient": Query(
        "centrality",
        "",
        lambda s: centrality.local_clustering_coefficient(s)._asdict(),
    ),
    "kCoreDecomposition": Query(
        "centrality",
        "_k{maxK}",
        lambda s, maxK: centrality.k_cores(s, maxK)._asdict(),
    ),
    "pageRankAggregation": Query(
        "centrality",
        "_i{iterations}",
        lambda s, iterations: centrality.page_rank_aggregation(s, iterations)._asdict(),
    ),
}

# The demonstration, four slices and the queries shown on each.
DEMO: list[tuple[str, str, dict]] = [
    ("dense", "multiHopDegreeDistribution", {"hops": 2}),
    ("dense", "egoNetworkAggregation", {"topN": 5}),
    ("dense", "ratingSummary", {"minReviews": 300}),
    ("dense", "shortestPathMetrics", {"landmarks": 3}),
    ("dense", "reachabilityCounts", {"seeds": 3, "maxHops": 3}),
    ("dense", "pathLengthDistribution", {"subsetSize": 5}),
    ("dense", "localClusteringCoefficient", {}),
    ("dense", "kCoreDecomposition", {"maxK": 5}),
    ("dense", "pageRankAggregation", {"iterations": 10}),
    ("rating", "multiHopDegreeDistribution", {"hops": 2}),
    ("rating", "ratingSummary", {"minReviews": 50}),
    ("rating", "pageRankAggregation", {"iterations": 10}),
    ("rating", "kCoreDecomposition", {"maxK": 4}),
    ("quality", "egoNetworkAggregation", {"topN": 5}),
    ("quality", "shortestPathMetrics", {"landmarks": 3}),
    ("quality", "localClusteringCoefficient", {}),
    ("apex", "ratingSummary", {"minReviews": 500}),
    ("apex", "pageRankAggregation", {"iterations": 5}),
]


def demo_slices(
    base: GraphSlice | PropertyGraph, dense: int = 300, busy: int = 100
) -> dict[str, GraphSlice]:
    """The demonstration's slices; the thresholds scale it to smaller data."""
    popular = dice.dice_popularity(base, busy)
    return {
        "dense": dice.dice_popularity(base, dense),
        "rating": dice.dice_score(popular, 5.0, 5.0),
        "quality": dice.dice_helpfulness(popular, 0.8),
        "apex": dice.dice_all(base),
    }


def evaluate(source: GraphSlice | PropertyGraph, query: str, **params: int) -> Tables:
    """Run one of the nine queries by name."""
    return QUERIES[query].run(as_slice(source), **params)


def by_slice(slices: Mapping[str, GraphSlice], query: Callable[[GraphSlice], DataFrame]) -> DataFrame:
    """One result for several slices, told apart by a ``slice`` column."""
    return union_all([query(cut).withColumn("slice", F.lit(name)) for name, cut in slices.items()])


def run_batch(
    slices: Mapping[str, GraphSlice], plan: Sequence[tuple[str, str, dict]]
) -> dict[tuple[str, str], DataFrame]:
    """Results of a list of (slice, query, params), one table per query and result.

    Results of one query on several slices share a table with a ``slice`` column.
    """
    parts: dict[tuple[str, str], list[DataFrame]] = {}
    for slice_name, query, params in plan:
        for table, df in evaluate(slices[slice_name], query, **params).items():
            parts.setdefault((query, table), []).append(df.withColumn("slice", F.lit(slice_name)))
    return {key: union_all(frames) for key, frames in parts.items()}


def store_batch(
    slices: Mapping[str, GraphSlice], plan: Sequence[tuple[str, str, dict]], path: str
) -> dict[tuple[str, str], DataFrame]:
    """:func:`run_batch` with each result stored under ``path``, slice by slice.

    A slice is open while its queries run, so its undirected tables are written
    once for all of them, and they and the queries' own tables are deleted when
    its last result is stored.
    """
    made: dict[tuple[str, str], T.StructType] = {}
    for name, cut in slices.items():
        asked = [(query, params) for slice_name, query, params in plan if slice_name == name]
        with cut.open():
            for query, params in asked:
                for table, df in evaluate(cut, query, **params).items():
                    rows = df.withColumn("slice", F.lit(name))
                    mode = "append" if (query, table) in made else "overwrite"
                    rows.write.mode(mode).parquet(f"{path}/{query}/{table}")
                    made[query, table] = rows.schema
    spark = next(iter(slices.values())).edges.sparkSession
    return {key: spark.read.schema(schema).parquet(f"{path}/{key[0]}/{key[1]}") for key, schema in made.items()}


def slice_sizes(
    base: GraphSlice | PropertyGraph,
    thresholds: Sequence[int],
    score: tuple[float, float] = (4.0, 5.0),
    helpfulness: float = 0.5,
) -> DataFrame:
    """(threshold, second_dice, vertices, edges) of every slice of the sweep at once.

    A popularity slice keeps an edge when its product's review count is high
    enough, so a vertex is in the slice when the highest count on its edges
    is. One pass that keeps that highest count per vertex, for all edges and
    for those a second dice keeps, sizes every slice.
    """
    edges = as_slice(base).edges
    workspace = Workspace(edges.sparkSession, "sizes")
    counts = dice.product_reviews(edges)
    limit = skew.hot_rows(edges.sparkSession, workspace.write(counts, "products", F.sum("n").alias("total"))["total"])
    counts = workspace.read("products", schema=counts.schema)
    # n also says how many salts a product's reviews are spread over.
    copies = counts.select("dst", "n", skew.salts(skew.fan_of(F.col("n"), limit)).alias("salt"))
    reviews = skew.spread(edges, "dst", F.col("src"), skew.hot_keys(counts, "dst", "n", limit))
    kept = {
        "none": F.lit(True),
        "score": F.col("score").between(*score),
        "helpfulness": F.col("helpfulness") >= helpfulness,
    }
    levels = reviews.join(copies, ["dst", "salt"]).select(
        "src", "dst", *(F.when(test, F.col("n")).alias(name) for name, test in kept.items())
    )
    cuts = F.array(*(F.lit(t).cast("bigint") for t in thresholds))

    def tally(rows: DataFrame, out: str) -> DataFrame:
        """Count the ``rows`` that each slice keeps, after combining equal ones."""
        combined = rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("w"))
        long = combined.unpivot("w", list(kept), "second_dice", "n")
        passed = F.explode(F.filter(cuts, lambda t: t <= F.col("n"))).alias("threshold")
        return long.select(passed, "second_dice", "w").groupBy("threshold", "second_dice").agg(F.sum("w").alias(out))

    per_vertex = (
        levels.select(F.explode(F.array("src", "dst")).alias("id"), *kept)
        .groupBy("id")
        .agg(*(F.max(name).alias(name) for name in kept))
    )
    return tally(per_vertex, "vertices").join(tally(levels, "edges"), ["threshold", "second_dice"])


def drain(df: DataFrame) -> int:
    """Compute every row and column of ``df`` and return the row count.

    A plain ``count()`` would let Spark leave out most of the aggregates.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get.get("rows") or 0


def measure(source: GraphSlice | PropertyGraph, query: str, **params: int) -> tuple:
    """Time one query on a slice to full results; a row of ``MEASUREMENT_SCHEMA``."""
    cut = as_slice(source)
    size = cut.size().first()
    kind = QUERIES[query]
    began = time.monotonic()
    tables = evaluate(cut, query, **params)
    counts = [drain(df) for df in tables.values()]
    elapsed = int((time.monotonic() - began) * 1000)
    rows = sum(counts[: kind.counted])
    if query == "reachabilityCounts":  # recorded as (seed, vertex) pairs
        rows = tables["curve"].agg(F.max("reachable")).first()[0] or 0
    name = query + kind.ending.format(**params)
    described = ";".join([*(f"{k}={v}" for k, v in params.items()), cut.description])
    return (kind.query_class, name, size.vertices, size.edges, elapsed, rows, described)


def measurements(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MEASUREMENT_SCHEMA)
    return literal_rows(spark, list(rows), ddl).orderBy("vertices_involved")


def mean_times(measured: DataFrame) -> DataFrame:
    """(query_class, query_name, mean_ms, runs), by class and then by mean."""
    return (
        measured.groupBy("query_class", "query_name")
        .agg(F.avg("elapsed_ms").alias("mean_ms"), F.count(F.lit(1)).alias("runs"))
        .orderBy("query_class", "mean_ms")
    )


def time_series(measured: DataFrame, size: str = "vertices_involved") -> DataFrame:
    """(query_class, size, elapsed_ms, log_ms): times in order of size, per class."""
    clipped = F.greatest("elapsed_ms", F.lit(1).cast("bigint"))
    return measured.select("query_class", size, "elapsed_ms", clipped.alias("log_ms")).orderBy("query_class", size)


def exact_quantiles(values: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """(key, quantile) of the whole numbers in ``value`` for each ``key``, interpolated between two neighbours.

    The two order statistics are closed in on by counts: a round cuts what is
    left of their range into a thousand parts and counts the values in each,
    so no task ever holds the values of a key.
    """
    workspace = Workspace(values.sparkSession, "quantiles")
    given = values.select(F.col(key).alias("key"), F.col(value).cast("bigint").alias("x")).filter("x IS NOT NULL")
    place = (F.col("n") - 1) * F.lit(q)
    ends = F.array(F.struct(F.lit("low").alias("end"), F.floor(place)), F.struct(F.lit("high").alias("end"), F.ceil(place)))
    state = (
        given.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        .select("key", (place - F.floor(place)).alias("share"), "least", "most", F.inline(ends).alias("end", "rank"))
    )
    schema, widest = state.schema, F.max(F.col("most") - F.col("least")).alias("widest")
    seen, number = workspace.write(state, "state-0", widest), 0
    while seen["widest"] > 0:
        state = workspace.read(f"state-{number}", schema=schema)
        width = F.ceil((F.col("most") - F.col("least") + 1) / F.lit(PARTS)).cast("bigint")
        sought = skew.bounded(state.withColumn("width", width).withColumnRenamed("key", "of"), seen["rows"])
        near = given.join(sought, F.col("key").eqNullSafe(F.col("of")) & F.col("x").between(F.col("least"), F.col("most")))
        same = ["of", "end", "share", "rank", "least", "most", "width"]
        counted = near.groupBy(*same, F.expr("(x - least) div width").alias("part")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("of", "end").orderBy("part"))  # a thousand rows at most
        first = F.col("least") + F.col("part") * F.col("width")
        state = (
            counted.withColumn("upto", upto)
            .filter("rank < upto AND rank >= upto - n")
            .select(
                F.col("of").alias("key"),
                "share",
                first.alias("least"),
                F.least("most", first + F.col("width") - 1).alias("most"),
                "end",
                (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"),
            )
        )
        number += 1
        seen = workspace.write(state, f"state-{number}", widest)
    found = workspace.read(f"state-{number}", schema=schema).groupBy("key")
    both = found.agg(F.min("least").alias("a"), F.max("least").alias("b"), F.first("share").alias("share"))
    return both.select("key", (F.col("a") + F.col("share") * (F.col("b") - F.col("a"))).alias("quantile"))


def time_summary(measured: DataFrame) -> DataFrame:
    """One row per class and one for all: runs, median time, correlation with size."""
    figures = (
        F.count(F.lit(1)).alias("runs"),
        F.corr("elapsed_ms", "vertices_involved").alias("r_vertices"),
        F.corr("elapsed_ms", "edges_involved").alias("r_edges"),
    )
    median = lambda rows: exact_quantiles(rows, "query_class", "elapsed_ms", 0.5).select(
        F.col("key").alias("query_class"), F.col("quantile").alias("median_ms")
    )
    per_class = measured.groupBy("query_class").agg(*figures)
    pooled = measured.agg(*figures).select(F.lit("all").alias("query_class"), "runs", "r_vertices", "r_edges")
    together = measured.withColumn("query_class", F.lit("all"))
    return (
        per_class.join(median(measured).withColumnRenamed("query_class", "of"), F.col("query_class").eqNullSafe(F.col("of")), "left")
        .unionByName(pooled.join(median(together).withColumnRenamed("query_class", "of"), F.col("query_class") == F.col("of"), "left"))
        .select("query_class", "runs", "median_ms", "r_vertices", "r_edges")
    )
