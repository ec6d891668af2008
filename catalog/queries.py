"""Each query takes a session and a folder of test tables and returns a result."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphslice.functions import measures
from graphslice.model import GraphSlice, PropertyGraph, derive_vertices
from graphslice.operators import centrality, dice, neighborhood, paths, views
from graphslice.plans import batch
from graphslice.plans.workspace import Workspace
from graphslice.sources import reviews, tables
from graphslice.sources.starschema import order_lines, purchase_graph, three_way_graph

Query = Callable[[SparkSession, str], DataFrame]

THRESHOLDS = (20, 25, 30, 35, 40, 45, 50)


def on_graph(operator: Callable[[PropertyGraph], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(purchase_graph(spark, sf_dir))


def on_popular(min_reviews: int, operator: Callable[[GraphSlice], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(dice.dice_popularity(purchase_graph(spark, sf_dir), min_reviews))


def on_three_way(operator: Callable[[PropertyGraph], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(three_way_graph(spark, sf_dir))


def raw_texts(lines: DataFrame, *keep: str) -> DataFrame:
    """Raw measure texts of every order line, some of them malformed."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    number = F.col("l_linenumber").cast("string")
    part = F.col("l_partkey") % 8
    score = (
        F.when(part == 0, F.lit("")).when(part == 1, F.lit("n/a")).when(part == 2, F.concat(F.lit(" "), quantity))
        .otherwise(F.concat(quantity, F.lit(".5")))
    )
    ratio = (
        F.when(part == 3, F.concat(number, F.lit("/0"))).when(part == 4, number)
        .when(part == 5, F.concat(number, F.lit("/"), quantity, F.lit("/1")))
        .otherwise(F.concat(number, F.lit("/"), quantity))
    )
    when = (
        F.when(part == 6, F.lit("12.5")).when(part == 7, F.lit(""))
        .otherwise(F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string"))
    )
    return lines.select(*keep, score.alias("score"), ratio.alias("helpfulness"), when.alias("time"))


def clean_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return raw_texts(lines, "l_orderkey", "l_linenumber").select(
        "l_orderkey",
        "l_linenumber",
        measures.score(F.col("score")).alias("score"),
        measures.helpfulness(F.col("helpfulness")).alias("helpfulness"),
        measures.epoch_seconds(F.col("time")).alias("timestamp"),
    )


def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as raw review text files, read back as records.

    Every eleventh customer is anonymous. The profile name on a review tells
    which order it came from, and the files are in order of the order lines,
    so the first name of a user is that of the first order.
    """
    lines = order_lines(spark, sf_dir, "l_linenumber", "l_quantity", "l_shipdate")
    texts = raw_texts(lines, "o_custkey", "l_partkey", "l_orderkey", "l_linenumber")
    user = F.when(F.col("o_custkey") % 11 == 0, F.lit(measures.ANONYMOUS_USER)).otherwise(
        F.col("o_custkey").cast("string")
    )
    values = {
        "product": F.col("l_partkey").cast("string"),
        "user": user,
        "name": F.concat(F.lit("José: "), F.col("l_orderkey").cast("string")),
        "helpfulness": F.col("helpfulness"),
        "score": F.col("score"),
        "time": F.col("time"),
    }
    block = F.concat_ws("\n", *(F.concat(F.lit(f"{reviews.KEYS[k]}: "), v) for k, v in values.items()))
    workspace = Workspace(spark, "raw")
    latin1 = F.encode(F.concat(block, F.lit("\n")), "ISO-8859-1").cast("string")
    ordered = texts.orderBy("l_orderkey", "l_linenumber")
    ordered.select(latin1.alias("value")).write.text(workspace.path("reviews"))
    return reviews.read_records(spark, workspace.path("reviews"))


def raw_review_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.review_edges(_raw_records(spark, sf_dir))


def raw_review_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.review_vertices(_raw_records(spark, sf_dir))


def edges_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "csv").path("edges")
    tables.write_csv(purchase_graph(spark, sf_dir).edges, path)
    return tables.read_edges_csv(spark, path)


def persist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the graph by year, read it back, and time-dice what was stored."""
    path = Workspace(spark, "store").path("graph")
    tables.write_graph(purchase_graph(spark, sf_dir), path, by_year=True)
    stored = tables.read_graph(spark, path)
    return dice.dice_time(stored, 820454400, 883612799).edges.select(
        "src", "dst", "score", "helpfulness", "timestamp"
    )


def slice_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dice.dice_helpfulness(
        dice.dice_score(dice.dice_popularity(purchase_graph(spark, sf_dir), 30), 4, 5), 0.5
    )
    return cut.size().withColumn("description", F.lit(cut.description))


def mean_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines recast as measurements, rolled up per query and class."""
    return batch.mean_times(_measured(spark, sf_dir)).select("query_class", "query_name", "mean_ms", "runs")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_linestatus").alias("query_class"),
        F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("query_name"),
        F.col("l_partkey").alias("vertices_involved"),
        F.col("l_suppkey").alias("edges_involved"),
        F.col("l_quantity").cast("bigint").alias("elapsed_ms"),
    )


def measurements_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines recast as measurements with a quoted text, as CSV and back."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    params = F.format_string('k=%s, flag="%s"', F.col("l_linenumber").cast("string"), F.col("l_returnflag"))
    measured = lines.select(
        F.col("l_linestatus").alias("query_class"),
        F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("query_name"),
        F.col("l_partkey").alias("vertices_involved"),
        F.col("l_suppkey").alias("edges_involved"),
        F.col("l_quantity").cast("bigint").alias("elapsed_ms"),
        F.col("l_linenumber").cast("bigint").alias("result_rows"),
        params.alias("params"),
    )
    path = Workspace(spark, "csv").path("measured")
    tables.write_measurements(measured, path)
    return tables.read_measurements(spark, path)


def time_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.time_summary(_measured(spark, sf_dir)).select(
        "query_class",
        "runs",
        "median_ms",
        F.round("r_vertices", 6).alias("r_vertices"),
        F.round("r_edges", 6).alias("r_edges"),
    )


def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.time_series(_measured(spark, sf_dir))


def _slices(graph: PropertyGraph) -> dict[str, GraphSlice]:
    """The demonstration's slices. Each reads the reviews more than once, so they are joined and written once for all."""
    edges = Workspace(graph.edges.sparkSession, "slices").save(graph.edges, "reviews")
    return batch.demo_slices(PropertyGraph.from_edges(edges), dense=35, busy=30)


def rounded(ranks: DataFrame) -> DataFrame:
    return ranks.withColumn("pagerank", F.round("pagerank", 6))


def top_rounded(ranks: DataFrame) -> DataFrame:
    return centrality.top_ranks(rounded(ranks))


QUERIES: dict[str, Query] = {
    # sources and sinks
    "clean_measures": clean_measures,
    "raw_review_edges": raw_review_edges,
    "raw_review_vertices": raw_review_vertices,
    "build_edges": on_graph(lambda g: g.edges),
    "edges_csv_roundtrip": edges_csv_roundtrip,
    "edge_cap": on_graph(lambda g: tables.cap_edges(g.edges, 1000)),
    "graph_summary": on_graph(lambda g: g.summary()),
    "derive_vertices": on_graph(lambda g: derive_vertices(g.edges)),
    "persist_roundtrip": persist_roundtrip,
    # dices
    "dice_all": on_graph(lambda g: dice.dice_all(g).edges),
    "dice_score": on_graph(lambda g: dice.dice_score(g, 4.0, 5.0).edges),
    "dice_time": on_graph(lambda g: dice.dice_time(g, 820454400, 883612799).edges),
    "dice_helpfulness": on_graph(lambda g: dice.dice_helpfulness(g, 0.5).edges),
    "dice_popularity": on_popular(30, lambda s: s.edges),
    "dice_sample": on_graph(lambda g: dice.dice_sample(g, 0.25, 42).edges),
    "dice_sample_vertices": on_graph(lambda g: dice.dice_sample(g, 0.25, 42).vertices),
    "induced_vertices": on_graph(
        lambda g: dice.dice_popularity(PropertyGraph(g.vertices, g.edges), 30).vertices
    ),
    "slice_size": on_popular(30, lambda s: s.size()),
    "slice_description": slice_description,
    # views
    "undirected_edges": on_graph(views.undirected_edges),
    "undirected_scored": on_graph(views.undirected_scored),
    "degree": on_graph(views.degree),
    "top_hubs": on_graph(lambda g: views.top_hubs(g, 5)),
    "top_hubs_by_label": on_graph(lambda g: views.top_hubs_by_label(g, 5)),
    # neighbourhoods
    "khop_pairs": on_graph(lambda g: neighborhood.khop_pairs(g, 2, views.top_hubs(g, 50))),
    "khop_degree": on_graph(lambda g: neighborhood.khop_degree(g, 2)),
    "multi_hop_degree_h1": on_graph(lambda g: neighborhood.multi_hop_degree_distribution(g, 1)),
    "multi_hop_degree_h2": on_graph(lambda g: neighborhood.multi_hop_degree_distribution(g, 2)),
    "multi_hop_degree_h3": on_graph(lambda g: neighborhood.multi_hop_degree_distribution(g, 3)),
    "ego_members": on_graph(lambda g: neighborhood.EgoNetworks(g, 5).members()),
    "ego_edges": on_graph(lambda g: neighborhood.EgoNetworks(g, 5).edges()),
    "ego_network": on_graph(lambda g: neighborhood.ego_network_aggregation(g, 5)),
    "ego_network_three_way": on_three_way(
        lambda g: neighborhood.ego_network_aggregation(
            PropertyGraph(g.vertices, g.edges.withColumn("score", F.length("src").cast("double"))), 5
        )
    ),
    "rating_summary": on_popular(30, lambda s: neighborhood.rating_summary(s, 35)),
    # paths
    "bfs_distances": on_graph(lambda g: paths.hub_distances(g, 3)),
    "distance_maps": on_graph(
        lambda g: paths.distance_maps(paths.hub_distances(g, 3)).select(
            "id", F.explode("distances").alias("landmark", "dist")
        )
    ),
    "sp_histogram": on_graph(lambda g: paths.shortest_path_metrics(g, 3).histogram),
    "sp_per_landmark": on_graph(lambda g: paths.shortest_path_metrics(g, 3).per_landmark),
    "reachability": on_graph(lambda g: paths.reachability(g, 3, 3).per_seed),
    "reach_curve": on_graph(lambda g: paths.reachability(g, 3, 3).curve),
    "path_pairs": on_graph(lambda g: paths.path_pairs(g, 5)),
    "path_length_dist": on_graph(lambda g: paths.path_length_distribution(g, 5).distribution),
    "path_length_summary": on_graph(lambda g: paths.path_length_distribution(g, 5).summary),
    # centrality
    "triangle_count": on_three_way(centrality.triangle_count),
    "local_clustering": on_three_way(centrality.local_clustering),
    "lcc_summary": on_three_way(lambda g: centrality.local_clustering_coefficient(g).summary),
    "lcc_top": on_three_way(lambda g: centrality.local_clustering_coefficient(g).top),
    "lcc_bipartite": on_graph(lambda g: centrality.local_clustering_coefficient(g).summary),
    "kcore_members": on_graph(lambda g: centrality.k_cores(g, 20).members.select("id")),
    "kcore_profile": on_graph(
        lambda g: centrality.k_cores(g, 25).profile.select("k", "core_vertices", "core_edges")
    ),
    "pagerank": on_graph(lambda g: rounded(centrality.page_rank(g, 10))),
    "pagerank_three_way": on_three_way(lambda g: rounded(centrality.page_rank(g, 10))),
    "pagerank_by_label": on_graph(lambda g: centrality.page_rank_aggregation(g, 10).by_label),
    "pagerank_top": on_graph(lambda g: top_rounded(centrality.page_rank(g, 10))),
    # batches and measurements
    "slice_sizes": on_graph(lambda g: batch.slice_sizes(g, THRESHOLDS)),
    "rating_by_slice": on_graph(
        lambda g: batch.by_slice(_slices(g), partial(neighborhood.rating_summary, min_reviews=8))
    ),
    "pagerank_by_slice": on_graph(
        lambda g: batch.by_slice(_slices(g), lambda s: centrality.page_rank_aggregation(s, 5).by_label)
    ),
    "measurements_csv": measurements_csv,
    "measure_rollup": mean_times,
    "measure_summary": time_summary,
    "measure_series": time_series,
}
