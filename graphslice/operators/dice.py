"""Dices: each takes a slice and returns the smaller slice it cuts out.

They chain in the order they are called. All but the popularity dice are
lazy. The vertices of the result are exactly the ends of the kept edges.
Bounds are inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphslice.functions.measures import OTHER_YEAR, utc_year
from graphslice.model import EDGE_SCHEMA, GraphSlice, PropertyGraph, as_slice, endpoints
from graphslice.plans import skew
from graphslice.plans.workspace import Workspace


def induced_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The vertices that are an end of one of ``edges``."""
    return vertices.join(endpoints(edges), "id", "left_semi")


def _cut(source: GraphSlice, edges: DataFrame, predicate: str) -> GraphSlice:
    # Derived vertices are derived again from the kept edges, without a look
    # at the base graph; vertices with columns of their own are looked up.
    if source.graph.derived:
        graph = PropertyGraph.from_edges(edges)
    else:
        graph = PropertyGraph(induced_vertices(source.vertices, edges), edges)
    return GraphSlice(graph, (*source.predicates, predicate))


def dice_all(source: GraphSlice | PropertyGraph) -> GraphSlice:
    """The whole graph."""
    return as_slice(source)


def dice_score(source: GraphSlice | PropertyGraph, low: float, high: float) -> GraphSlice:
    source = as_slice(source)
    kept = source.edges.filter(F.col("score").between(low, high))
    return _cut(source, kept, f"score=[{low:.1f},{high:.1f}]")


def dice_time(source: GraphSlice | PropertyGraph, start: int, end: int) -> GraphSlice:
    """Reviews from ``start`` to ``end``, in epoch seconds.

    On a graph stored by year the bounds also select the year folders.
    """
    source = as_slice(source)
    within = F.col("timestamp").between(start, end)
    if "year" in source.edges.columns:
        low, high = (utc_year(F.lit(t).cast("bigint")) for t in (start, end))
        # A bound without a year does not select; reviews without one are always looked at.
        after = (low == OTHER_YEAR) | (F.col("year") >= low)
        before = (high == OTHER_YEAR) | (F.col("year") <= high)
        within &= (F.col("year") == OTHER_YEAR) | (after & before)
    return _cut(source, source.edges.filter(within), f"time=[{start},{end}]")


def dice_helpfulness(source: GraphSlice | PropertyGraph, low: float) -> GraphSlice:
    source = as_slice(source)
    return _cut(source, source.edges.filter(F.col("helpfulness") >= low), f"helpfulness>={low:.2f}")


def product_reviews(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def dice_popularity(source: GraphSlice | PropertyGraph, min_reviews: int) -> GraphSlice:
    """Reviews of the products that have at least ``min_reviews`` in this slice.

    The products are counted and written at once, so that every use of the
    slice reads a short table instead of counting again. A list that is proven
    short is sent to the reviews; a longer one meets them by product, where a
    hot product's reviews are spread.
    """
    source = as_slice(source)
    spark = source.edges.sparkSession
    workspace = Workspace(spark, "popular")
    popular = product_reviews(source.edges).filter(F.col("n") >= min_reviews)
    seen = workspace.write(popular, "products", F.sum("n").alias("reviews"))
    found = workspace.read("products", schema=popular.schema)
    if seen["rows"] <= skew.BROADCAST_ROWS:
        kept = source.edges.join(F.broadcast(found.select("dst")), "dst", "left_semi")
    else:
        limit = skew.hot_rows(spark, seen["reviews"])
        keep = found.select("dst", skew.salts(skew.fan_of(F.col("n"), limit)).alias("salt"))
        reviews = skew.spread(source.edges, "dst", F.col("src"), skew.hot_keys(found, "dst", "n", limit))
        kept = reviews.join(keep, ["dst", "salt"], "left_semi")
    return _cut(source, kept.select(source.edges.columns), f"productReviews>={min_reviews}")


def dice_sample(source: GraphSlice | PropertyGraph, fraction: float, seed: int) -> GraphSlice:
    """A random sample of the reviews, without replacement, that any rerun and any layout repeats.

    A review is kept when the first 32 bits of an MD5 fall below the fraction.
    It covers the seed, all columns and, as equal reviews are drawn one by
    one, a number among those; they are counted, not gathered.
    """
    source = as_slice(source)
    columns = source.edges.columns
    counted = source.edges.groupBy(*columns).agg(F.count(F.lit(1)).alias("repeats"))
    each = counted.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "repeats")).alias("number"))
    texts = (F.col(name).cast("string") for name in (*EDGE_SCHEMA.names, "number"))
    key: Column = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary"))
    draw = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return _cut(source, each.filter(draw < int(fraction * 2**32)).select(columns), f"sample={fraction:.4f}")
