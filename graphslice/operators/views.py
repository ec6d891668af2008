"""Undirected views of a slice, degrees and hubs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphslice.functions import measures
from graphslice.model import GraphSlice, PropertyGraph, as_slice
from graphslice.plans import skew
from graphslice.plans.workspace import Workspace

# Spark's rising ids have the partition above so many bits for the place in it.
_PLACE_BITS = 33
_PLACES = (1 << _PLACE_BITS) - 1


def undirected_pairs(edges: DataFrame, *measure: str) -> DataFrame:
    """Each unordered pair of joined vertices once, as (a, b) with a <= b.

    With ``measure`` columns, once per distinct combination of their values.
    This is the smallest form of the undirected graph: the exchange behind
    ``distinct`` sees each review once, after repeats have been combined.
    """
    return edges.select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), *measure
    ).distinct()


def both_ways(pairs: DataFrame, *measure: str) -> DataFrame:
    """(src, dst) in both directions from distinct pairs; a loop stays one row."""
    other = [f"`{name}`" for name in measure]
    rows = ", ".join(["a", "b", *other, "true", "b", "a", *other, "a <> b"])
    names = ", ".join(["src", "dst", *other, "kept"])
    return pairs.select(F.expr(f"stack(2, {rows}) AS ({names})")).filter("kept").drop("kept")


def undirected_edges(source: GraphSlice | PropertyGraph) -> DataFrame:
    return both_ways(undirected_pairs(as_slice(source).edges))


def undirected_scored(source: GraphSlice | PropertyGraph) -> DataFrame:
    return both_ways(undirected_pairs(as_slice(source).edges, "score"), "score")


def degree_of(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def degree(source: GraphSlice | PropertyGraph) -> DataFrame:
    """(id, degree): distinct neighbours; repeats of a review count once."""
    return degree_of(undirected_edges(source))


def top_n(degrees: DataFrame, n: int) -> DataFrame:
    return degrees.orderBy(F.desc("degree"), F.asc("id")).limit(n)


def top_hubs(source: GraphSlice | PropertyGraph, n: int) -> DataFrame:
    """The ``n`` vertices of highest degree; ties go to the smaller id."""
    return top_n(degree(source), n)


def of_label(id_col: Column, label: str) -> Column:
    return measures.vertex_label(id_col) == label


def top_hubs_by_label(source: GraphSlice | PropertyGraph, n: int) -> DataFrame:
    """(label, id, degree): the ``n`` top users and the ``n`` top products.

    Two top-k passes over the degrees instead of a window, which would sort
    each label, half of all vertices, in a single task.
    """
    degrees = degree(source)
    parts = [
        top_n(degrees.filter(of_label(F.col("id"), label)), n).select(F.lit(label).alias("label"), "id", "degree")
        for label in (measures.USER_LABEL, measures.PRODUCT_LABEL)
    ]
    return parts[0].unionByName(parts[1])


class _Pairs:
    """The pairs of a slice as a table, with what is derived from them once."""

    def __init__(self, edges: DataFrame, workspace: Workspace, measure: tuple[str, ...]):
        self.workspace, self.measure = workspace, measure
        pairs = undirected_pairs(edges, *measure)
        # In order, since equal ends in a row take little room in the table and when the pairs move again.
        self.count = workspace.write(pairs.sortWithinPartitions("a", "b"), "pairs")["rows"]
        self.rows = workspace.read("pairs", schema=pairs.schema)
        self.neighbours = both_ways(self.rows, *measure)

    @cached_property
    def degrees(self) -> DataFrame:
        return self.workspace.save(degree_of(self.neighbours), "degrees")

    @cached_property
    def hot(self) -> DataFrame | None:
        # A vertex has as many neighbour rows as its degree says, so they are not counted again.
        limit = skew.hot_rows(self.workspace.spark, 2 * self.count)
        if 2 * self.count <= limit:
            return None
        found = self.workspace.write(skew.hot_keys(self.degrees, "id", "degree", limit), "hot")["rows"]
        return self.workspace.read("hot") if found else None


class Undirected:
    """The undirected view of a slice, written once for queries that reuse it.

    The tables belong to the slice where a block has it open (see
    :meth:`GraphSlice.open`), and else to the query's ``workspace``.
    """

    def __init__(self, source: GraphSlice | PropertyGraph, workspace: Workspace, *measure: str):
        cut = as_slice(source)
        self.workspace = workspace
        shared = cut.shared(measure, lambda: _Pairs(cut.edges, Workspace(workspace.spark, "slice"), measure))
        self.owner = shared is None
        self._tables = shared or _Pairs(cut.edges, workspace, measure)
        self.pair_count, self.pairs, self.neighbours = self._tables.count, self._tables.rows, self._tables.neighbours

    def degree(self) -> DataFrame:
        return self._tables.degrees

    @property
    def hot(self) -> DataFrame | None:
        """Vertices with too many neighbour rows for one task, if there are any."""
        return self._tables.hot

    def adjacency(self) -> skew.Adjacency:
        return skew.Adjacency(self.neighbours, 2 * self.pair_count, self.hot)

    def drop(self) -> None:
        """Delete the tables, unless other queries may read them too."""
        if self.owner:
            self.workspace.drop("pairs", "degrees", "hot")


def number_vertices(degrees: DataFrame, workspace: Workspace, *order: str) -> DataFrame:
    """(id, degree, vid) with ``vid`` rising in the given order.

    The numbers have small gaps at the ends of partitions, which are of one
    size but for chance. They are written out at once, since numbering again
    could give others.
    """
    place = F.col("place").bitwiseAND(F.lit(_PLACES))
    placed = degrees.orderBy(*order).withColumn("place", F.monotonically_increasing_id())
    seen = workspace.write(placed, "numbers", F.max(place).alias("last"))
    width = (seen["last"] // 64 + 1) * 64  # a word of 64 numbers has vertices of one partition
    vid = F.shiftrightunsigned("place", _PLACE_BITS) * F.lit(width) + place
    return workspace.read("numbers", schema=placed.schema).select(*degrees.columns, vid.alias("vid"))


def numbered_pairs(view: Undirected, numbers: DataFrame) -> DataFrame:
    """The pairs of ``view`` as vertex numbers, with degrees: (a, b, a_degree, b_degree)."""
    end = lambda name: numbers.select(
        F.col("id").alias(name), F.col("vid").alias(f"{name}_vid"), F.col("degree").alias(f"{name}_degree")
    )
    half = skew.salted_join(view.pairs, end("a"), "a", F.col("b"), view.hot)
    both = skew.salted_join(half, end("b"), "b", F.col("a"), view.hot)
    return both.select(F.col("a_vid").alias("a"), F.col("b_vid").alias("b"), "a_degree", "b_degree")


def numbered_hot(numbers: DataFrame, hot: DataFrame | None) -> DataFrame | None:
    """Hot vertices by number instead of id."""
    if hot is None:
        return None
    return numbers.join(F.broadcast(hot), F.col("id") == F.col("hot_key")).select(F.col("vid").alias("hot_key"), "fan")
