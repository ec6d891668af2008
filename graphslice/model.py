"""The property graph and its slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphslice.functions import measures
from graphslice.plans.workspace import scope

T_ = TypeVar("T_")

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("helpfulness", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

VERTEX_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


def endpoints(edges: DataFrame) -> DataFrame:
    """Every vertex id that occurs at an end of an edge, once.

    One scan and one exchange; repeats collapse before the exchange.
    """
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def derive_vertices(edges: DataFrame) -> DataFrame:
    return endpoints(edges).withColumn("label", measures.vertex_label(F.col("id")))


@dataclass(frozen=True)
class PropertyGraph:
    """A directed multigraph: one row per vertex, one row per review.

    ``derived`` tells that the vertices hold nothing but what the edges say.
    """

    vertices: DataFrame
    edges: DataFrame
    derived: bool = False

    @classmethod
    def from_edges(cls, edges: DataFrame) -> PropertyGraph:
        return cls(derive_vertices(edges), edges, derived=True)

    def summary(self) -> DataFrame:
        """Vertices per label, all vertices, and edges, as (item, n)."""
        per_label = self.vertices.groupBy(F.col("label").alias("item")).agg(F.count(F.lit(1)).alias("n"))
        vertices = self.vertices.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertices").alias("item"), "n")
        edges = self.edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("item"), "n")
        return per_label.unionByName(vertices).unionByName(edges)


class _Owned:
    """Tables that the queries on an open slice share, and how many blocks have it open."""

    def __init__(self):
        self.blocks = 0
        self.tables: dict[tuple, object] = {}


@dataclass(frozen=True)
class GraphSlice:
    """A graph with the list of dices that cut it out of the base graph."""

    graph: PropertyGraph
    predicates: tuple[str, ...] = field(default=())
    _owned: _Owned = field(default_factory=lambda: _Owned(), init=False, compare=False, repr=False)

    @property
    def vertices(self) -> DataFrame:
        return self.graph.vertices

    @property
    def edges(self) -> DataFrame:
        return self.graph.edges

    @property
    def description(self) -> str:
        return " & ".join(self.predicates) if self.predicates else "all"

    def size(self) -> DataFrame:
        """One row (vertices, edges); the vertex count needs no label join."""
        edges = self.edges.agg(F.count(F.lit(1)).alias("edges"))
        vertices = self.vertices.agg(F.count(F.lit(1)).alias("vertices"))
        counts = vertices.select("vertices", F.lit(None).cast("bigint").alias("edges")).unionByName(
            edges.select(F.lit(None).cast("bigint").alias("vertices"), "edges")
        )
        return counts.agg(F.max("vertices").alias("vertices"), F.max("edges").alias("edges"))

    @contextmanager
    def open(self) -> Iterator[GraphSlice]:
        """Let the queries of a ``with`` block share this slice's undirected tables.

        The first that needs them writes them. The end of the outermost block
        deletes them together with all other tables written in it, so results
        must be stored or collected inside.
        """
        owned = self._owned
        owned.blocks += 1
        try:
            with scope(self.edges.sparkSession) if owned.blocks == 1 else nullcontext():
                yield self
        finally:
            owned.blocks -= 1
            if not owned.blocks:
                owned.tables.clear()

    def shared(self, key: tuple, make: Callable[[], T_]) -> T_ | None:
        """What ``make`` gave the first time it was asked for by ``key``; None where no block has the slice open."""
        if not self._owned.blocks:
            return None
        if key not in self._owned.tables:
            self._owned.tables[key] = make()
        return self._owned.tables[key]

    @contextmanager
    def cached(self) -> Iterator[GraphSlice]:
        """Keep this slice cached for the length of a ``with`` block.

        Tables that were cached before the block stay cached after it, so
        releasing the apex slice never drops the base graph.
        """
        unset = StorageLevel(False, False, False, False)
        own = [df for df in (self.edges, self.vertices) if df.storageLevel == unset]
        for df in own:
            df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield self
        finally:
            for df in own:
                df.unpersist()


def as_slice(source: GraphSlice | PropertyGraph) -> GraphSlice:
    return source if isinstance(source, GraphSlice) else GraphSlice(source)
