"""Edge, vertex and measurement tables as CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphslice.functions import measures
from graphslice.functions.measures import utc_year
from graphslice.model import EDGE_SCHEMA, PropertyGraph, endpoints
from graphslice.plans import skew
from graphslice.plans.batch import MEASUREMENT_SCHEMA
from graphslice.plans.workspace import Workspace

YEAR_FILES = 64  # parts that the edges of one year are spread over
SHORT_LIST = 100_000  # rows that one task may put in order
COPIES = 1_000_000  # copies of one row that one task makes

NAMED_VERTEX_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("id", "label", "name")]
)


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return spark.read.schema(as_text).option("header", True).option("escape", '"').csv(path)


def read_edges_csv(spark: SparkSession, path: str, on_bad: str = "null") -> DataFrame:
    """Review edges from CSV with a header.

    Columns are read as text and converted here, so one pass does, and a value
    that is no number becomes NULL or, with ``on_bad="zero"``, 0.
    """
    if on_bad not in ("null", "zero"):
        raise ValueError(f"on_bad is 'null' or 'zero', not {on_bad!r}")
    raw = _csv(spark, path, EDGE_SCHEMA)
    edges = raw.select(
        "src",
        "dst",
        measures.to_double(F.col("score")).alias("score"),
        measures.to_double(F.col("helpfulness")).alias("helpfulness"),
        measures.to_long(F.col("timestamp")).alias("timestamp"),
    )
    return edges if on_bad == "null" else zero_missing(edges)


def zero_missing(edges: DataFrame) -> DataFrame:
    return edges.fillna(0.0, ["score", "helpfulness"]).fillna(0, ["timestamp"])


def read_graph_csv(spark: SparkSession, path: str, on_bad: str = "null") -> PropertyGraph:
    return PropertyGraph.from_edges(read_edges_csv(spark, path, on_bad))


def read_vertices_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, NAMED_VERTEX_SCHEMA).fillna("", ["name"])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header each; Spark writes one per partition."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_graph(graph: PropertyGraph, path: str, by_year: bool = False) -> None:
    """Replace the graph stored at ``path``.

    Vertices are stored once each, edges as they are, repeats included. With
    ``by_year`` edges go to one folder per year of their timestamp, which a
    time dice then reads selectively. Years are those of UTC, and times without
    one go to a folder that every time dice reads. A year has at most
    ``YEAR_FILES`` parts, so one that holds most reviews is not one task's work.
    """
    graph.vertices.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path}/vertices")
    edges = graph.edges.select(*EDGE_SCHEMA.names)
    writer = edges.write
    if by_year:
        dated = edges.withColumn("year", utc_year(F.col("timestamp")))
        spread = F.pmod(F.xxhash64(*EDGE_SCHEMA.names), F.lit(YEAR_FILES))
        writer = dated.repartition("year", spread).write.partitionBy("year")
    writer.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, max_edges: int = 0, check_labels: bool = False) -> PropertyGraph:
    """The graph stored at ``path``; missing measures read as 0.

    ``max_edges`` keeps that many edges, the first in order of their columns.
    With ``check_labels`` only edges from a stored user to a stored product
    are read; graphs that this library stored have no others.
    """
    edges, vertices = zero_missing(spark.read.parquet(f"{path}/edges")), spark.read.parquet(f"{path}/vertices")
    if check_labels:
        for end, label in (("src", measures.USER_LABEL), ("dst", measures.PRODUCT_LABEL)):
            labelled = vertices.filter(F.col("label") == label).select(F.col("id").alias(end))
            edges = edges.join(labelled, end, "left_semi").select(edges.columns)
    if max_edges > 0:
        edges = cap_edges(edges, max_edges)
        kept = vertices.join(endpoints(edges), "id", "left_semi")
        return PropertyGraph(kept, edges)
    return PropertyGraph(vertices, edges)


def cap_edges(edges: DataFrame, n: int) -> DataFrame:
    """The first ``n`` edges in order of their columns; all of them for n <= 0.

    A short list is one small top-n. For more, equal edges are counted and the
    distinct ones dealt to tasks by ranges of the order; the rows of each range
    tell which one the cut falls in. Ranges before it are taken as they are,
    and only that one is put in order.
    """
    if n <= 0:
        return edges
    columns = EDGE_SCHEMA.names
    if n <= SHORT_LIST:
        return edges.orderBy(*columns).limit(n)
    spark = edges.sparkSession
    workspace = Workspace(spark, "cap")
    counted = edges.groupBy(*columns).agg(F.count(F.lit(1)).alias("repeats"))
    distinct = workspace.write(counted, "counted")["rows"]
    ranges = skew.partitions_for(spark, distinct)
    ranged = workspace.read("counted", schema=counted.schema).repartitionByRange(ranges, *columns)
    workspace.write(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    placed = workspace.read("ranged")
    left, cut = n, None
    for part, rows in placed.groupBy("part").agg(F.sum("repeats")).orderBy("part").collect():  # a row for each range
        if rows > left:
            cut = part
            break
        left -= rows
    if cut is None:
        return edges
    before = F.sum("repeats").over(Window.orderBy(*columns)) - F.col("repeats")  # within one range
    last = placed.filter(F.col("part") == cut).withColumn("kept", F.least("repeats", F.lit(left) - before))
    whole = placed.filter(F.col("part") < cut).withColumn("kept", F.col("repeats"))
    return repeated(whole.unionByName(last.filter("kept > 0")), "kept").select(columns)


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says; a great many copies of one are made by several tasks."""
    few = rows.filter(F.col(times) <= COPIES)
    lots = F.expr(f"(`{times}` - 1) div {COPIES}")
    many = rows.filter(F.col(times) > COPIES).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), lots)))
    share = F.least(F.lit(COPIES), F.col(times) - F.col("lot") * COPIES)
    spread = many.withColumn(times, share).repartition(F.col("lot")).drop("lot")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times).cast("bigint"))).alias("copy")
    return few.unionByName(spread).select("*", each).drop("copy")


def write_measurements(measured: DataFrame, path: str) -> None:
    write_csv(measured.orderBy("vertices_involved"), path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(MEASUREMENT_SCHEMA)
        .option("header", True)
        .option("escape", '"')
        .csv(path)
        .orderBy("vertices_involved")
    )
