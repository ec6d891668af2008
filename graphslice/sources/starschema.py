"""Graphs derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphslice.functions import measures
from graphslice.model import PropertyGraph


def order_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", *columns)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer-to-part edge per order line, with the five edge columns."""
    lines = order_lines(spark, sf_dir, "l_quantity", "l_discount", "l_shipdate")
    return lines.select(
        measures.user_id(F.col("o_custkey").cast("string")).alias("src"),
        measures.product_id(F.col("l_partkey").cast("string")).alias("dst"),
        (F.col("l_quantity").cast("int") % 5 + 1).cast("double").alias("score"),
        F.round(F.col("l_discount") * 10, 4).alias("helpfulness"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
    )


def purchase_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.from_edges(purchase_edges(spark, sf_dir))


def three_way_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers, parts and suppliers of each order line joined pairwise."""
    lines = order_lines(spark, sf_dir, "l_suppkey")
    user = measures.user_id(F.col("o_custkey").cast("string"))
    product = measures.product_id(F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("s_"), F.col("l_suppkey").cast("string"))
    sides = F.array(
        F.struct(user.alias("src"), product.alias("dst")),
        F.struct(product.alias("src"), supplier.alias("dst")),
        F.struct(user.alias("src"), supplier.alias("dst")),
    )
    edges = lines.select(F.explode(sides).alias("side")).select("side.src", "side.dst").distinct()
    return PropertyGraph.from_edges(edges)
