"""The training-text pipeline: stages that are each written and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from graphslice.llm import stages
from graphslice.plans.workspace import Workspace

STAGES = [
    ("quality rules", stages.quality_rules),
    ("near duplicates", stages.near_duplicates),
    ("secret scan", stages.secret_scan),
    ("mixing sources", stages.mixing),
    ("packing", stages.packing),
]
#: The verdicts use hashes and ids that SQL does not have; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of ``documents``; each stage's result is a table that the next one reads.

    Null columns, empty and long texts, ties, repeated rows and further
    columns are handled as the stages say; an empty table gives no pieces.
    """
    folder = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = lambda docs, stage: folder.save(stage[1](spark, docs, sf_dir), stage[0].replace(" ", "-"))
    return reduce(step, STAGES, docs)
