"""Tables in the shared folder that cut the lineage of iterative queries.

Every round of a loop is written to the folder named by
``spark.checkpoint.dir`` and read back, so the next round's plan starts at a
file scan, a lost executor costs a re-read instead of a replay of all rounds,
and the size Spark plans the next join with is the size of the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set as checkpoint folder.

    It must be one that the driver and all executors share, so none is made
    here: a library cannot know which folders a cluster shares.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each job of a ``with`` block when the job ends; nothing else reads them."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


class Workspace:
    """A sub-folder of the shared folder, one per query run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, *metrics: Column) -> dict[str, int]:
        """Write ``df`` and return its row count with any further ``metrics``.

        The metrics ride along with the write job; nothing is scanned twice.
        What the job shuffled is deleted with its end and not when the driver
        next collects garbage, so the disk holds one job's shuffles at a time.
        """
        seen = Observation()
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics)
        with _shuffles_freed(self.spark):
            observed.write.mode("overwrite").parquet(self.path(name))
        return {key: value or 0 for key, value in seen.get.items()}

    def read(self, *names: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*(self.path(name) for name in names))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with its lineage cut."""
        self.write(df, name)
        return self.read(name, schema=df.schema)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        _delete(self.spark, [self.path(name) for name in names])


def _delete(spark: SparkSession, folders: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(conf).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all tables this process wrote; results that read them end with it."""
    _delete(spark, _roots)
    _roots.clear()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written in a ``with`` block at its end; results that read them must be stored before."""
    before = list(_roots)
    try:
        yield
    finally:
        own = [root for root in _roots if root not in before]
        _delete(spark, own)
        _roots[:] = [root for root in _roots if root not in own]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few known rows as a plan constant, with no Python worker behind it."""
    types = T.StructType.fromDDL(schema)
    structs = [
        F.struct(*(F.lit(value).cast(f.dataType).alias(f.name) for value, f in zip(row, types, strict=True)))
        for row in rows
    ]
    if not structs:
        return spark.createDataFrame([], types)
    return spark.range(1).select(F.inline(F.array(*structs)))
