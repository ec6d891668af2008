"""Joins and layouts that hold when one key has a third of all rows.

A key is *hot* when it has more rows than ``hot_rows``. There can be no more
than ``total rows / hot_rows`` such keys (25,000 for 10^11 rows, and where the
total is known never over 100,000), so the table of hot keys is small for any
input and can be broadcast. Rows of a hot key are spread over ``fan``
salts by a hash of another column; the other side of the join is repeated once
per salt. Nothing is dropped or sampled: every row meets exactly one copy.
"""

from __future__ import annotations

from math import ceil

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphslice.plans.workspace import Workspace

# Four million rows of two ids are about one 64 MB shuffle partition.
DEFAULT_HOT_ROWS = 4_000_000

# A task for fewer rows than this costs more to start than to run. Spark moves
# a layout of fewer partitions than the session's again for each join, so this
# is kept low: it spares small tables hundreds of near-empty tasks per round.
SMALL_ROWS = 10_000

# Neighbour lists come in pieces of about this many vertices.
PIECE = 1024

# No table of hot keys, hubs or landmarks longer than this is broadcast.
BROADCAST_ROWS = 100_000


def hot_rows(spark: SparkSession, total: int = 0) -> int:
    """Rows one key may have in a task; rises with ``total`` so that no more
    than ``BROADCAST_ROWS`` keys can have more."""
    limit = int(spark.conf.get("spark.graphslice.hotRows", str(DEFAULT_HOT_ROWS)))
    return max(limit, total // BROADCAST_ROWS)


def partitions_for(spark: SparkSession, rows: float) -> int:
    """A number of partitions for ``rows`` rows.

    The session's number where that gives each a fair share of work, fewer for
    small tables, and more where a partition would otherwise grow too large.
    """
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    useful = ceil(rows / SMALL_ROWS)
    return max(1, min(session, useful), ceil(rows / DEFAULT_HOT_ROWS))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df``, which has at most ``rows`` rows, if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fan_of(n: Column, limit: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(limit)), F.lit(1)).cast("int")


def hot_keys(counts: DataFrame, key: str, n: str, limit: int) -> DataFrame:
    """The (hot_key, fan) rows of ``counts`` that have more than ``limit`` rows."""
    return counts.filter(F.col(n) > limit).select(F.col(key).alias("hot_key"), fan_of(F.col(n), limit).alias("fan"))


def find_hot(rows: DataFrame, key: str, total: int, workspace: Workspace) -> DataFrame | None:
    """The hot keys of ``rows``, which has ``total`` rows; None when there are none."""
    limit = hot_rows(rows.sparkSession, total)
    if total <= limit:
        return None
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = workspace.write(hot_keys(counts, key, "n", limit), "hot")["rows"]
    return workspace.read("hot") if found else None


def _with_fan(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    # Small by construction: see the bound in the module text.
    small = F.broadcast(hot.withColumnRenamed("hot_key", key))
    return df.join(small, key, "left").withColumn("fan", F.coalesce("fan", F.lit(1)))


def salt(by: Column, fan: Column) -> Column:
    return F.pmod(F.xxhash64(by), fan).cast("int")


def salts(fan: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), fan - 1))


def spread(df: DataFrame, key: str, by: Column, hot: DataFrame | None) -> DataFrame:
    """Add ``salt`` to the side with many rows per key."""
    if hot is None:
        return df
    return _with_fan(df, key, hot).withColumn("salt", salt(by, F.col("fan"))).drop("fan")


def replicate(df: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Repeat the rows of the side with few rows per key, once per salt."""
    if hot is None:
        return df
    return _with_fan(df, key, hot).withColumn("salt", salts(F.col("fan"))).drop("fan")


def salted_join(
    many: DataFrame, few: DataFrame, key: str, by: Column, hot: DataFrame | None, *also: str
) -> DataFrame:
    """Inner join on ``key`` and ``also``, with the rows of hot keys spread out."""
    if hot is None:
        return many.join(few, [key, *also])
    return spread(many, key, by, hot).join(replicate(few, key, hot), [key, *also, "salt"]).drop("salt")


class Adjacency:
    """Neighbour rows laid out once for many joins on ``src``.

    The rows are hash-partitioned and sorted by ``src`` and persisted, so a
    join from a frontier or from vertex state moves only the other side. Hot
    sources take several partitions. A lost partition is rebuilt from the
    table the rows were read from.
    """

    def __init__(self, rows: DataFrame, total: int, hot: DataFrame | None):
        self.hot = hot
        self.keys = ["src"] if hot is None else ["src", "salt"]
        n = partitions_for(rows.sparkSession, total)
        self.rows = (
            self._gathered(spread(rows, "src", self._apart(), hot).repartition(n, *self.keys))
            .sortWithinPartitions(*self.keys)
            .persist(StorageLevel.MEMORY_AND_DISK)
        )

    def _apart(self) -> Column:
        """What the rows of a hot source are spread by."""
        return F.col("dst")

    def _gathered(self, rows: DataFrame) -> DataFrame:
        return rows

    def expand(self, df: DataFrame, key: str = "id") -> DataFrame:
        """Each row of ``df`` with every neighbour of its ``key`` as ``dst``."""
        left = replicate(df.withColumnRenamed(key, "src"), "src", self.hot)
        return left.join(self.rows, self.keys).withColumnRenamed("src", key)

    def release(self) -> None:
        self.rows.unpersist()

    def __enter__(self) -> Adjacency:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class Lists(Adjacency):
    """Neighbours (``src, dst, degree`` of ``src``) laid out as lists: a row for each ``PIECE`` of a vertex's neighbours or so.

    A join looks at one row a vertex instead of one a neighbour, and only the
    lists that it meets are taken apart.
    """

    def _apart(self) -> Column:
        return F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / F.lit(PIECE)))

    def _gathered(self, rows: DataFrame) -> DataFrame:
        # Rows of one list lie in one partition already.
        return rows.groupBy(*self.keys, self._apart().alias("piece")).agg(F.collect_list("dst").alias("dsts"))

    def expand(self, df: DataFrame, key: str = "id") -> DataFrame:
        met = super().expand(df, key)
        return met.select(*df.columns, F.explode("dsts").alias("dst"))
