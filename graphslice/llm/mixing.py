"""Mix sources to target weights by Sainte-Laguë apportionment.

The words of a source, in a seeded order, are a line cut into blocks of equal
size. Blocks are seats: first the sources, then the shards of each source are
given seats by highest quotients (1, 3, 5, ...), and each shard takes its
seats' worth of blocks by a seeded choice. A quota above the number of blocks
takes every block that many times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphslice.llm.text import word_count
from graphslice.plans.workspace import Workspace

WEIGHTS = (5, 2, 1)  # for the sources by code point, repeating
MOST_REPEATS = 3  # no source or document is taken more often
BLOCK_WORDS = 16
SHARD_ROWS = 4096  # mean rows of a shard; a source has as many shards as it needs


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, rows`` with ``sid``, ``weight`` and ``target``.

    Targets share the total of all sizes by weight; one that would exceed
    ``repeats`` times its source stops there, and the others share the excess.
    With sources ordered by ceiling per unit of weight, those that stop are a
    prefix, so one ordered pass finds the common level. A table has one row
    per source, so the unpartitioned windows are small. No sources give none.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "sid")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    spent = F.coalesce(F.sum("ceiling").over(before), F.lit(0))
    level = (F.sum("source_size").over(everyone) - spent) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    free = F.col("ceiling") / F.col("weight") >= F.col("level")
    common = F.max(F.when(free, F.col("level"))).over(everyone)
    target = F.when(free, F.col("weight") * common).otherwise(F.col("ceiling"))
    return levels.select("source", "sid", "source_size", "rows", "weight", target.cast("double").alias("target"))


def highest_quotients(parties: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the ``seats`` of each group by highest ``weight / (k - 1/2)``.

    A divisor somewhat above and one somewhat below the true one bound every
    quota, to two or three seats in the mean, so only the quotients between
    them are ranked. Ties go to the smaller ``key``. No weight at all: no seats.
    """
    of = Window.partitionBy(*group)
    half, total = F.count(F.lit(1)).over(of) / 2, F.sum(weight).over(of)
    share = lambda m: F.floor(F.coalesce(F.try_divide(F.col(weight) * m, total), F.lit(0.0)) + 0.5)
    bounded = parties.withColumn("least", F.greatest(F.lit(0).cast("long"), share(F.col(seats) - half) - 1))
    bounded = bounded.withColumn("most", share(F.col(seats) + half) + 1)
    bounded = bounded.withColumn("open", F.col(seats) - F.sum("least").over(of))
    quotients = bounded.select(
        *group, key, "open", weight, F.explode(F.sequence(F.col("least") + 1, F.col("most"))).alias("nth")
    ).withColumn("quotient", F.col(weight) / (F.col("nth") - 0.5))
    place = F.row_number().over(of.orderBy(F.col("quotient").desc(), key, "nth"))
    won = (
        quotients.withColumn("place", place)
        .where((F.col("place") <= F.col("open")) & (F.col(weight) > 0))
        .groupBy(*group, key)
        .agg(F.count(F.lit(1)).alias("won"))
    )
    keys = list(dict.fromkeys([*group, key]))
    quota = F.col("least") + F.coalesce("won", F.lit(0))
    return bounded.join(won, keys, "left").select(*parties.columns, quota.cast("long").alias("quota"))


def row_mark(seed: int) -> Column:
    """The seeded place of a row in the order of its source."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 7,
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    repeats: int = MOST_REPEATS,
) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text, source``) with what the mix takes of it.

    Returns ``doc_id, source, text_md5, size, source_size, target, taken``, all
    null-safe: a null source is a source of its own (the last), a null or empty
    text has size 0 and is taken 0 times, equal rows are separate rows whose
    takes may differ, an empty table gives no rows, and further columns are
    ignored. The order of a shard is the md5 of seed, id and text, so a rerun
    agrees whatever the partitioning.
    """
    spark = docs.sparkSession
    folder = Workspace(spark, "mix")
    size = word_count(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"), row_mark(seed).alias("text_md5"))
    rows = folder.save(rows, "rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = folder.save(source_targets(sources, weights, repeats), "sources")

    blocks = sources.withColumn("all", F.lit(0)).withColumn(
        "seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    )
    quotas = highest_quotients(blocks, ["all"], "sid", "target", "seats").select(
        F.col("sid"), F.col("quota").alias("seats")
    )
    shards = F.ceil(F.col("rows") / shard_rows)
    number = F.conv(F.substring("text_md5", 1, 8), 16, 10).cast("long")
    placed = (
        rows.withColumnRenamed("source", "name")
        .join(sources, F.col("name").eqNullSafe(F.col("source")))
        .select("doc_id", "source", "text_md5", "size", "source_size", "target", "sid", (number % shards).alias("shard"))
    )
    shard_sizes = placed.groupBy("sid", "shard").agg(F.sum("size").alias("words"))
    shares = highest_quotients(shard_sizes.join(quotas, "sid"), ["sid"], "shard", "words", "seats")
    n_blocks = F.greatest(F.ceil(F.col("words") / block_words), F.lit(1).cast("long"))
    shares = shares.select(
        "sid", "shard", n_blocks.alias("blocks"), F.least("quota", n_blocks * repeats).alias("quota")
    )
    line = Window.partitionBy("sid", "shard").orderBy("text_md5", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("end", F.sum("size").over(line)).join(shares, ["sid", "shard"])
    shift = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "sid", "shard")), 1, 8), 16, 10).cast("long")
    laid = laid.withColumn("shift", shift % F.col("blocks"))
    start, end = F.col("end") - F.col("size"), F.col("end")
    again = F.floor(F.col("quota") / F.col("blocks"))
    taken = again * F.col("size") + _chosen(end, block_words) - _chosen(start, block_words)
    return laid.select(
        "doc_id", "source", "text_md5", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def _chosen(place: Column, block_words: int) -> Column:
    """Words before ``place`` in the blocks that are taken once more than the others.

    Of n blocks the r from a seeded start on are chosen, round the end. The
    order of the line is seeded too, so a run of it is a random choice of
    documents, and only the two at the ends of the run are cut.
    """
    first = F.col("shift") * block_words
    last = first + (F.col("quota") % F.col("blocks")) * block_words
    beyond = last - F.col("blocks") * block_words
    none = F.lit(0).cast("long")
    return F.greatest(none, F.least(place, last) - first) + F.greatest(none, F.least(place, beyond))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as its taken words fill it, rounded to the nearest copy.

    Returns the columns of ``docs``; a document taken for less than half its
    words goes, as does an empty one. Rows equal in id and text share one count.
    """
    takes = mix(docs, **settings).where("size > 0").groupBy("text_md5")
    copies = takes.agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("copies")).where("copies > 0")
    mark = row_mark(settings.get("seed", 7))
    whole = docs.select(F.struct(*docs.columns).alias("row"), mark.alias("text_md5"))
    repeated = whole.join(copies, "text_md5").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return repeated.select("row.*")
