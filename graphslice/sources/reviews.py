"""Raw review text: blocks of ``key: value`` lines ended by a blank line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphslice.functions import measures
from graphslice.model import PropertyGraph
from graphslice.plans.shipping import ship_package
from graphslice.plans.workspace import Workspace

# The keys of the raw format that are used.
KEYS = {
    "product": "product/productId",
    "user": "review/userId",
    "name": "review/profileName",
    "helpfulness": "review/helpfulness",
    "score": "review/score",
    "time": "review/time",
}

_PIECES = ", ".join(["file string, start long, number long, whole boolean", *(f"`{name}` string" for name in KEYS)])


class _Assembly:
    """Fields of the records of one split, from its lines in order.

    Records are numbered by the blank lines before them in the split. One that
    begins and ends with a blank line there is whole; the first and the last
    may go on in a neighbouring split and are told apart.
    """

    def __init__(self, file: str, start: int):
        self.file, self.start, self.number = file, start, 0
        self.open: list[str | None] = [None] * len(KEYS)

    def take(self, blank: np.ndarray, key: np.ndarray, values: pa.Array) -> pa.RecordBatch:
        """The records that the blank lines among some more lines end."""
        number = np.cumsum(blank) - blank
        ended = int(blank.sum())
        last = np.full((len(KEYS), ended + 1), -1)
        lines = np.flatnonzero(~blank)
        last[key[lines], number[lines]] = lines  # of lines with one place the later stays
        columns = []
        for i, place in enumerate(last):
            found = values.take(pa.array(place, mask=place < 0))
            first = found[0].as_py() if found[0].is_valid else self.open[i]
            found = pa.concat_arrays([pa.array([first], pa.string()), found[1:]])
            self.open[i] = found[ended].as_py()
            columns.append(found[:ended])
        numbers = self.number + np.arange(ended)
        self.number += ended
        return self._rows(numbers, numbers > 0, columns)

    def rest(self) -> pa.RecordBatch:
        """What follows the last blank line, also when that is nothing: its number tells how many there were."""
        return self._rows(np.array([self.number]), np.array([False]), [pa.array([v], pa.string()) for v in self.open])

    def _rows(self, numbers: np.ndarray, whole: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
        same = [pa.array([self.file] * len(numbers), pa.string()), pa.array([self.start] * len(numbers), pa.int64())]
        arrays = [*same, pa.array(numbers, pa.int64()), pa.array(whole), *columns]
        return pa.RecordBatch.from_arrays(arrays, ["file", "start", "number", "whole", *KEYS])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (``file, start, split, key, value``; key -1 for a blank line) to pieces of records."""
    current, split = None, None
    for batch in batches:
        splits = batch.column("split").to_numpy()
        if not len(splits):
            continue
        cuts = np.flatnonzero(splits[1:] != splits[:-1]) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(splits)], strict=True):
            part = batch.slice(low, high - low)
            if splits[low] != split:
                if current is not None:
                    yield current.rest()
                split, current = splits[low], _Assembly(part.column("file")[0].as_py(), part.column("start")[0].as_py())
            key = part.column("key").to_numpy()
            yield current.take(key < 0, key, part.column("value"))
    if current is not None:
        yield current.rest()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: the six used fields as text, and its place ``ord``.

    Lines may end in any way, differently from file to file or line to line,
    and large plain files are split anywhere: no row is longer than a line. A
    gzip file is one task, so large input should come as many files. Records
    are put together where their lines are read; only those at the ends of a
    split are matched with the split before or after, by the number of blank
    lines up to them. ``ord`` rises in file order, file names first. Of
    repeated keys the last counts; a record with none of the six is no row.
    """
    ship_package(spark)
    workspace = Workspace(spark, "records")
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        text.alias("text"),
    )
    names = F.array(*(F.lit(key) for key in KEYS.values()))
    key = F.array_position(names, measures.strip(F.substring_index("text", ":", 1)))
    colon = F.contains("text", F.lit(":"))  # a line with one is not blank
    blank = measures.strip(F.col("text")) == ""
    place = F.when(colon, key).when(blank, -1).cast("int").alias("key")
    value = measures.strip(F.substr("text", F.instr("text", ":") + 1)).alias("value")
    # As the one element of an array a line is looked at once; a filter on ``key`` alone would do the work again.
    looked = lines.select("file", "start", F.xxhash64("file", "start").alias("split"), F.inline(F.array(F.struct(place, value))))
    number = F.greatest(F.col("key") - 1, F.lit(-1)).alias("key")
    read = looked.filter("key <> 0").select("file", "start", "split", number, "value")
    pieces = workspace.save(read.mapInArrow(_assembled, _PIECES), "pieces")

    place = F.struct("file", "start", "number").alias("ord")
    some = F.coalesce(*KEYS).isNotNull()
    whole = pieces.filter(F.col("whole") & some).select(place, *KEYS)
    # Two rows a split from here on.
    ends = pieces.filter(~F.col("whole"))
    blanks = ends.groupBy("file", "start").agg(F.max("number").alias("blanks"))
    before = F.sum("blanks").over(Window.partitionBy("file").orderBy("start")) - F.col("blanks")
    numbered = ends.join(blanks.select("file", "start", before.alias("before")), ["file", "start"]).withColumn(
        "record", F.col("before") + F.col("number")
    )
    latest = lambda name: F.max(F.when(F.col(name).isNotNull(), F.struct("start", "number", name)))[name]
    joined = numbered.groupBy("file", "record").agg(
        F.min(F.struct("file", "start", "number")).alias("ord"), *(latest(name).alias(name) for name in KEYS)
    )
    return whole.unionByName(joined.filter(some).select("ord", *KEYS))


def usable(records: DataFrame) -> DataFrame:
    """Records that name both a product and a user who is not anonymous."""
    return records.filter(
        (F.col("product") != "") & (F.col("user") != "") & (F.col("user") != measures.ANONYMOUS_USER)
    )


def review_edges(records: DataFrame) -> DataFrame:
    return usable(records).select(
        measures.user_id(F.col("user")).alias("src"),
        measures.product_id(F.col("product")).alias("dst"),
        measures.score(F.col("score")).alias("score"),
        F.coalesce(measures.helpfulness(F.col("helpfulness")), F.lit(0.0)).alias("helpfulness"),
        measures.epoch_seconds(F.col("time")).alias("timestamp"),
    )


def review_vertices(records: DataFrame) -> DataFrame:
    """(id, label, name): users with the first name seen, products with none."""
    kept = usable(records)
    users = kept.groupBy("user").agg(F.min_by(F.coalesce("name", F.lit("")), "ord").alias("name"))
    products = kept.select("product").distinct()
    return users.select(
        measures.user_id(F.col("user")).alias("id"), F.lit(measures.USER_LABEL).alias("label"), "name"
    ).unionByName(
        products.select(
            measures.product_id(F.col("product")).alias("id"),
            F.lit(measures.PRODUCT_LABEL).alias("label"),
            F.lit("").alias("name"),
        )
    )


def read_review_graph(spark: SparkSession, path: str) -> PropertyGraph:
    records = read_records(spark, path)
    return PropertyGraph(review_vertices(records), review_edges(records))
