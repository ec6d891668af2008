"""Nearest neighbours by collision counting.

Each of a few dozen random lines orders the vectors of a shard by their
projection: one sorted array for each line. A query stands at its own
projection in each array and opens a window around it, as wide as its search
radius asks. Vectors that lie in enough of the windows are verified with the
exact measure. While the nearest verified are further than the radius, the
radius grows and the same arrays serve with wider windows (virtual rehashing).
A search starts at a radius that most sampled vectors of the shard would need,
and where windows hold more than half of the arrays, what lies outside of them
is counted instead.

Largest inner products become least distances by one more component, which
makes all vectors as long as the longest; a query has 0 there.

How many windows are enough follows from the number of lines: a vector within
the radius is in fewer with a probability below ``MISS``, whatever the data.
The search ends when the last of the nearest found lies within the radius, so
each true neighbour is missed with that probability at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphslice.plans.shipping import ship_package
from graphslice.plans.workspace import Workspace

SHARD, BLOCK = 8192, 2048  # vectors of a shard, queries that one task puts to it; about
LINES, WIDTH, MISS = 64, 3.5, 0.04
SAMPLE, START_RANK, START_SHARE = 32, 20, 0.75  # vectors whose distance to their 20th neighbour gives the first radius
GROWTH, DIAMETER = 1.3, 2.0  # all vectors have a length of 1
CLOSE = 1e-9  # of the lengths; scores that close are computed anew, in one way, before they are ranked
_SEED = 20240229
_LAST = np.iinfo(np.int64).max


def enough(lines: int, width: float, miss: float) -> int:
    """The most windows that a vector at the radius is in, but for a probability of ``miss``."""
    hit = math.erf(width / 2 / math.sqrt(2))
    below = 0.0
    for n in range(lines + 1):
        below += math.comb(lines, n) * hit**n * (1 - hit) ** (lines - n)
        if below > miss:
            return n
    return lines


def _lines(dimensions: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((LINES, dimensions + 1))


def _matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """Rows of numbers; shorter ones end in zeros."""
    found = column.combine_chunks()
    sizes = np.diff(found.offsets.to_numpy())
    flat = found.values.to_numpy(zero_copy_only=False)
    flat = flat[int(found.offsets[0].as_py()) : int(found.offsets[-1].as_py())] if len(found) else flat
    matrix = np.zeros((len(found), dimensions), flat.dtype)
    matrix[np.arange(dimensions) < sizes[:, None]] = flat
    return matrix


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers, null as the largest there is."""
    return column.combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)


class _Shard:
    """Vectors, and for each line their projections in order."""

    def __init__(self, row: dict, dimensions: int, longest: float):
        self.longest = longest
        self.rows, self.ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, dimensions).astype(np.float64)
        self.radius, size = row["radius"], len(self.rows)
        keys = np.frombuffer(row["keys"], np.float32).reshape(LINES, -1)
        self.order = np.frombuffer(row["places"], np.int32).astype(np.int64)
        # One array for all lines: a line's keys lie beside those of the next.
        self.apart = 4 * float(np.abs(keys).max(initial=0)) + 1
        self.flat = (keys + self.apart * np.arange(LINES)[:, None]).ravel()
        self.low, self.high = size * np.arange(LINES), size * np.arange(1, LINES + 1)

    def windows(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        reach = min(half, self.apart / 2)
        at = np.clip(centres, -self.apart / 4, self.apart / 4) + self.apart * np.arange(LINES)
        low = np.searchsorted(self.flat, at - reach, "left")
        high = np.searchsorted(self.flat, at + reach, "right")
        return np.clip(low, self.low, self.high), np.clip(high, self.low, self.high)

    def collisions(self, centres: np.ndarray, radius: float) -> np.ndarray:
        """In how many windows each vector lies."""
        size, (low, high) = len(self.rows), self.windows(centres, radius * WIDTH / 2)
        inside = 2 * int((high - low).sum()) <= len(self.order)
        ends = [(low, high)] if inside else [(self.low, low), (high, self.high)]
        parts = [self.order[a:b] for begin, end in ends for a, b in zip(begin.tolist(), end.tolist(), strict=True) if a < b]
        counts = np.bincount(np.concatenate(parts), minlength=size) if parts else np.zeros(size, np.int64)
        return counts if inside else LINES - counts

    def nearest(self, query: np.ndarray, centres: np.ndarray, own: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` nearest found, but for the row ``own``."""
        unseen = self.rows != own
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        reach, radius = math.sqrt(float(query @ query)) * self.longest, self.radius
        while True:
            new = np.flatnonzero(unseen if radius >= DIAMETER else unseen & (self.collisions(centres, radius) >= least))
            unseen[new] = False
            places, scores = np.append(places, new), np.append(scores, self.vectors[new] @ query)
            if len(scores) > k:
                last = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= last - CLOSE * reach
                places, scores = places[near], scores[near]
            if radius >= DIAMETER:
                break
            last = math.sqrt(max(0.0, 2 - 2 * float(scores.min()) / reach)) if len(scores) >= k else radius * GROWTH
            if last <= radius:
                break
            radius = last
        # Equal vectors must have equal scores, wherever they stand.
        scores = (self.vectors[places] * query).sum(axis=1)
        best = np.lexsort((self.rows[places], self.ids[places], -scores))[:k]
        return places[best], scores[best]


def _first_radius(unit: np.ndarray) -> float:
    """A distance within which most of some vectors, evenly taken, have their 20th neighbour in the shard."""
    some = unit[:: max(1, len(unit) // SAMPLE)][:SAMPLE]
    square = np.sort(np.maximum(0.0, 2 - 2 * some @ unit.T), axis=1)
    return float(np.sqrt(np.quantile(square[:, min(START_RANK, len(unit) - 1)], START_SHARE)))


def _index_of(dimensions: int, longest: float):
    """The vectors of a shard as one row with its sorted arrays."""

    def build(table: pa.Table) -> pa.Table:
        vectors = _matrix(table.column("embedding"), dimensions)
        unit = vectors.astype(np.float64) / longest
        rest = np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))
        unit = np.column_stack([unit, rest])
        keys = (unit @ _lines(dimensions).T).T.astype(np.float32)
        places = np.argsort(keys, axis=1, kind="stable")
        parts = {
            "shard": table.column("shard")[0].as_py(),
            "rows": _numbers(table.column("row")).tobytes(),
            "ids": _numbers(table.column("vec_id")).tobytes(),
            "vectors": vectors.tobytes(),
            "kind": vectors.dtype.str,
            "radius": max(_first_radius(unit), 1e-6),
            "keys": np.take_along_axis(keys, places, axis=1).tobytes(),
            "places": places.astype(np.int32).tobytes(),
        }
        return pa.table({name: [value] for name, value in parts.items()}, schema=_INDEX_ARROW)

    return build


_INDEX = "shard long, rows binary, ids binary, vectors binary, kind string, radius double, keys binary, places binary"
_INDEX_ARROW = pa.schema([
    ("shard", pa.int64()), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()),
    ("kind", pa.string()), ("radius", pa.float64()), ("keys", pa.binary()), ("places", pa.binary()),
])
_FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def _search_of(dimensions: int, longest: float, k: int):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        if index.num_rows and queries.num_rows:
            shard, least = _Shard(index.to_pylist()[0], dimensions, longest), enough(LINES, WIDTH, MISS)
            vectors = _matrix(queries.column("embedding"), dimensions).astype(np.float64)
            unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
            centres = unit @ _lines(dimensions)[:, :-1].T
            rows, ids = queries.column("row").to_pylist(), queries.column("vec_id").to_pylist()
            for vector, centre, row, query_id in zip(vectors, centres, rows, ids, strict=True):
                places, scores = shard.nearest(vector, centre, -1 if row is None else row, k, least)
                found = [None if i == _LAST else i for i in shard.ids[places].tolist()]
                parts = [[row] * len(places), [query_id] * len(places), shard.rows[places].tolist(), found, scores.tolist()]
                for column, part in zip(columns, parts, strict=True):
                    column.extend(part)
        kinds = [pa.int64()] * 4 + [pa.float64()]
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return search


def usable(vector: Column) -> Column:
    """Whether a vector has numbers only, and one that is not 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projections of ``vectors`` (``vec_id, embedding``) in shards, as a table.

    Vectors that are null, empty or zero, or hold null, NaN or an infinity,
    take no part. Shorter vectors count as ending in zeros. Rows with a null
    id, equal ids or equal vectors are rows like others; further columns are
    ignored; an empty table has no shards. The index has about two and a half
    times the bytes of vectors of 64 floats.
    """

    def __init__(self, vectors: DataFrame):
        ship_package(vectors.sparkSession)
        self.folder = Workspace(vectors.sparkSession, "nearest")
        good = vectors.where(usable(F.col("embedding"))).select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding"
        )
        square = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
        seen = self.folder.write(
            good, "vectors", F.max(F.size("embedding")).alias("dimensions"), F.max(square).alias("square")
        )
        self.rows = self.folder.read("vectors", schema=good.schema)
        self.dimensions = seen["dimensions"]
        self.longest = math.sqrt(seen["square"]) * (1 + 1e-12) or 1.0
        self.shard_count = max(1, math.ceil(seen["rows"] / SHARD))
        shard = F.pmod(F.xxhash64("row"), F.lit(self.shard_count)).alias("shard")
        build = _index_of(self.dimensions, self.longest)
        shards = self.rows.select(shard, "row", "vec_id", "embedding").groupBy("shard").applyInArrow(build, _INDEX)
        self.shards = self.folder.save(shards, "shards")

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """``query_row, query_id, rank, vec_id, score`` of the ``k`` nearest found for each row of ``queries``.

        ``queries`` has ``row, vec_id, embedding``. Rows of :attr:`rows` are
        not among their own neighbours; for others ``row`` is a number below 0
        that is theirs alone. Fewer than ``k`` vectors are all found. Ties go
        to the smaller id, a null id last. Every block of queries meets every
        shard; a task holds one of each.
        """
        asked = self.folder.save(queries.where(usable(F.col("embedding"))).select("row", "vec_id", "embedding"), "queries")
        blocks = max(1, math.ceil(asked.count() / BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
        left = self.shards.select("*", every(blocks).alias("block")).groupBy("shard", "block")
        right = asked.select("*", block, every(self.shard_count).alias("shard")).groupBy("shard", "block")
        found = left.cogroup(right).applyInArrow(_search_of(self.dimensions, self.longest, k), _FOUND)
        best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("query_row", "query_id", "rank", "vec_id", "score")
