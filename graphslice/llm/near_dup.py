"""Near duplicates by ProbMinHash, banding and verification.

Shingles of five words, weighted by how often they occur, arrive at the slots
of a signature as Poisson processes of their weights. A slot keeps its first
arrival, so two texts agree at a slot with their probability Jaccard
similarity. Arrivals are drawn up to a time by which all slots are filled
(early termination); what would come later cannot change the signature.

Copies that repeat a line a different number of times differ in their weights
but hardly in their sets. So a text that repeats shingles has a second
signature, in which each distinct shingle weighs the same; there two texts
agree at a slot with the Jaccard similarity of their sets. For other texts the
two signatures are equal.

Slots are hashed in bands. Texts that share a band are compared with one text
of the band, another in each round. What bands still hold apart after some
rounds goes through an exact join on the rarest shingles: two sets that are
alike enough share one among the first few of each, counted from the rarest
in a common order, and the bits of their shingles show no more differences
than such sets can have. A link is an exact Jaccard similarity of the shingle
sets of 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphslice.llm.text import let, words
from graphslice.plans import skew
from graphslice.plans.shipping import ship_package
from graphslice.plans.workspace import Workspace, union_all

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 6  # at similarity 0.8 a pair shares no band once in 440
HUB_ROUNDS = 3
BROADCAST_ROWS = 1 << 20
WORK = 1 << 26  # pairs of one shingle that a task looks at
PARITY_WORDS = 16  # 64 bits each; a bit is set if an odd number of a set's shingles fall on it
CHUNK, TEXT_COST = 1 << 17, 1 << 10  # words that a task hashes at once, and what a text adds for its arrivals

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SURE = 3.0  # all slots are filled by the first time limit but for exp(-3) of the texts


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of each run of five words; of the whole text if it is shorter."""
    hashes = hashes.astype(np.int64).view(np.uint64)
    if not len(hashes):
        return hashes
    width = min(SHINGLE, len(hashes))
    found = np.full(len(hashes) - width + 1, np.uint64(width))
    for i in range(width):
        found = mix(found + hashes[i : i + len(found)] * _GOLDEN)
    return found


def shingle_lists(hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """:func:`shingles` of each text; text i has the words ``hashes[ends[i]:ends[i + 1]]``."""
    across = shingles(hashes)  # with runs that leave a text, which are not taken
    return [
        across[start : end - SHINGLE + 1] if end - start >= SHINGLE else shingles(hashes[start:end])
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ]


def _uniform(elements: np.ndarray, draw: np.ndarray | int) -> np.ndarray:
    """Numbers above 0 and up to 1, each drawn by element and number of the draw."""
    bits = mix(elements + (np.asarray(draw, np.uint64) + np.uint64(1)) * _GOLDEN)
    return ((bits >> np.uint64(11)).astype(float) + 1) / float(1 << 53)


def signature(found: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """The element that arrives first at each slot."""
    return signatures([found], slots)[0]


def signatures(lists: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """A row of first arrivals for each text; none of the texts' lists is empty."""
    sets = [np.unique(found, return_counts=True) for found in lists]
    elements = np.concatenate([e for e, _ in sets])
    weights = np.concatenate([n / n.sum() for _, n in sets])
    texts = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    first = np.zeros(len(sets) * slots, np.uint64)
    limit = slots * (np.log(slots) + _SURE)
    while len(elements):
        times, of, places = _arrivals(elements, weights, limit, slots)
        spots = texts[of] * slots + places
        earliest = np.full(len(first), np.inf)
        np.minimum.at(earliest, spots, times)
        won = times == earliest[spots]
        first[spots[won]] = elements[of[won]]
        unfilled = np.isinf(earliest).reshape(-1, slots).any(axis=1)[texts]
        elements, weights, texts = elements[unfilled], weights[unfilled], texts[unfilled]
        limit *= 2
    return first.reshape(-1, slots)


def _arrivals(
    elements: np.ndarray, weights: np.ndarray, limit: float, slots: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time, place in ``elements`` and slot of every arrival up to ``limit``.

    Elements that expect about as many arrivals are drawn together. What is
    drawn for one depends on its hash and weight alone, not on its neighbours.
    """
    found, going = [], [(np.arange(len(elements)), np.zeros(len(elements)), np.zeros(len(elements), np.uint64))]
    while going:
        every, now, drawn = (np.concatenate(parts) for parts in zip(*going, strict=True))
        hoped = (limit - now) * weights[every]
        levels = np.minimum(np.ceil(np.log2(1.25 * hoped + 1)), 10).astype(np.int64)
        going = []
        for level in np.unique(levels).tolist():
            some = np.flatnonzero(levels == level)
            of = every[some]
            draws = drawn[some][:, None] + np.arange(1 << level, dtype=np.uint64)
            gaps = -np.log(_uniform(elements[of][:, None], 2 * draws)) / weights[of][:, None]
            times = now[some][:, None] + np.cumsum(gaps, axis=1)
            row, nth = np.nonzero(times <= limit)
            place = (_uniform(elements[of[row]], 2 * draws[row, nth] + np.uint64(1)) * slots).astype(np.int64) % slots
            found.append((times[row, nth], of[row], place))
            on = times[:, -1] <= limit
            if on.any():
                going.append((of[on], times[on, -1], draws[on, -1] + np.uint64(1)))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def band_keys(first: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` slots of each signature."""
    bands = first.reshape(len(first), -1, rows)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for i in range(rows):
        keys = mix(keys * _GOLDEN + bands[:, :, i])
    return keys.view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts with about CHUNK words together, where a text counts as TEXT_COST words more."""
    part = (ends[:-1] - ends[0] + TEXT_COST * np.arange(len(ends) - 1)) // CHUNK
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends) - 1], strict=True)


def _per_text(make, name: str):
    """All columns but the last, which has word hashes, with ``make`` of the texts' shingles in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.columns[-1]
            ends = lists.offsets.to_numpy().astype(np.int64)
            hashes = lists.values.to_numpy(zero_copy_only=False)
            for low, high in _chunks(ends):
                found = shingle_lists(hashes[ends[low] : ends[high]], ends[low : high + 1] - ends[low])
                kept = [column.slice(low, high - low) for column in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, _lists(make(found))], [*batch.schema.names[:-1], name])

    return run


def _keys_of(lists: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct band keys of each text: of its weighted signature, and of its set's where they differ."""
    full = [found for found in lists if len(found)]
    sets = [np.unique(found) for found in full]
    repeating = [len(s) < len(found) for found, s in zip(full, sets, strict=True)]
    both = full + [s for s, twice in zip(sets, repeating, strict=True) if twice]
    keys = band_keys(signatures(both)) if both else ()
    of_sets = iter(keys[len(full) :])
    weighted = zip(keys[: len(full)], repeating, strict=True)
    found_keys = iter([np.unique(np.append(k, next(of_sets))) if twice else k for k, twice in weighted])
    return [next(found_keys) if len(found) else np.zeros(0, np.int64) for found in lists]


def _sets_of(lists: list[np.ndarray]) -> list[np.ndarray]:
    return [np.unique(found).view(np.int64) for found in lists]


def with_parities(sets: DataFrame) -> DataFrame:
    """``sets`` with ``parities``: on each of 1,024 bits, whether an odd number of the shingles fall on it.

    A shingle that two sets share changes the same bit in both. So the bits
    that differ are no more than the shingles that only one of them has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            ends = lists.offsets.to_numpy().astype(np.int64)
            places = lists.values.to_numpy(zero_copy_only=False) & (64 * PARITY_WORDS - 1)
            found = []
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                odd = np.bincount(places[start:end], minlength=64 * PARITY_WORDS) & 1
                found.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(found)], [*batch.schema.names, "parities"])

    return sets.mapInArrow(run, T.StructType([*sets.schema.fields]).add("parities", T.ArrayType(T.LongType())))


def _bits_apart(a: Column, b: Column) -> Column:
    """How many bits of two parities differ."""
    each = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITY_WORDS)]
    return reduce(lambda x, y: x + y, each)


def print_of(tokens: Column) -> Column:
    """Equal for texts with the same words."""
    return F.md5(F.array_join(tokens, " "))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


class Duplicates:
    """Classes of the texts of ``docs`` (``doc_id, text``), with all that was found on the way as tables.

    Texts without words are each in a class with their copies only, and
    compared with none. Repeated rows, null ids and null texts are rows like
    others; the class of rows without any id is null. Further columns are
    ignored, and an empty table has no classes.
    """

    def __init__(self, docs: DataFrame, similarity: float = SIMILARITY):
        self.docs, self.similarity = docs, similarity
        ship_package(docs.sparkSession)
        self.folder = Workspace(docs.sparkSession, "near-dup")
        both = let(words(F.col("text")), lambda w: F.struct(print_of(w).alias("print"), _hashes(w).alias("hashes")))
        prints = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", both.alias("both"))
        prints = prints.select("row", "doc_id", "both.print", "both.hashes")
        types = T.StructType(prints.drop("hashes").schema.fields).add("bands", T.ArrayType(T.LongType()))
        self.rows = self.folder.save(prints.mapInArrow(_per_text(_keys_of, "bands"), types), "rows")
        one = self.rows.groupBy("print").agg(F.min("row").alias("node"), F.min_by("bands", "row").alias("bands"))
        self.texts = self.folder.save(one, "texts")
        each = self.texts.select(F.explode("bands").alias("band"), "node")
        shared = each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
        self.bands = self.folder.save(each.join(shared, "band"), "bands")
        self.labels = self._classes()

    def _shingle_sets(self) -> DataFrame:
        """``node, shingles, size`` of the texts that share a band with another."""
        nodes = self.bands.select("node").distinct()
        wanted = self.folder.save(self.texts.join(nodes, "node").select("print", "node"), "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        texts = self.docs.select(print_of(words(F.col("text"))).alias("print"), "text").join(wanted, "print")
        one = texts.groupBy("node").agg(F.first("text").alias("text")).select("node", _hashes(words(F.col("text"))).alias("hashes"))
        sets = one.mapInArrow(_per_text(_sets_of, "shingles"), "node long, shingles array<bigint>")
        return self.folder.save(sets.withColumn("size", F.size("shingles")), "sets")

    def _classes(self) -> DataFrame:
        """``node, label`` for the texts that are linked; others are classes of their own."""
        sets, spark = self._shingle_sets(), self.docs.sparkSession
        links = compared = spark.createDataFrame([], "a long, b long")
        labels = spark.createDataFrame([], "node long, label long")
        for number in range(HUB_ROUNDS + 1):
            members = self.bands.join(labels, "node", "left").select(
                "band", "node", F.coalesce("label", "node").alias("label")
            )
            pairs = self._with_hubs(members, number) if number < HUB_ROUNDS else self._apart(members, sets)
            new = pairs.distinct().join(compared, ["a", "b"], "left_anti")
            count = self.folder.write(new, f"pairs-{number}")["rows"]
            if not count and number == HUB_ROUNDS:
                break
            new = self.folder.read(f"pairs-{number}")
            found = self.folder.write(self._linked(new, sets), f"links-{number}")["rows"]
            compared = union_all([compared, new])
            if found:
                links = union_all([links, self.folder.read(f"links-{number}")])
                labels = components(links, self.folder, f"round-{number}")
        return labels

    def _with_hubs(self, members: DataFrame, number: int) -> DataFrame:
        """Each member with one of its band that has another label; the one differs from round to round."""
        hub = F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(number))).alias("hub")
        hubs = members.groupBy("band").agg(hub, F.min("label").alias("low"), F.max("label").alias("high"))
        hubs = hubs.where("low < high").select("band", "hub")
        apart = members.join(hubs, "band").where("label != hub.label")
        return apart.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))

    def _apart(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """All pairs with different labels, among the texts of bands with two labels, that can be alike enough.

        Shingles are ordered by how many of these texts hold them, and those
        that only one holds are counted but not compared. If two sets have the
        similarity t or more, the place of their first common shingle leaves
        enough behind it in both: at most ``n - ceil(2t / (1 + t) n) + 1`` in
        the smaller set, ``m - ceil(t m) + 1`` in the larger. So boilerplate
        that many texts share meets none of those that differ beyond it. Texts
        that are all alike at somewhat less than t share rare shingles with
        many others; of these pairs the parities rule out most before they are
        listed, and none that has the similarity t.
        """
        mixed = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        nodes = members.join(mixed.where("low < high").select("band"), "band").select("node", "label").distinct()
        nodes = self.folder.save(nodes, "apart")
        marked = self.folder.save(with_parities(sets.join(nodes.select("node"), "node")).select("node", "parities"), "parities")
        each = sets.join(nodes, "node").select("node", "label", "size", F.explode("shingles").alias("shingle"))
        held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        held = self.folder.save(held, "held")
        found = F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("found")
        lists = each.join(held, "shingle").groupBy("node").agg(F.first("label").alias("label"), F.first("size").alias("size"), found)
        t, least = self.similarity, lambda x: F.ceil(x - F.lit(1e-9))
        alone = F.col("size") - F.size("found")
        first = F.slice("found", 1, F.greatest(F.col("size") - least(F.col("size") * t) + 1 - alone, F.lit(0)).cast("int"))
        known = ("node", "label", "size", "parities")
        places = lists.join(marked, "node").select(*known, alone.alias("alone"), F.posexplode(first).alias("i", "x"))
        rows = places.select(*known, F.col("x.shingle").alias("shingle"), (F.col("alone") + F.col("i") + 1).alias("place"))
        count = self.folder.write(rows, "firsts")["rows"]
        rows = self.folder.read("firsts", schema=rows.schema)
        short = F.col("place") <= F.col("size") - least(F.col("size") * (2 * t / (1 + t))) + 1
        smaller = rows.where(short).select("shingle", *(F.col(c).alias(f"{c}_a") for c in (*known, "place")))
        larger = rows.select("shingle", *(F.col(c).alias(f"{c}_b") for c in (*known, "place")))
        rest = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
        total = F.col("size_a") + F.col("size_b")
        common = least(total * (t / (1 + t)))
        wanted = (
            (F.struct("size_a", "node_a") < F.struct("size_b", "node_b"))
            & (F.col("label_a") != F.col("label_b"))
            & (F.col("size_a") >= F.col("size_b") * t - 1e-9)
            & (rest + 1 >= common)
            & (total - _bits_apart(F.col("parities_a"), F.col("parities_b")) >= 2 * common)
        )
        # A shingle's work is the product of its rows on both sides; the limit keeps the list of busy ones short.
        limit = max(WORK, (count // skew.BROADCAST_ROWS) ** 2)
        work = rows.groupBy("shingle").agg((F.count(F.lit(1)) * F.count_if(short)).alias("n"))
        busy = self.folder.write(skew.hot_keys(work, "shingle", "n", limit), "busy")["rows"]
        hot = self.folder.read("busy") if busy else None
        met = skew.salted_join(larger, smaller, "shingle", F.col("node_b"), hot).where(wanted)
        return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    def _linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose exact similarity reaches the threshold; sizes decide first what they can."""
        sizes = sets.select("node", "size")
        near = pairs.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
        near = near.where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * self.similarity)
        of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("in_a"))
        of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("in_b"))
        both = near.join(of_a, "a").join(of_b, "b")
        both = both.withColumn("common", F.size(F.array_intersect("in_a", "in_b")))
        union = F.col("size_a") + F.col("size_b") - F.col("common")
        return both.where(F.col("common") >= union * self.similarity).select("a", "b")

    def classes(self) -> DataFrame:
        """``doc_id, class_id, copies`` of every row: the least id of its class, and the rows of the class."""
        named = self._named()
        ids = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
        return named.join(ids, "label").select("doc_id", "class_id", "copies")

    def _named(self) -> DataFrame:
        nodes = self.texts.select("print", "node").join(self.labels, "node", "left")
        nodes = nodes.select("print", F.coalesce("label", "node").alias("label"))
        return self.rows.select("doc_id", "print").join(nodes, "print")

    def one_of_each(self) -> DataFrame:
        """One row of ``docs`` for each class: the one with the least id; of its copies any."""
        last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
        kept = self._named().groupBy("label").agg(F.min_by("print", F.struct(last, "print")).alias("print"))
        row = F.struct(*self.docs.columns).alias("row")
        whole = self.docs.select(row, last.alias("last"), print_of(words(F.col("text"))).alias("print"))
        one = whole.groupBy("print").agg(F.min_by("row", "last").alias("row"))
        return one.join(kept.select("print"), "print", "left_semi").select("row.*")


def components(links: DataFrame, folder: Workspace, name: str) -> DataFrame:
    """``node, label`` with the least node of each connected component of ``links`` (``a, b``).

    Every round takes the least label among neighbours and then the label of
    that label, so the rounds grow with the logarithm of a chain's length.
    """
    edges = folder.save(links.union(links.select("b", "a")).toDF("node", "other").distinct(), f"{name}-edges")
    labels = edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
    labels = folder.save(labels, f"{name}-labels-0")
    number, changed = 0, 1
    while changed:
        number += 1
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node")
        near = near.agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("beyond"))
        after = best.join(jump, "best", "left").select(
            "node", F.least("best", F.coalesce("beyond", "best")).alias("after"), F.col("label").alias("before")
        )
        moved = F.sum((F.col("after") != F.col("before")).cast("long")).alias("moved")
        changed = folder.write(after, f"{name}-labels-{number}", moved)["moved"]
        labels = folder.read(f"{name}-labels-{number}").select("node", F.col("after").alias("label"))
    return labels
