"""A Merkle manifest of documents, with SHA-256 midstates in its nodes.

A node hashes the hex digests of up to 16 children. A hex digest is 64 bytes,
which is one block of SHA-256, so the hash state before each child slot is
exactly eight words: the node keeps a copy of it, as a column that can be
written and read. To fold a replaced leaf, the state before its slot is
resumed with the replacement and the siblings to its right only.

Leaves get their places from one global sort, so a source with a third of all
rows is spread like any other. A level of the tree is one grouping by parent,
16 rows to a group. Paths are built from the root down, one row per node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphslice.plans.shipping import ship_package
from graphslice.plans.workspace import Workspace, union_all

FAN = 16  # children of a node
DIGEST, STATE = 64, 32  # bytes of a hex digest and of a hash state
BROADCAST_ROWS = 1 << 20  # first places of a source's runs; more are joined by shuffle
_STEP = "struct<state: binary, left: string, right: string>"


# --- SHA-256 over many rows at once


def _root_bits(power: int, count: int) -> np.ndarray:
    """The first 32 fractional bits of the square or cube roots of the first primes."""
    primes = [n for n in range(2, 320) if all(n % d for d in range(2, math.isqrt(n) + 1))][:count]
    found = []
    for scaled in (p << (32 * power) for p in primes):
        root = round(scaled ** (1 / power))
        while root**power > scaled:
            root -= 1
        while (root + 1) ** power <= scaled:
            root += 1
        found.append(root & 0xFFFFFFFF)
    return np.array(found, np.uint32)


_START, _ROUND = _root_bits(2, 8), _root_bits(3, 64)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 x rows) after one block (16 x rows) each."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            old, new = w[i - 15], w[i - 2]
            small = _turn(old, 7) ^ _turn(old, 18) ^ (old >> np.uint32(3))
            large = _turn(new, 17) ^ _turn(new, 19) ^ (new >> np.uint32(10))
            w.append(w[i - 16] + small + w[i - 7] + large)
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def start(rows: int) -> np.ndarray:
    return np.repeat(_START[:, None], rows, axis=1)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Hex digests (rows x 64 characters) of messages of so many whole blocks each."""
    end = np.zeros((16, len(blocks)), np.uint32)
    end[0] = 0x80000000
    end[14], end[15] = blocks >> 23, (blocks << 9) & 0xFFFFFFFF
    raw = np.ascontiguousarray(compress(state, end).T.astype(">u4")).view(np.uint8)
    return _HEX[np.stack([raw >> 4, raw & 15], axis=2)].reshape(len(blocks), DIGEST)


def blocks_of(text: np.ndarray) -> np.ndarray:
    """Blocks (16 x rows) of rows of 64 characters."""
    return np.ascontiguousarray(text).view(">u4").astype(np.uint32).T


class _Strings:
    """The bytes of a string or binary column, and where each value begins and how long it is."""

    def __init__(self, column: pa.Array):
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.starts, self.sizes = ends[:-1], np.diff(ends)

    def take(self, rows: np.ndarray, skip: int, size: int) -> np.ndarray:
        """``size`` bytes of each of ``rows``, from ``skip`` on."""
        return self.data[(self.starts[rows] + skip)[:, None] + np.arange(size)]


def _states_and_digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that end in ``children``, with the states before each child and the digest."""
    rows, children = np.arange(batch.num_rows), _Strings(batch.column("children"))
    width = children.sizes // DIGEST
    state, before = start(len(rows)), np.zeros((len(rows), FAN, 8), ">u4")
    for slot in range(int(width.max(initial=0))):
        on = np.flatnonzero(width > slot)
        before[on, slot] = state[:, on].T
        state[:, on] = compress(state[:, on], blocks_of(children.take(on, slot * DIGEST, DIGEST)))
    kept = [before[row, :n].tobytes() for row, n in enumerate(width)]
    digest = finish(state, width)
    columns = [*batch.columns, pa.array(kept, pa.binary()), _text(digest)]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "states", "digest"])


def _text(digests: np.ndarray) -> pa.Array:
    ends = np.arange(len(digests) + 1, dtype=np.int32) * DIGEST
    return pa.StringArray.from_buffers(len(digests), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(digests)))


def _fold(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``path`` gives way to ``folded_root``: each step resumes its state with the digest below and what is right of it."""
    path = batch.column("path")
    ends = path.offsets.to_numpy().astype(np.int64)
    steps = path.values
    states, left, right = (_Strings(steps.field(i)) for i in range(3))
    digest = _Strings(batch.column("now")).take(np.arange(batch.num_rows), 0, DIGEST)
    first, depth = ends[:-1], np.diff(ends)
    for level in range(int(depth.max(initial=0))):
        rows = np.flatnonzero(depth > level)
        at = first[rows] + level
        state = np.ascontiguousarray(states.take(at, 0, STATE)).view(">u4").astype(np.uint32).T
        state = compress(state, blocks_of(digest[rows]))
        for skip in range(0, int(right.sizes[at].max()), DIGEST):
            on = np.flatnonzero(right.sizes[at] > skip)
            state[:, on] = compress(state[:, on], blocks_of(right.take(at[on], skip, DIGEST)))
        digest[rows] = finish(state, (left.sizes[at] + right.sizes[at]) // DIGEST + 1)
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in {"path", "now"}]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), _text(digest)], [*(n for n, _ in kept), "folded_root"])


def _each(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run


# --- leaves


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """The digest of a document's fields, with ``text`` as its text."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.sha2(F.concat(*map(_field, fields)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- trees


def _numbered(rows: DataFrame, folder: Workspace, name: str, *order: str) -> DataFrame:
    """``rows`` with ``idx``, their place within ``key`` in the given order, and ``total``, the rows of the key.

    Places come from one sort over all keys: a row's place in its task, less
    that of the key's first row there, plus the key's rows in tasks before.
    """
    rows = folder.save(rows.orderBy("key", *order).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("at", 33).alias("part")
    runs = rows.groupBy("key", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("key")  # a row for each task that sorted
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    runs = runs.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    count = folder.write(runs, f"{name}-runs")["rows"]
    runs = folder.read(f"{name}-runs", schema=runs.schema)
    if count <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    placed = rows.withColumn("part", part).join(runs, ["key", "part"])
    return placed.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _grow(leaves: DataFrame, folder: Workspace, name: str) -> list[DataFrame]:
    """The levels above ``leaves`` (``key, idx, total, digest, item``), lowest first; a key ends where one node is left.

    A level has ``key, idx, total, items, children, states, digest``; ``items`` are those of the leaves, null above.
    """
    levels, below = [], leaves
    while True:
        item = "item" if not levels else None
        members = F.sort_array(F.collect_list(F.struct("idx", "digest", *([item] if item else []))))
        parent = F.expr(f"idx div {FAN}").alias("parent")
        groups = below.where("total > 1").groupBy("key", parent).agg(F.max("total").alias("total"), members.alias("members"))
        items = F.col("members.item") if item else F.lit(None).cast(T.ArrayType(leaves.schema["item"].dataType))
        nodes = groups.select(
            "key",
            F.col("parent").alias("idx"),
            F.ceil(F.col("total") / FAN).alias("total"),
            items.alias("items"),
            F.array_join("members.digest", "").alias("children"),
        )
        types = T.StructType([*nodes.schema.fields]).add("states", T.BinaryType()).add("digest", T.StringType())
        table = f"{name}-{len(levels) + 1}"
        seen = folder.write(nodes.mapInArrow(_each(_states_and_digest), types), table, F.max("total").alias("widest"))
        if not seen["rows"]:
            return levels
        levels.append(folder.read(table, schema=types))
        if seen["widest"] == 1:
            return levels
        below = levels[-1]


def _steps(nodes: DataFrame, *keep: str) -> DataFrame:
    """Rows with ``path`` to one for each child ``slot``, whose path begins with the step to the node."""
    slots = F.sequence(F.lit(0), (F.length("children") / DIGEST).cast("int") - 1)
    each = nodes.select("*", F.explode(slots).alias("slot"))
    step = F.struct(
        F.expr(f"substring(states, slot * {STATE} + 1, {STATE})").alias("state"),
        F.expr(f"substring(children, 1, slot * {DIGEST})").alias("left"),
        F.expr(f"substring(children, (slot + 1) * {DIGEST} + 1)").alias("right"),
    )
    return each.select("key", *keep, F.concat(F.array(step), F.col("path")).alias("path"), "subroot", "root")


def _leaf_paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, folder: Workspace, name: str) -> DataFrame:
    """``key, item, path, subroot, root`` of each leaf; ``above`` has ``key, path, subroot, root`` of each tree."""
    lone = leaves.where("total = 1").join(above, "key").select("key", "item", "path", "subroot", "root")
    paths = None
    for number in range(len(levels), 0, -1):
        nodes = levels[number - 1]
        found = nodes.where("total = 1").join(above, "key")
        if paths is not None:
            found = found.unionByName(nodes.where("total > 1").join(paths, ["key", "idx"]))
        if number > 1:
            child = (F.col("idx") * FAN + F.col("slot")).alias("idx")
            paths = folder.save(_steps(found, child), f"{name}-paths-{number}")
    if not levels:
        return lone
    return lone.unionByName(_steps(found, F.get("items", F.col("slot")).alias("item")))


class Manifest:
    """The tree of ``docs`` (``doc_id, source, lang, n_chars, text``): a tree for each source, and one over their roots.

    ``now``, if given, is the text as it is found today, an expression on the
    columns of ``docs``; :meth:`verify` tells which documents still have the
    text that the manifest holds. A null in any column is a value of its own.
    Rows of a source stand by ``doc_id``, null first, and then by digest;
    rows repeated in full are leaves beside each other. Further columns are
    ignored. An empty table has no leaf, no subroot and no root.
    """

    def __init__(self, docs: DataFrame, now: Column | None = None):
        ship_package(docs.sparkSession)
        self.folder = Workspace(docs.sparkSession, "manifest")
        text = F.col("text")
        changed = F.lit(None).cast("string") if now is None else F.when(now != text, leaf_of(now))
        # Null comes before all names; a sort of strings is one of their bytes.
        key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
        rows = docs.select(
            key.alias("key"),
            F.col("doc_id").alias("_id"),
            leaf_of(text).alias("digest"),
            changed.alias("changed"),
            F.monotonically_increasing_id().alias("row"),
        )
        rows = self.folder.save(rows, "leaves")
        item = F.struct(F.col("_id").alias("doc_id"), F.col("digest").alias("leaf"), "changed").alias("item")
        # The row tells rows repeated in full apart, so that the sort can split them.
        placed = _numbered(rows, self.folder, "doc", "_id", "digest", "row")
        self.leaves = self.folder.save(placed.select("key", "idx", "total", "digest", item), "numbered")
        self.levels = _grow(self.leaves, self.folder, "level")
        ends = [level.where("total = 1").select("key", "digest") for level in self.levels]
        self.subroots = self.folder.save(union_all([self.leaves.where("total = 1").select("key", "digest"), *ends]), "subroots")
        tops = self.subroots.select(F.lit("").alias("key"), F.struct(F.col("key").alias("name"), "digest").alias("item"), "digest")
        tops = _numbered(tops, self.folder, "top", "item")
        self.tops = self.folder.save(tops, "top-numbered")
        self.top_levels = _grow(self.tops, self.folder, "top")
        top = self.top_levels[-1] if self.top_levels else self.tops.where("total = 1")
        self.root = top.select(F.col("digest").alias("root"))

    def nodes(self) -> DataFrame:
        """``key, height, idx, children, states, digest`` of every node above the leaves, subtrees and top tree."""
        columns = ["idx", "children", "states", "digest"]
        kinds = [(self.levels, F.col("key")), (self.top_levels, F.lit(None).cast("string"))]
        every = [
            level.select(key.alias("key"), F.lit(height).alias("height"), *columns)
            for levels, key in kinds
            for height, level in enumerate(levels, 1)
        ]
        empty = self.folder.spark.createDataFrame([], "key string, height int, idx long, children string, states binary, digest string")
        return union_all([empty, *every])

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, changed, subroot, root, path`` of every document; a step of ``path`` has the midstate
        before its slot and the digests ``left`` and ``right`` of it."""
        none = F.array().cast(f"array<{_STEP}>").alias("path")
        ends = self.root.select(F.lit("").alias("key"), none, F.lit(None).cast("string").alias("subroot"), "root")
        ends = self.folder.save(ends, "root")
        tops = _leaf_paths(self.tops, self.top_levels, ends, self.folder, "top")
        above = self.folder.save(
            tops.select(F.col("item.name").alias("key"), "path", F.col("item.digest").alias("subroot"), "root"), "above"
        )
        found = _leaf_paths(self.leaves, self.levels, above, self.folder, "level")
        return found.select("item.*", "subroot", "root", "path")

    def verify(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document."""
        siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
        rows = self.proofs().select(
            "doc_id",
            "leaf",
            "subroot",
            "root",
            F.sha2(siblings, 256).alias("proof_sha256"),
            "path",
            F.coalesce("changed", "leaf").alias("now"),
        )
        types = T.StructType([*rows.schema.fields[:5], T.StructField("folded_root", T.StringType())])
        return rows.mapInArrow(_each(_fold), types).withColumn("verified", F.col("folded_root") == F.col("root"))
