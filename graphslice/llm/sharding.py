"""Histogram sort into shards of equal bytes.

Rows are ordered by a 128-bit key: a hash of the text, so that equal texts are
neighbours, then a hash of the id and a number among equal rows. Each round counts the exact bytes below
256 candidate boundaries around every splitter that is not settled, in one
aggregation that combines before its shuffle; only those counts reach the
driver. When all splitters meet the tolerance the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphslice.llm.text import byte_count
from graphslice.plans.workspace import Workspace

SHARDS = 24
TOLERANCE = 0.001  # of a shard's bytes, at each splitter
SLOT_ROWS = 4096  # mean rows that are numbered together
COPIES = 1 << 20  # copies of one row that one task makes
_BITS, _WORD = 8, 64
_FLIP = -(1 << 63)  # turns signed order into unsigned order


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` and the key ``k1, k2``, which no two rows share.

    Equal rows are counted, and their numbers 1, 2, ... are part of the key, so that
    a great many copies of one row can be cut like any others.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (byte_count(F.col("text")) + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    last = F.expr(f"(n - 1) div {COPIES}")
    lots = counted.where(F.col("n") > COPIES).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    few = counted.where(F.col("n") <= COPIES).withColumn("lot", F.lit(0).cast("long"))
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("n") - F.col("lot") * COPIES))
    each = few.unionByName(lots.repartition("k1", "lot")).select(*rows.columns, "lot", F.explode(copies).alias("copy"))
    number = F.col("lot") * COPIES + F.col("copy")
    return each.select(*rows.columns, F.xxhash64("doc_id", number).alias("k2"))


def _digit(level: int, bits: int) -> Column:
    """The first ``bits`` bits of the key word that ``level`` is in, as an unsigned number."""
    word = F.col("k1" if level * _BITS < _WORD else "k2").bitwiseXOR(F.lit(_FLIP))
    return F.shiftrightunsigned(word, _WORD - bits)


def _signed(value: int) -> int:
    value ^= 1 << 63
    return value - (1 << 64) if value >= 1 << 63 else value


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The smallest keys ``(k1, k2)`` of shards 1, 2, ...

    A boundary is settled when the bytes below it are within ``tolerance`` of
    a shard of its target, else the digit that holds the target is refined,
    down to single keys. The driver holds at most 256 counts per splitter.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    open_at = {i: ((), 0) for i in range(1, shards)}  # splitter -> digits so far, bytes below them
    settled: dict[int, tuple[int, ...]] = {}
    levels = 2 * _WORD // _BITS
    for level in range(levels):
        prefixes = {digits for digits, _ in open_at.values()}
        counts = _histogram(rows, level, prefixes)
        for i, (digits, below) in list(open_at.items()):
            target = total * i / shards
            edges = [below]
            for digit in range(1 << _BITS):
                edges.append(edges[-1] + counts.get((*digits, digit), (0, 0))[0])
            nearest = min(range(len(edges)), key=lambda d: (abs(edges[d] - target), d))
            holder = max((d for d in range(1 << _BITS) if edges[d] <= target), default=0)
            single = counts.get((*digits, holder), (0, 0))[1] <= 1
            if abs(edges[nearest] - target) <= slack or single or level == levels - 1:
                settled[i] = _carry((*digits, nearest))
                del open_at[i]
            else:
                open_at[i] = ((*digits, holder), edges[holder])
        if not open_at:
            break
    return [_key(settled[i]) for i in sorted(settled)]


def _histogram(rows: DataFrame, level: int, prefixes: set[tuple[int, ...]]) -> dict[tuple[int, ...], tuple[int, int]]:
    """Bytes and rows by digit at ``level`` of the rows under each prefix."""
    per_word = _WORD // _BITS
    in_word = level % per_word
    within = rows
    if level >= per_word:
        within = within.where(F.col("k1").isin(sorted({_signed(_number(p[:per_word])) for p in prefixes})))
    tails = {p[level - in_word :]: None for p in prefixes}
    if in_word:
        within = within.where(_digit(level, in_word * _BITS).isin(sorted({_number(t) for t in tails})))
    head = F.col("k1") if level >= per_word else F.lit(0).cast("long")
    counted = (
        within.groupBy(head.alias("head"), _digit(level, (in_word + 1) * _BITS).alias("digits"))
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    found = {}
    for row in counted:
        front = _digits((row["head"] - _FLIP) & ((1 << 64) - 1), per_word) if level >= per_word else ()
        found[(*front, *_digits(row["digits"] & ((1 << 64) - 1), in_word + 1))] = (row["bytes"], row["n"])
    return found


def _number(digits: tuple[int, ...]) -> int:
    value = 0
    for digit in digits:
        value = (value << _BITS) | digit
    return value


def _digits(value: int, n: int) -> tuple[int, ...]:
    return tuple((value >> (_BITS * (n - 1 - i))) & ((1 << _BITS) - 1) for i in range(n))


def _carry(digits: tuple[int, ...]) -> tuple[int, ...]:
    """Digits whose last may be one too many, with that carried; past the largest key, the largest."""
    value, n = _number(digits[:-1]) * (1 << _BITS) + digits[-1], len(digits)
    return _digits(value, n) if value < 1 << (_BITS * n) else ((1 << _BITS) - 1,) * (2 * _WORD // _BITS)


def _key(digits: tuple[int, ...]) -> tuple[int, int]:
    per_word = _WORD // _BITS
    full = (*digits, *(0,) * (2 * per_word - len(digits)))
    return _signed(_number(full[:per_word])), _signed(_number(full[per_word:]))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with its shard and its slot there.

    Returns ``doc_id, size, text_crc32, shard, slot``. The size is the UTF-8
    bytes of the text (none for null) and 8. Shards have sizes as equal as
    whole rows allow, within the tolerance at each end. Equal texts stay
    together unless a boundary must cut them to meet it; null and empty texts
    count as equal. Repeated rows, also with null ids, are cut like others;
    further columns are ignored; an empty table gives no rows. Slots count
    from 0 without gaps.
    """
    folder = Workspace(docs.sparkSession, "shards")
    rows = folder.save(keyed(docs), "rows")
    past = [
        (F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b)) for a, b in splitters(rows, shards, tolerance)
    ]
    number = sum((p.cast("int") for p in past), F.lit(0))
    parts = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    placed = rows.withColumn("shard", number).withColumn("part", F.pmod(F.col("k2"), F.lit(parts)))
    sizes = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "part").orderBy("k1", "k2")
    numbered = placed.withColumn("place", F.row_number().over(order) - 1)
    slot = (F.col("first") + F.col("place")).cast("long")
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", slot.alias("slot")
    )
