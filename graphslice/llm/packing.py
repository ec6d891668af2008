"""Pack token sequences into windows by non-negative least squares.

A document's ids are cut into whole windows and one remainder. Shallow
combinations of remainder lengths that fill a window exactly are enumerated;
non-negative least squares against the histogram of remainders says how often
to use each. Rounded counts become assignments, exact combinations of what is
left are taken greedily, and the rest is laid end to end.

The histogram and the plan have a size bounded by the window. Places within a
length come from counters per task and their running sums, so no task sees all
pieces of a length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphslice.plans.shipping import ship_package
from graphslice.plans.workspace import Workspace

WINDOW = 1024
END = 0  # closes every document
BATCH_IDS = 1 << 19  # ids that a task holds at once, but for those of one text
#: Fixed value: how the byte-level vocabulary cuts words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STEPS = 400
_PIECES = "part int, doc_id long, start long, length int, doc_tokens long, place long, ids binary"
_PLACED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Encoder:
    """Ids as little-endian 32-bit bytes; a special token written out in a text has its own id, as the tokenizer gives it.

    ``ranks`` names the same vocabulary as byte strings with their ranks, for
    a faster library. It takes the texts of plain Latin letters, digits,
    marks and white space without very long words, for which both libraries
    cut words alike; all other texts, and all texts without ``ranks``, go to
    the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._fast = _ranked(ranks) if ranks else None

    def encode(self, text: str) -> bytes:
        if self._fast is not None and not _UNUSUAL.search(text) and not any(token in text for token in self._special):
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: Anything but plain Latin text, or a word of two thousand characters.
_UNUSUAL = re.compile(r"[^\t\n\x20-\x7e\xa1-\u024f]|[^\s]{2000}")


def _ranked(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranked", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[tuple, Encoder] = {}


def _encoder(*paths: str | None) -> Encoder:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def _in_pieces(paths: tuple[str | None, ...], window: int):
    """Rows ``doc_id, text`` to pieces: whole windows, and a remainder with its place among the task's of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*paths).encode
        part, seen, full = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = encode(text.as_py() or "") + END.to_bytes(4, "little")
                n, key = len(raw) // 4, doc_id.as_py()
                for start in range(0, n, window):
                    length = min(window, n - start)
                    if length == window:
                        place, full = full, full + 1
                    else:
                        place = int(seen[length])
                        seen[length] += 1
                    rows.append((part, key, start, length, n, place, raw[4 * start : 4 * (start + length)]))
                held += n
                if held >= BATCH_IDS:
                    yield _batch(rows, _PIECES)
                    rows, held = [], 0
        yield _batch(rows, _PIECES)

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    arrays = [pa.array(values, _ARROW[kind]) for values, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """All sets of two or three of ``lengths`` that fill the window, longest first; 0 where there is no third."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    present[0] = False
    found = []
    for longest in np.flatnonzero(present)[::-1]:
        second = np.arange(min(longest, window - longest), 0, -1)
        third = window - longest - second
        fits = present[second] & (third <= second) & ((third == 0) | present[third])
        found.append(np.stack([np.full(fits.sum(), longest), second[fits], third[fits]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def least_squares(sets: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Counts x >= 0 of the sets that bring their lengths nearest to the histogram: accelerated projected gradient."""
    x = np.zeros(len(sets))
    used = np.stack([np.bincount(s[s > 0], minlength=len(histogram)) for s in sets.T]).sum(0) if len(sets) else 0
    step = 1 / (3 * max(np.max(used, initial=0), 1))
    ahead, t = x, 1.0
    for _ in range(_STEPS if len(sets) else 0):
        filled = np.bincount(sets.ravel(), np.repeat(ahead, 3), len(histogram))
        error = filled - histogram
        error[0] = 0
        after = np.maximum(ahead - step * error[sets].sum(1), 0)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


@dataclass(frozen=True)
class Plan:
    """Where pieces go: runs of places within a length, each with its first sequence and offset.

    ``keys`` are ``length << 40 | first place``, sorted; from the place
    ``rest[length]`` on, pieces lie on a line from ``line[length]`` on, which
    is cut into windows from sequence ``first_line`` on.
    """

    window: int
    keys: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    rest: np.ndarray
    line: np.ndarray
    first_line: int


def make_plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """``histogram[n]``: remainders of length n, below the window."""
    left = np.array(histogram, np.int64)
    sets = combinations(window, np.flatnonzero(left))
    ideal = least_squares(sets, left.astype(float))
    # Rounding the running sum keeps the total also where all counts are small.
    counts = np.diff(np.floor(np.cumsum(ideal) + 0.5), prepend=0).astype(np.int64)
    runs, place, sequence = [], np.zeros(len(left), np.int64), 0
    by_use = np.argsort(-ideal, kind="stable")
    for most in (counts, None):
        for s in by_use:
            lengths = [int(n) for n in sets[s] if n]
            use = min(int(left[n]) // lengths.count(n) for n in lengths)
            use = use if most is None else min(use, int(most[s]))
            if use <= 0:
                continue
            offset = 0
            for n in lengths:
                runs.append(((n << 40) | int(place[n]), sequence, offset))
                place[n] += use
                left[n] -= use
                offset += n
            sequence += use
    runs.sort()
    keys, sequences, offsets = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else ([], [], [])))
    lengths = np.arange(len(left), dtype=np.int64)
    ends = np.cumsum((left * lengths)[::-1])[::-1]  # the longest first
    line = ends - left * lengths
    return Plan(window, keys, sequences, offsets, place, line, sequence)


def _in_place(plan: Plan):
    """Remainders with their place among all of their length to pieces in sequences; one that meets a window's end is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, start, length, tokens, place, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                over = place - plan.rest[length]
                if over < 0:
                    run = int(np.searchsorted(plan.keys, (length << 40) | place, "right")) - 1
                    sequence = int(plan.sequences[run]) + place - (int(plan.keys[run]) & ((1 << 40) - 1))
                    spots = [(0, length, sequence, int(plan.offsets[run]))]
                else:
                    spots = _on_line(int(plan.line[length] + over * length), length, plan)
                for first, n, sequence, offset in spots:
                    ids = raw[4 * first : 4 * (first + n)]
                    rows.append((doc_id, start + first, n, tokens, sequence, offset, ids))
            yield _batch(rows, _PLACED)

    return run


def _on_line(at: int, length: int, plan: Plan) -> list[tuple[int, int, int, int]]:
    sequence, offset = divmod(at, plan.window)
    head = min(length, plan.window - offset)
    spots = [(0, head, plan.first_line + sequence, offset)]
    if head < length:
        spots.append((head, length - head, plan.first_line + sequence + 1, 0))
    return spots


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) as pieces in sequences of at most ``window`` ids.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``
    (little-endian 32-bit). Each id of each row is in one piece; all sequences
    but one are full. A null or empty text is the closing id alone. Repeated
    rows and null ids are packed on their own, an empty table gives no rows,
    and further columns are ignored.
    """
    ship_package(docs.sparkSession)
    folder = Workspace(docs.sparkSession, "pack")
    pieces = docs.select("doc_id", "text").mapInArrow(_in_pieces((tokenizer, ranks), window), _PIECES)
    pieces = folder.save(pieces, "pieces")
    rests = pieces.where(F.col("length") < window)
    counts = folder.save(rests.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(window, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    located = rests.join(firsts, ["part", "length"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("first") + F.col("place")).alias("place"), "ids"
    )
    rest = located.mapInArrow(_in_place(make_plan(histogram, window)), _PLACED)
    # Whole windows need no plan; their sequence is named by task and place.
    sequence = F.shiftleft(F.col("part").cast("long"), 36) + F.col("place") + F.lit(1 << 60)
    full = pieces.where(F.col("length") == window).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens",
        sequence.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids",
    )
    return full.unionByName(rest)
