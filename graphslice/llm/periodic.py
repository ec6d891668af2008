"""Periodic runs of words, found by internal pattern matching.

A text's words are cut into blocks of 2, 4, 8, ... words. Whether a block
occurs again close by is a query on the text itself: the block's suffixes are
a range of the suffix array, and a wavelet tree over that range names the next
occurrence after the block and the last one before it. Occurrences of a block
within a window of twice its length form a progression, so its difference is
the one period a run through the block can have. Equal ranks of the suffix
array's doubling steps tell how far the period goes on to both sides.

A run of period q with at least 4q words holds a block of q to 2q words that
starts at a multiple of its length, and q words more on one side of it, within
which a block occurs at multiples of q only. So no run is missed.

Many texts share one suffix array; words of different texts count as different.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphslice.llm.text import let, words
from graphslice.plans.shipping import ship_package

LEAST_POWER, LEAST_LENGTH = 4, 6  # periods and words
CHUNK_WORDS = 1 << 17  # words that share a suffix array, but for those of one longer text
_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Suffixes:
    """The suffix array of texts of word numbers, with the ranks of all doubling steps.

    ``ranks[k][i]`` is the first place, in the suffix array, of the suffixes
    that begin with the same ``2^k`` words as the one at ``i``.
    """

    def __init__(self, numbers: np.ndarray, ends: np.ndarray):
        n = len(numbers)
        sizes = np.diff(ends)
        self.start, self.stop = np.repeat(ends[:-1], sizes), np.repeat(ends[1:], sizes)
        places = np.arange(n)
        order = np.argsort(numbers, kind="stable")
        rank, some = self._split(np.zeros(n, np.int64), numbers[order], order, places)
        self.ranks, self.blocks = [rank.astype(np.int32)], []
        wide = 1
        while len(some):
            after = some + wide
            inside = after < self.stop[some]
            second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
            keys = rank[some] * (n + 1) + second
            order = np.argsort(keys)
            # Members of a group keep the group's places in the suffix array.
            now = rank[some][order]
            slots = now + np.arange(len(some)) - np.searchsorted(now, now)
            rank = rank.copy()
            rank, some = self._split(rank, keys[order], some[order], slots)
            wide *= 2
            self.ranks.append(rank.astype(np.int32))
            self.blocks.append(self._aligned(some, rank, wide))
        self.array = np.empty(n, np.int64)
        self.array[rank] = places

    def _split(self, rank: np.ndarray, keys: np.ndarray, members: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Give members with equal neighbouring ``keys`` the first of their slots; also those that are not alone."""
        if not len(keys):
            return rank, members
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(first, len(keys)))
        rank[members] = np.repeat(slots[first], sizes)
        shared = np.repeat(sizes > 1, sizes)
        self._sizes = np.repeat(sizes, sizes)[shared]
        return rank, members[shared]

    def _aligned(self, members: np.ndarray, rank: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
        """Place, and range in the suffix array, of the blocks of ``wide`` words that occur again."""
        chosen = ((members - self.start[members]) % wide == 0) & (members + wide <= self.stop[members])
        places = members[chosen]
        return places, rank[places], rank[places] + self._sizes[chosen]

    def reach(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the texts agree to the left of ``low`` and ``high``, and from them on to the right."""
        last = len(self.array) - 1
        left, right = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for step in range(len(self.ranks) - 1, -1, -1):
            rank, wide = self.ranks[step], 1 << step
            at = high + right
            fits = at + wide <= self.stop[high]
            same = rank[np.minimum(low + right, last)] == rank[np.minimum(at, last)]
            right += np.where(fits & same, wide, 0)
            at = low - left - wide
            fits = at >= self.start[low]
            same = rank[np.maximum(at, 0)] == rank[np.maximum(high - left - wide, 0)]
            left += np.where(fits & same, wide, 0)
        return left, right


class Wavelets:
    """A wavelet tree, in the form of a matrix of bits, over places below ``2^bits``."""

    def __init__(self, values: np.ndarray, bits: int):
        self.rows = []
        for bit in range(bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            before = np.zeros(len(values) + 1, np.int64)
            np.cumsum(zero, out=before[1:])
            self.rows.append((bit, before))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are less than its bound."""
        found = np.zeros(len(low), np.int64)
        for bit, before in self.rows:
            zeros_low, zeros_high = before[low], before[high]
            up = (bound >> bit) & 1 == 1
            found += np.where(up, zeros_high - zeros_low, 0)
            low = np.where(up, before[-1] + low - zeros_low, zeros_low)
            high = np.where(up, before[-1] + high - zeros_high, zeros_high)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of each range that has ``n`` smaller ones in it."""
        value = np.zeros(len(low), np.int64)
        for bit, before in self.rows:
            zeros_low, zeros_high = before[low], before[high]
            up = n >= zeros_high - zeros_low
            n = np.where(up, n - (zeros_high - zeros_low), n)
            value |= up.astype(np.int64) << bit
            low = np.where(up, before[-1] + low - zeros_low, zeros_low)
            high = np.where(up, before[-1] + high - zeros_high, zeros_high)
        return value


def _candidates(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods: a block's words are the same one period on."""
    if not suffixes.blocks or not len(suffixes.blocks[0][0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Only suffixes whose first two words occur again are asked for; their ranges stay ranges without the others.
    pairs = suffixes.ranks[1].astype(np.int64)
    twice = np.bincount(pairs, minlength=len(pairs))[pairs] > 1
    kept = twice[suffixes.array]
    before = np.append(0, np.cumsum(kept))
    tree = Wavelets(suffixes.array[kept], max(1, int(len(pairs) - 1).bit_length()))
    places, low, high = (np.concatenate(parts) for parts in zip(*suffixes.blocks, strict=True))
    wide = np.repeat([2 << k for k in range(len(suffixes.blocks))], [len(b[0]) for b in suffixes.blocks])
    low, high = before[low], before[high]
    own = tree.below(low, high, places)
    least = np.where(wide > 2, wide // 2, 0)
    found = []
    for step in (1, -1):
        there = (own + step >= 0) & (own + step < high - low)
        other = tree.nth(low[there], high[there], own[there] + step)
        period = np.abs(other - places[there])
        near = (period > least[there]) & (period <= wide[there])
        found.append((np.minimum(other, places[there])[near], period[near]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def runs_of(numbers: np.ndarray, ends: np.ndarray, power: int, shortest: int) -> tuple[np.ndarray, ...]:
    """Start, end and period of every run, by start and period; text t has the words ``ends[t]:ends[t + 1]``."""
    nothing = (np.zeros(0, np.int64),) * 3
    if not len(numbers):
        return nothing
    suffixes = Suffixes(numbers, ends)
    places, periods = _candidates(suffixes)
    if not len(places):
        return nothing
    left, right = suffixes.reach(places, places + periods)
    low, high = places - left, places + periods + right
    long = high - low >= np.maximum(shortest, power * periods)
    low, high, periods = low[long], high[long], periods[long]
    # Of the periods of one stretch the smallest is its own.
    order = np.lexsort((periods, high, low))
    low, high, periods = low[order], high[order], periods[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)]
    low, high, periods = low[new], high[new], periods[new]
    order = np.lexsort((periods, low))
    return low[order], high[order], periods[order]


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The texts' words, with the place of the first text, in chunks of about CHUNK_WORDS words."""
    first, held, size = 0, [], 0
    for place, text in enumerate(texts):
        held.append((text or b"").split())  # at the six white space characters of ASCII
        size += len(held[-1])
        if size >= CHUNK_WORDS:
            yield first, held
            first, held, size = place + 1, [], 0
    if held:
        yield first, held


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word; equal for equal words of one text, different between texts."""
    found, first = [], 0
    for tokens in texts:
        number = dict(zip(dict.fromkeys(tokens), count(first)))
        found.append(np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens)))
        first += len(number)
    return np.concatenate(found)


def _found(power: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for first, held in _chunks(texts):
                yield _rows(batch.column("doc_id").slice(first, len(held)), held, power, shortest)

    return run


def _rows(ids: pa.Array, texts: list[list[bytes]], power: int, shortest: int) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, texts)])
    low, high, periods = runs_of(_numbers(texts), ends, power, shortest)
    depth = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(depth, low + periods, 1)
    np.add.at(depth, high, -1)
    kept = np.cumsum(depth[:-1]) == 0
    of_text = np.searchsorted(low, ends)
    collapsed = [
        b" ".join(tokens if a == b else compress(tokens, kept[ends[t] : ends[t + 1]].tolist()))
        for t, (tokens, a, b) in enumerate(zip(texts, of_text[:-1].tolist(), of_text[1:].tolist(), strict=True))
    ]
    starts = low - ends[np.maximum(np.searchsorted(ends, low, "right") - 1, 0)]
    fields = [pa.array(column, pa.int64()) for column in (starts, high - low, periods)]
    runs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    columns = [
        ids,
        pa.array(np.diff(ends), pa.int64()),
        pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), runs),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, power: int = LEAST_POWER, shortest: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs`` (``doc_id, text``).

    A run is a stretch of words with smallest period q, of ``power`` times q
    and ``shortest`` words at least, that goes on to neither side; ``runs``
    has those of the text by start and period. ``collapsed`` is the text's
    words joined by one space, without those that a run holds after its first
    q. Null and empty texts have no words, no runs and an empty ``collapsed``.
    Rows, also equal ones and those with a null id, are separate; an empty
    table gives no rows; further columns are ignored. A text is handled in
    one task, with memory of some hundred bytes a word.
    """
    if power < LEAST_POWER:
        raise ValueError(f"runs of fewer than {LEAST_POWER} periods may be missed")
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_found(power, shortest), _FOUND)


def with_tail(text: Column, start: Column, period: Column) -> Column:
    """The words of ``text`` joined by one space, those from ``start`` on repeating with ``period``.

    ``start`` and ``period`` are functions of the number of words.
    """

    def repeated(tokens: Column) -> Column:
        n = F.size(tokens)
        first, every = start(n).cast("int"), period(n).cast("int")
        tail = F.transform(F.sequence(first, n - 1), lambda i: F.get(tokens, first + (i - first) % every))
        return F.when(n == 0, "").otherwise(F.array_join(F.concat(F.slice(tokens, 1, first), tail), " "))

    return let(words(text), repeated)
