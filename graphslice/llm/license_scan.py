"""License scan by patience alignment.

Where a text holds enough of a template's telling words close together, the
words there are aligned with the template: common ends first, then the words
that are unique on both sides, of which the longest increasing subsequence
anchors the alignment, then the gaps between anchors in the same way. The
share of the template's words that are aligned is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from graphslice.llm.license_texts import TEMPLATES
from graphslice.plans.shipping import ship_package

COVERAGE = 0.8  # of a template's words, aligned
DENSITY = 0.6  # aligned words among those from the first to the last
TELLING = 4  # letters of a telling word, at least

_WORD = re.compile(r"[^\W_]+")
_RESULT = "license string, start long, end long, matched int, coverage double"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for place, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            piles.append(place)
        else:
            tops[pile], piles[pile] = value, place
    chain, place = [], piles[-1] if piles else -1
    while place >= 0:
        chain.append(place)
        place = before[place]
    return chain[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal words, increasing on both sides."""
    pairs, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            pairs.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            pairs.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        once = _unique(text, a, a_end)
        anchors = [(once[w], at) for w, at in _unique(template, b, b_end).items() if w in once]
        anchors.sort(key=lambda pair: pair[1])
        chain = [anchors[i] for i in increasing([at for at, _ in anchors])]
        if not chain:
            continue
        pairs.extend(chain)
        for (x, y), (x_end, y_end) in zip([(a - 1, b - 1), *chain], [*chain, (a_end, b_end)], strict=True):
            gaps.append((x + 1, x_end, y + 1, y_end))
    return sorted(pairs)


def _unique(words: list[str], start: int, end: int) -> dict[str, int]:
    """The words that occur once from ``start`` to ``end``, with their places."""
    counts = Counter(words[start:end])
    return {words[i]: i for i in range(start, end) if counts[words[i]] == 1}


def telling_places(words: list[str]) -> frozenset[int]:
    """Where a template names its version or variant; a closing 0 may be left out, but not in an identifier."""
    if words[:3] == ["spdx", "license", "identifier"]:
        return frozenset(range(3, len(words)))
    variants = ("lesser", "affero", "sharealike", "noncommercial", "noderivatives")
    places: set[int] = set()
    for i, word in enumerate(words):
        after = words[i - 1] if i else ""
        version = word.isdigit() and (after in ("version", "attribution", *variants) or i - 1 in places)
        if word != "0" and (version or word in variants or re.fullmatch("v[0-9]+", word) or "cc" in words[:i]):
            places.add(i)
    return frozenset(places)


@dataclass(frozen=True)
class Template:
    """A license's words, those that tell it, and how many of them a finding must have."""

    name: str
    words: list[str]
    telling: frozenset[str]
    least: int
    reach: int  # words from a finding's first to its last, at most
    must: frozenset[int]  # places of the words that tell versions and variants, all to be aligned

    @classmethod
    def of(cls, name: str, text: str) -> Template:
        found = words(text)
        telling = frozenset(w for w in found if len(w) >= TELLING)
        others = sum(w not in telling for w in found)
        wanted = -int(-COVERAGE * len(found) // 1)
        return cls(name, found, telling, max(1, wanted - others), int(wanted / DENSITY) + 1, telling_places(found))

    def findings(self, text: list[str]) -> Iterator[tuple[int, int, int]]:
        """First and last word and number of aligned words of each place that covers the template."""
        told = [i for i, w in enumerate(text) if w in self.telling]
        needed, held = COVERAGE * len(self.words), _Held(text, self.words)
        free = 0  # words before this one belong to an earlier finding
        for j in range(len(told) - self.least + 1):
            if told[j] < free or told[j + self.least - 1] - told[j] >= self.reach:
                continue
            start = max(free, told[j] - (len(self.words) - self.least))
            if held.between(start, told[j] + self.reach) < needed:
                continue
            window = text[start : told[j] + self.reach]
            pairs = align(window, self.words)
            if len(pairs) < needed or not self.must <= {b for _, b in pairs}:
                continue
            first, last = start + pairs[0][0], start + pairs[-1][0]
            if len(pairs) >= DENSITY * (last - first + 1):
                free = last + 1
                yield first, last, len(pairs)


class _Held:
    """How many of a template's words a window of the text holds, each as often as both do; windows only move on."""

    def __init__(self, text: list[str], template: list[str]):
        self.text, self.wanted = text, Counter(template)
        self.counts: Counter[str] = Counter()
        self.start = self.end = self.found = 0

    def between(self, start: int, end: int) -> int:
        if start >= self.end:
            self.counts.clear()
            self.start = self.end = start
            self.found = 0
        while self.end < min(end, len(self.text)):
            word = self.text[self.end]
            self.end += 1
            if word in self.wanted:
                self.counts[word] += 1
                self.found += self.counts[word] <= self.wanted[word]
        while self.start < start:
            word = self.text[self.start]
            self.start += 1
            if word in self.wanted:
                self.found -= self.counts[word] <= self.wanted[word]
                self.counts[word] -= 1
        return self.found


class Scanner:
    """Findings of all templates in a text; where two overlap, the one with more aligned words stays."""

    def __init__(self, templates: dict[str, str]):
        self.templates = [Template.of(name, text) for name, text in templates.items() if words(text)]
        self.telling = frozenset().union(*(t.telling for t in self.templates))

    def scan(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """``license, start, end, matched, coverage``; start and end count code points."""
        found = words(text)
        told = self.telling.intersection(found)
        if not told:
            return []
        hits = [
            (matched, -order, first, last, t)
            for order, t in enumerate(self.templates)
            if t.telling & told
            for first, last, matched in t.findings(found)
        ]
        if not hits:
            return []
        kept: list[tuple] = []
        for hit in sorted(hits, key=lambda h: (-h[0], -h[1], h[2])):
            if all(hit[3] < other[2] or hit[2] > other[3] for other in kept):
                kept.append(hit)
        # Lower-casing may change the length of a text, so spans are taken from it word by word.
        spans = [m.span() for m in _WORD.finditer(text.lower())]
        exact = len(text.lower()) == len(text)
        place = (lambda i: i) if exact else _places(text)
        return [
            (t.name, place(spans[first][0]), place(spans[last][1]), matched, matched / len(t.words))
            for matched, _, first, last, t in sorted(kept, key=lambda h: h[2])
        ]


def _places(text: str):
    """From places in the lower-cased text to places in the text."""
    ends, total = [], 0
    for character in text:
        total += len(character.lower())
        ends.append(total)
    return lambda i: bisect_left(ends, i + 1) if i < total else len(text)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """License findings of ``docs`` (``doc_id, text``): ``doc_id, license, start, end, matched, coverage``.

    Whole texts are scanned; the span from ``start`` to ``end`` is in code
    points. Null and empty texts have no findings, repeated rows have theirs
    again, an empty table has none, and further columns are ignored.
    """
    ship_package(docs.sparkSession)
    known = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for batch in batches:
            rows = [
                (doc_id.as_py(), *hit)
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True)
                for hit in scanner.scan(text.as_py() or "")
            ]
            columns = zip(*rows, strict=True) if rows else ((),) * 6
            kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "license", "start", "end", "matched", "coverage"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_RESULT}")
