"""Periodic runs against a search of all periods, and on odd and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from graphslice.llm import periodic, queries

SF_DIR = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, power=4, shortest=6):
    """Every maximal stretch of every period, the least period of each stretch."""
    best, n = {}, len(words)
    for period in range(1, n // power + 1):
        i = 0
        while i + period < n:
            start = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            if i > start and i + period - start >= max(shortest, power * period):
                best.setdefault((start, i + period - start), period)
            i += 1
    return sorted((start, length, period) for (start, length), period in best.items())


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    drawn = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if drawn % 10 or not words:
        return words
    ninth, n = drawn // 10, len(words)
    a = ninth % n
    p = 1 + (n - a) // (3 + ninth % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(doc_id, text):
    words = planted(doc_id, SPACE.findall(text or ""))
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *best, milli, sha(lines), sha(collapsed(words, runs)))


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_texts(seed):
    draw = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(draw.randint(1, 4)):
            n, letters = draw.randint(0, 90), draw.randint(1, 4)
            words = [draw.randrange(letters) for _ in range(n)]
            if n and draw.random() < 0.6:
                a = draw.randrange(n)
                p = 1 + draw.randrange((n - a) // 3 + 1)
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            texts.append(words)
        ends = np.cumsum([0, *map(len, texts)])
        numbers = periodic._numbers([[str(w).encode() for w in words] for words in texts])
        found = [[] for _ in texts]
        for low, high, period in zip(*periodic.runs_of(numbers, ends, 4, 6), strict=True):
            t = int(np.searchsorted(ends, low, "right")) - 1
            found[t].append((low - ends[t], high - low, period))
        assert found == [all_runs(words) for words in texts]


def test_wavelets_against_sorting():
    draw = np.random.default_rng(3)
    values = draw.permutation(500)
    tree = periodic.Wavelets(values, 9)
    low = draw.integers(0, 499, 300)
    high = low + 1 + draw.integers(0, 500 - low)
    bound = draw.integers(0, 500, 300)
    parts = [np.sort(values[a:b]) for a, b in zip(low, high, strict=True)]
    assert tree.below(low, high, bound).tolist() == [int((p < x).sum()) for p, x in zip(parts, bound, strict=True)]
    nth = draw.integers(0, high - low)
    assert tree.nth(low, high, nth).tolist() == [int(p[i]) for p, i in zip(parts, nth, strict=True)]


def test_query_by_hand(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    short = [d for d in docs if len(d["text"] or "") < 8000]
    found = {r["doc_id"]: tuple(r) for r in queries.op13_dyadic_runs(spark, SF_DIR).collect()}
    assert len(found) == len(docs)
    for d in short:
        assert found[d["doc_id"]] == by_hand(d["doc_id"], d["text"])
    assert sum(r[1] > 0 for r in found.values()) > len(docs) / 40


def test_planted_tails(spark, docs_of):
    draw = random.Random(2)
    rows = [(i, " \n".join(draw.choices("abcdefghij", k=draw.randint(0, 120))), "s") for i in range(300)]
    docs = docs_of(rows)
    found = {r["doc_id"]: r["text"] for r in queries.planted(docs).collect()}
    for i, text, _ in rows:
        assert SPACE.findall(found[i]) == planted(i, SPACE.findall(text))


def test_odd_rows(docs_of, odd_docs):
    found = periodic.find_runs(odd_docs).collect()
    assert len(found) == odd_docs.count()
    for r in found:
        if not r["n_words"]:
            assert r["runs"] == [] and r["collapsed"] == ""
    long = "a b c " * 40_000 + "end"
    mixed = docs_of([(1, long, "a"), (1, long, "a"), (None, "x " * 6, "b"), (2, "x " * 5, "b"), (3, "ä b " * 9, None)])
    found = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(mixed).collect())
    assert found == [
        (0, [(0, 6, 1)], "x"), (1, [(0, 120_000, 3)], "a b c end"), (1, [(0, 120_000, 3)], "a b c end"),
        (2, [], "x x x x x"), (3, [(0, 9, 1)], "ä b"),
    ]
    assert periodic.find_runs(odd_docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(odd_docs, power=3)
