"""Collision counting against all inner products, and on odd and empty tables."""

import math

import numpy as np
import pytest

from graphslice.llm import nearest, queries

SF_DIR = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int, row string, score double"


@pytest.fixture(scope="module")
def vectors_of(spark):
    return lambda rows: spark.createDataFrame([(i, v, 1, "clash", 0.5) for i, v in rows], VECTORS)


def exact(rows, query_place, k):
    """Ids of the ``k`` nearest, and scores; ``rows`` are (id, vector)."""
    query = np.array(rows[query_place][1], float)
    scored = [
        (-float((np.array(v, float) * query).sum()), math.inf if i is None else i, place)
        for place, (i, v) in enumerate(rows)
        if place != query_place
    ]
    return [(place, -score) for score, _, place in sorted(scored)[:k]]


def found(vectors, k):
    index = nearest.Index(vectors)
    return index.search(index.rows.where("vec_id % 20 = 0"), k).collect()


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    results = {}
    for r in queries.op12_collision_counting(spark, SF_DIR).collect():
        results.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i, (vec_id, _) in enumerate(rows) if vec_id % 20 == 0]
    assert len(results) == len(asked)
    hits = total = 0
    for place in asked:
        want = {rows[p][0]: score for p, score in exact(rows, place, 20)}
        got = sorted(results[rows[place][0]])
        assert [rank for rank, _, _ in got] == list(range(1, 21))
        assert [s for _, _, s in got] == sorted((s for _, _, s in got), reverse=True)
        hits += len(want.keys() & {i for _, i, _ in got})
        total += len(want)
        for _, i, score in got:
            assert i != rows[place][0] and (i not in want or score == pytest.approx(want[i], abs=1e-12))
    assert hits / total >= 0.9


@pytest.mark.parametrize("stretch", [0.0, 1.0])
def test_recall_over_shards(spark, vectors_of, monkeypatch, stretch):
    """Vectors of different lengths, in clusters, several shards and blocks."""
    monkeypatch.setattr(nearest, "SHARD", 300)
    monkeypatch.setattr(nearest, "BLOCK", 20)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 24))
    data = centres[draw.integers(0, 12, 1000)] + 0.4 * draw.normal(size=(1000, 24))
    data *= np.exp(stretch * draw.normal(size=(1000, 1)))
    rows = list(enumerate(data.tolist()))
    got = {}
    for r in found(vectors_of(rows), 10):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len({rows[p][0] for p, _ in exact(rows, q, 10)} & got[q]) for q in range(0, 1000, 20))
    assert len(got) == 50 and hits / 500 >= 0.9


def test_ties_go_to_the_smaller_id(vectors_of):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(None, [1.0, 2.0])]
    for r in found(vectors_of(rows), 5):
        best = [i for i in range(7) if i != r["query_id"]][:5]
        assert r["vec_id"] == best[r["rank"] - 1] and r["score"] == 5.0


def test_fewer_than_asked_for_are_all_found(vectors_of):
    rows = [(20, [1.0, 0.0]), (21, [-1.0, 0.0]), (22, [0.0, 3.0]), (None, [0.5, 0.5])]
    assert [(r["vec_id"], r["score"]) for r in sorted(found(vectors_of(rows), 9), key=lambda r: r["rank"])] == [
        (None, 0.5), (22, 0.0), (21, -1.0),
    ]


def test_odd_vectors(vectors_of):
    bad = [None, [], [0.0, 0.0], [1.0, None], [math.nan, 1.0], [math.inf, 1.0]]
    rows = [(20 * i, v) for i, v in enumerate(bad)] + [(200, [1.0, 1.0]), (200, [1.0, 1.0]), (201, [2.0]), (203, [0.0, 0.0, 5.0])]
    results = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found(vectors_of(rows), 3))
    assert results == [(200, 1, 200, 2.0), (200, 1, 200, 2.0), (200, 2, 201, 2.0), (200, 2, 201, 2.0),
                       (200, 3, 203, 0.0), (200, 3, 203, 0.0)]
    assert found(vectors_of([(20, None)]), 3) == [] and found(vectors_of(rows).limit(0), 3) == []


def test_queries_from_outside(spark, vectors_of):
    index = nearest.Index(vectors_of([(i, [float(i), 1.0]) for i in range(1, 9)]))
    asked = spark.createDataFrame([(-1, 77, [1.0, 0.0])], "row long, vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in index.search(asked, 2).orderBy("rank").collect()] == [(77, 8), (77, 7)]


def test_windows_that_are_enough():
    hit = math.erf(nearest.WIDTH / 2 / math.sqrt(2))
    least = nearest.enough(nearest.LINES, nearest.WIDTH, nearest.MISS)
    drawn = np.random.default_rng(1).binomial(nearest.LINES, hit, 200_000)
    assert (drawn < least).mean() <= nearest.MISS < (drawn < least + 1).mean()
