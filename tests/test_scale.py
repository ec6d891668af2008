"""Operators on shapes that break plans made for even data: stars, dense cores, copies, long lists."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphslice.model import EDGE_SCHEMA
from graphslice.operators import centrality, dice, neighborhood, views
from graphslice.plans import batch, skew, workspace
from graphslice.sources import tables
from tests import brute


def random_edges(seed, names, count):
    rng = random.Random(seed)
    return [(rng.choice(names), rng.choice(names), float(rng.randint(1, 3)), 0.5, 0) for _ in range(count)]


def test_a_large_star(graph_of, spark):
    """24,000 leaves: 576 million walks, none of them listed."""
    n = 24_000
    leaves = spark.range(n).select(
        F.concat(F.lit("u_"), "id").alias("src"), F.lit("p_0").alias("dst"), F.lit(1.0).alias("score"),
        F.lit(0.5).alias("helpfulness"), F.lit(0).cast("long").alias("timestamp"),
    )
    graph = type(graph_of([]))(None, leaves)
    found = neighborhood.multi_hop_degree_distribution(graph, 2).collect()
    assert [tuple(r) for r in found] == [(n, n + 1)]


def test_sets_are_sought_around_the_origins_only(graph_of, spark):
    edges = random_edges(4, [f"u_{i}" for i in range(40)], 90)
    graph = neighborhood._Numbered(graph_of(edges))
    origins = graph.numbers.filter("id IN ('u_3', 'u_7')")
    asks = graph.asks(origins)
    assert {r.origin for r in asks.collect()} == {r.vid for r in origins.collect()}
    marks = spark.createDataFrame([("u_3",), ("u_7",), ("nobody",)], "id string")
    got = {tuple(r) for r in neighborhood.khop_pairs(graph_of(edges), 3, marks).collect()}
    assert got == {p for p in brute.khop_pairs(edges, 3) if p[0] in ("u_3", "u_7")}


def test_wide_origins_are_cut_by_walks(graph_of, spark, monkeypatch, rows):
    """Every origin has more walks than a task may take, and lists come in several pieces."""
    monkeypatch.setattr(neighborhood, "PIECE", 3)
    spark.conf.set("spark.graphslice.hotRows", "40")
    try:
        edges = random_edges(9, [f"u_{i}" for i in range(30)], 200)
        assert dict(rows(neighborhood.khop_degree(graph_of(edges), 2))) == brute.khop_degrees(edges, 2)
    finally:
        spark.conf.unset("spark.graphslice.hotRows")


def test_triangles_of_a_dense_core(graph_of, spark, monkeypatch, rows):
    monkeypatch.setattr(centrality, "PIECE", 4)
    spark.conf.set("spark.graphslice.hotRows", "50")
    try:
        core = [(f"u_{i}", f"u_{j}") for i in range(24) for j in range(i)]
        edges = [(a, b, 1.0, 0.5, 0) for a, b in core] + random_edges(2, [f"u_{i}" for i in range(60)], 150)
        assert dict(rows(centrality.triangle_count(graph_of(edges)))) == brute.triangles(edges)
    finally:
        spark.conf.unset("spark.graphslice.hotRows")


def test_core_numbers(graph_of, rows, monkeypatch):
    """Also by looking around changes only."""
    edges = random_edges(5, [f"u_{i}" for i in range(40)], 150)
    want = {}
    for k in range(1, 20):
        want.update(dict.fromkeys(brute.core(edges, k), k))
    monkeypatch.setattr(centrality, "FEW", 1)
    assert dict(rows(centrality.core_numbers(graph_of(edges)))) == want
    found = centrality.k_cores(graph_of(edges), 30)
    top = max(want.values())
    assert found.profile.count() == top + 1 and found.members.count() == 0
    changed = [r.changed for r in found.rounds.orderBy("round").collect()]
    assert changed[-1] == 0 and all(changed[:-1])


def test_late_rounds_of_cores_ask_where_a_value_falls(graph_of, all_hot, rows, monkeypatch):
    """Not around every change; lists come in several pieces, and almost every vertex is hot."""
    monkeypatch.setattr(centrality, "FEW", 1)
    monkeypatch.setattr(skew, "PIECE", 2)
    asked, lowered = [], centrality._lowered

    def spied(values, counted):
        asked.append(counted.select("id").distinct().count())
        return lowered(values, counted)

    monkeypatch.setattr(centrality, "_lowered", spied)
    pairs = [(i, j) for i in range(6) for j in range(i)] + [(i, i + 1) for i in range(5, 11)] + [(1, 1)]
    edges = [(f"u_{a}", f"u_{b}", 1.0, 0.5, 0) for a, b in pairs]  # a clique with a tail, which falls from its end
    found = centrality.k_cores(graph_of(edges), 4)
    changed = [r.changed for r in found.rounds.orderBy("round").collect()]
    assert len(changed) > 2 and asked[1:] == changed[1:-1]
    for k, vertices, ends in rows(found.profile, "k", "core_vertices", "core_edges"):
        alive = brute.core(edges, k)
        assert (vertices, ends) == (len(alive), sum(map(len, alive.values())) // 2)
    assert dict(rows(found.members)) == {v: len(n) for v, n in brute.core(edges, 4).items()}


@pytest.mark.parametrize("n", [1, 7, 100, 250, 301])
def test_the_first_edges_in_order(spark, monkeypatch, n):
    monkeypatch.setattr(tables, "SHORT_LIST", 5)
    monkeypatch.setattr(tables, "COPIES", 4)
    monkeypatch.setattr(skew, "SMALL_ROWS", 10)
    edges = random_edges(6, [f"u_{i}" for i in range(15)], 200) + [("u_4", "u_4", 1.0, 0.5, 0)] * 100
    table = spark.createDataFrame(edges, EDGE_SCHEMA)
    assert sorted(map(tuple, tables.cap_edges(table, n).collect())) == sorted(edges)[:n]


def test_quantiles_by_counts(spark, monkeypatch):
    monkeypatch.setattr(batch, "PARTS", 40)
    rng = random.Random(1)
    values = [("a", rng.randint(-50, 1000)) for _ in range(101)] + [("b", 5)] * 40 + [("c", -7)]
    values += [("d", rng.choice([1, 10**6])) for _ in range(30)] + [(None, 3), (None, 4), ("a", None)]
    table = spark.createDataFrame(values, "name string, x long")
    for q in (0.5, 0.9):
        got = dict(map(tuple, batch.exact_quantiles(table, "name", "x", q).collect()))
        for name in {n for n, _ in values}:
            own = [x for n, x in values if n == name and x is not None]
            assert got[name] == pytest.approx(np.quantile(own, q), rel=1e-12)
    assert batch.exact_quantiles(table.limit(0), "name", "x", 0.5).count() == 0


def test_an_open_slice_owns_its_tables(spark, graph_of, monkeypatch, tmp_path):
    """Pairs are written once a slice and measure; nothing is left behind."""
    written, write = [], workspace.Workspace.write

    def watched(self, df, name, *metrics):
        written.append((self.root, name))
        return write(self, df, name, *metrics)

    monkeypatch.setattr(workspace.Workspace, "write", watched)
    graph = graph_of(random_edges(3, [f"u_{i}" for i in range(12)] + [f"p_{i}" for i in range(8)], 80))
    slices = {"all": dice.dice_all(graph), "low": dice.dice_score(graph, 1, 2)}
    plan = [
        ("all", "multiHopDegreeDistribution", {"hops": 2}),
        ("all", "shortestPathMetrics", {"landmarks": 2}),
        ("all", "kCoreDecomposition", {"maxK": 3}),
        ("low", "localClusteringCoefficient", {}),
        ("low", "egoNetworkAggregation", {"topN": 3}),
        ("low", "kCoreDecomposition", {"maxK": 3}),
    ]
    before = list(workspace._roots)
    stored = batch.store_batch(slices, plan, str(tmp_path))
    assert sum(name == "pairs" for _, name in written) == 3  # one for each slice, one with scores
    assert workspace._roots == before
    made = {root for root, _ in written}
    for root in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    profile = stored["kCoreDecomposition", "profile"]
    for name, cut in slices.items():
        want = centrality.k_cores(cut, 3).profile.collect()
        got = profile.filter(F.col("slice") == name).drop("slice").orderBy("k").collect()
        assert [r[:3] for r in got] == [r[:3] for r in want]


def test_nested_blocks_share_until_the_last_ends(spark, graph_of):
    cut = dice.dice_all(graph_of(random_edges(3, [f"u_{i}" for i in range(9)], 30)))
    with cut.open():
        with cut.open():
            first = views.Undirected(cut, workspace.Workspace(spark, "one"))
        second = views.Undirected(cut, workspace.Workspace(spark, "two"))
        assert second.pairs is first.pairs and not second.owner
        second.drop()
        assert second.pairs.count() == first.pair_count
    assert views.Undirected(cut, workspace.Workspace(spark, "three")).owner


@pytest.mark.parametrize("hot", ["4000000", "60", "3"])
def test_far_sets_are_united_by_block(graph_of, spark, monkeypatch, rows, hot):
    """Three hops and more list no pairs; blocks of several words and parts, vertices across the parts of a task."""
    monkeypatch.setattr(neighborhood, "BLOCK", 2)
    monkeypatch.setattr(neighborhood, "AT_ONCE", 7)
    monkeypatch.setattr(neighborhood, "_unpack", None)
    spark.conf.set("spark.graphslice.hotRows", hot)
    try:
        edges = random_edges(7, [f"u_{i}" for i in range(300)], 420) + [("u_1", "u_1", 1.0, 0.5, 0)]
        for hops in (3, 4):
            assert dict(rows(neighborhood.khop_degree(graph_of(edges), hops))) == brute.khop_degrees(edges, hops)
    finally:
        spark.conf.unset("spark.graphslice.hotRows")


def test_ranks_that_cannot_change_are_not_computed_again(spark, graph_of, monkeypatch):
    """Users give to products, products to nobody: two rounds settle all; a cycle goes on."""
    written, write = [], workspace.Workspace.write

    def watched(self, df, name, *metrics):
        written.append(name)
        return write(self, df, name, *metrics)

    monkeypatch.setattr(workspace.Workspace, "write", watched)
    rng = random.Random(8)
    reviews = [(f"u_{rng.randint(0, 9)}", f"p_{rng.randint(0, 9)}", 1.0, 0.5, 0) for _ in range(60)]
    for edges, last in ((reviews, 2), (reviews + [("p_1", "u_1", 1.0, 0.5, 0)], 6)):
        written.clear()
        got = {r.id: r.pagerank for r in centrality.page_rank(graph_of(edges), 6).collect()}
        assert max(int(name[5:]) for name in written if name.startswith("rank-")) == last
        ends = {end for edge in edges for end in edge[:2]}
        rank, given = dict.fromkeys(ends, 1.0), {}
        for edge in edges:
            given[edge[0]] = given.get(edge[0], 0) + 1
        for _ in range(6):
            income = dict.fromkeys(ends, 0.0)
            for edge in edges:
                income[edge[1]] += rank[edge[0]] / given[edge[0]]
            rank = {end: 0.15 + 0.85 * income[end] for end in ends}
        scale = len(rank) / sum(rank.values())
        assert got == pytest.approx({end: r * scale for end, r in rank.items()}, rel=1e-12)


def test_slices_read_reviews_that_are_written_once(graph_of):
    from catalog import queries

    graph = graph_of(random_edges(3, [f"u_{i}" for i in range(9)] + [f"p_{i}" for i in range(5)], 90))
    cuts = queries._slices(graph)
    assert sorted(cuts["apex"].edges.collect()) == sorted(graph.edges.collect())
    for cut in cuts.values():
        assert any("/reviews/" in name for name in cut.edges.inputFiles())


def test_a_small_network_is_sent_to_the_pairs(graph_of, all_hot, spark, monkeypatch, rows):
    """Pairs stay where they are, those of hot vertices too, unless the members are too many to send."""
    edges = random_edges(8, [f"u_{i}" for i in range(30)], 120)
    adj = brute.neighbours(edges)
    scored = {v: {(w, e[2]) for e in edges for w in (e[:2] if v in e[:2] else ()) if w != v or e[0] == e[1]} for v in adj}
    around = {hub: adj[hub] | {hub} for hub in brute.top(scored, 2)}
    want = {(h, min(a, b), max(a, b), s) for a, b, s, *_ in edges for h, near in around.items() if {a, b} <= near}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = neighborhood.EgoNetworks(graph_of(edges), 2).internal_pairs()
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(want) == rows(found, "ego", "a", "b", "score")
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
        assert sorted(want) == rows(neighborhood.EgoNetworks(graph_of(edges), 2).internal_pairs(), "ego", "a", "b", "score")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_degrees_are_counted_once(graph_of, all_hot, spark):
    edges = random_edges(3, [f"u_{i}" for i in range(20)], 60)
    view = views.Undirected(graph_of(edges), workspace.Workspace(spark, "test"))
    want = {v: len(near) for v, near in brute.neighbours(edges).items()}
    assert all("/degrees/" in file for file in view.degree().inputFiles())
    assert dict(map(tuple, view.degree().collect())) == want
    fans = {v: -(-n // 3) for v, n in want.items() if n > 3}
    assert dict(map(tuple, view.hot.collect())) == fans


@pytest.mark.parametrize("near", [40, 4000])
def test_sets_of_two_hops_are_counted_where_they_are_united(near):
    """Dense and sparse lists are united to the same sets, and where only their size is wanted, that alone leaves the task."""
    rng = np.random.default_rng(near)
    heard = [sorted(set(rng.integers(0, 9, 4).tolist())) for _ in range(30)]
    lists = [sorted(set(rng.integers(0, near, 25).tolist())) for _ in range(30)]
    table = pa.table({"origins": pa.array(heard, pa.list_(pa.int64())), "dsts": pa.array(lists, pa.list_(pa.int64()))})
    want = {o: {v for who, ws in zip(heard, lists, strict=True) if o in who for v in ws} for o in range(9)}
    whole, counted = (neighborhood._unite(table, keep=keep).to_pylist() for keep in (True, False))
    for row, alone in zip(whole, counted, strict=True):
        bits = {w * 64 + i for w, m in zip(row["words"], row["masks"], strict=True) for i in range(64) if m >> i & 1}
        assert bits == want[row["origin"]] and row["others"] == len(bits - {row["origin"]})
        assert alone == {"origin": row["origin"], "others": row["others"], "words": [], "masks": []}


def test_two_hop_degrees_bring_no_sets(graph_of):
    graph = neighborhood._Numbered(graph_of(random_edges(4, [f"u_{i}" for i in range(40)], 90)))
    assert neighborhood._within(graph, 2, keep=False).sets.filter("size(words) > 0").count() == 0
    assert neighborhood._within(graph, 2).sets.filter("size(words) > 0").count() > 0
