"""Every output on a graph small enough to work out by hand."""

import pytest

from graphslice.model import GraphSlice, PropertyGraph
from graphslice.operators import centrality, dice, neighborhood, paths, views
from graphslice.plans import batch


def test_vertices_and_summary(hand, rows):
    labels = [(f"p_{i}", "Product") for i in (1, 2, 3)] + [(f"u_{i}", "User") for i in (1, 2, 3, 4)]
    assert rows(hand.vertices) == labels
    assert rows(hand.summary()) == [("Product", 3), ("User", 4), ("edges", 6), ("vertices", 7)]


def test_dices(hand, rows):
    assert len(rows(dice.dice_score(hand, 4, 5).edges)) == 3
    assert [r[4] for r in dice.dice_time(hand, 20, 40).edges.orderBy("timestamp").collect()] == [20, 30, 40]
    quality = dice.dice_helpfulness(hand, 0.5)
    assert rows(quality.vertices, "id") == [("p_1",), ("u_1",), ("u_2",)]
    # Popularity counts reviews, so the repeat makes p_1 the only one with three.
    assert rows(dice.dice_popularity(hand, 3).vertices, "id") == [("p_1",), ("u_1",), ("u_2",)]
    assert dice.dice_all(hand).edges is hand.edges


def test_dice_popularity_with_hot_products(hand, rows, all_hot, spark):
    spark.conf.set("spark.graphslice.hotRows", "1")
    assert len(rows(dice.dice_popularity(hand, 2).edges)) == 5
    assert len(rows(dice.dice_popularity(hand, 3).edges)) == 3


def test_dices_chain_and_keep_their_names(hand, rows):
    cut = dice.dice_helpfulness(dice.dice_score(dice.dice_popularity(hand, 2), 3, 5), 0.5)
    assert cut.description == "productReviews>=2 & score=[3.0,5.0] & helpfulness>=0.50"
    assert rows(cut.size()) == [(3, 3)]
    assert dice.dice_all(hand).description == "all"
    assert dice.dice_sample(hand, 0.25, 1).description == "sample=0.2500"
    assert dice.dice_time(hand, 1, 2).description == "time=[1,2]"
    # Score and quality commute; popularity sees what the dice before it left.
    one = dice.dice_score(dice.dice_helpfulness(hand, 0.5), 3, 5).edges
    other = dice.dice_helpfulness(dice.dice_score(hand, 3, 5), 0.5).edges
    assert rows(one) == rows(other)
    assert rows(dice.dice_popularity(dice.dice_score(hand, 3, 3), 2).edges) != rows(
        dice.dice_score(dice.dice_popularity(hand, 2), 3, 3).edges
    )
    twice = dice.dice_score(dice.dice_score(hand, 4, 5), 4, 5)
    assert rows(twice.edges) == rows(dice.dice_score(hand, 4, 5).edges)


def test_samples(hand, rows):
    full = rows(hand.edges.fillna(0.0))
    for cut in (dice.dice_sample(hand, 0.5, 7), dice.dice_sample(hand, 0.5, 8)):
        kept = rows(cut.edges.fillna(0.0))
        assert set(kept) <= set(full)
        ends = {r[0] for r in kept} | {r[1] for r in kept}
        assert {r[0] for r in rows(cut.vertices)} == ends
    assert rows(dice.dice_sample(hand, 1.0, 7).edges.fillna(0.0)) == full
    assert rows(dice.dice_sample(hand, 0.0, 7).edges) == []


def test_a_sample_does_not_depend_on_the_layout(spark, graph_of, rows):
    edges = [("u_1", "p_1", 5.0, 1.0, 7)] * 40 + [(f"u_{i}", f"p_{i % 9}", 1.0, 0.5, i) for i in range(300)]
    graph = graph_of(edges)
    found = [
        rows(dice.dice_sample(PropertyGraph.from_edges(graph.edges.repartition(n)), 0.3, 7).edges) for n in (1, 3, 11)
    ]
    assert found[0] == found[1] == found[2]
    assert 0 < sum(r[0] == "u_1" and r[4] == 7 for r in found[0]) < 40  # equal reviews are drawn one by one


def test_time_dice_on_a_stored_graph_in_another_zone(spark, graph_of, rows, tmp_path):
    from graphslice.sources.tables import read_graph, write_graph

    ends_of_years = [("u_1", "p_1", 5.0, 1.0, 946684799), ("u_1", "p_2", 5.0, 1.0, 946684800), ("u_2", "p_2", 1.0, 1.0, 10**14)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        write_graph(graph_of(ends_of_years), str(tmp_path / "g"), by_year=True)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        stored = read_graph(spark, str(tmp_path / "g"))
        assert rows(dice.dice_time(stored, 946684800, 946684900).edges, "dst") == [("p_2",)]
        assert rows(dice.dice_time(stored, 946684799, 10**15).edges, "src") == [("u_1",), ("u_1",), ("u_2",)]
        assert rows(read_graph(spark, str(tmp_path / "g"), max_edges=1).vertices, "id") == [("p_1",), ("u_1",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_release_keeps_the_base_cached(hand):
    hand.edges.persist()
    try:
        with dice.dice_all(hand).cached() as apex:
            assert apex.edges.is_cached
        assert hand.edges.storageLevel.useMemory
        with dice.dice_score(hand, 4, 5).cached() as cut:
            assert cut.edges.storageLevel.useMemory
        assert not cut.edges.storageLevel.useMemory
    finally:
        hand.edges.unpersist()


def test_views(hand, rows):
    pairs = {("u_1", "p_1"), ("u_1", "p_2"), ("u_2", "p_1"), ("u_3", "p_2"), ("u_4", "p_3")}
    assert set(rows(views.undirected_edges(hand))) == pairs | {(b, a) for a, b in pairs}
    assert len(rows(views.undirected_scored(hand))) == 12
    assert rows(views.top_hubs(hand, 2)) == [("p_1", 2), ("p_2", 2)]
    assert rows(views.top_hubs_by_label(hand, 1)) == [("Product", "p_1", 2), ("User", "u_1", 2)]


def test_multi_hop(hand, rows):
    assert rows(neighborhood.multi_hop_degree_distribution(hand, 1)) == [(1, 4), (2, 3)]
    # u_1 reaches all but itself of its component; u_4 and p_3 only each other.
    assert rows(neighborhood.khop_degree(hand, 2)) == [
        ("p_1", 3), ("p_2", 3), ("p_3", 1), ("u_1", 4), ("u_2", 2), ("u_3", 2), ("u_4", 1),
    ]


def test_ego(hand, rows):
    got = neighborhood.ego_network_aggregation(hand, 1).collect()
    # By (neighbour, score) rows u_1 and p_1 tie at three; p_1 has the smaller id.
    assert [tuple(r) for r in got] == [("p_1", 3, 6, 4.333, 3.0, 5.0, 1.0)]


def test_ego_of_a_loop_has_no_density(graph_of, rows):
    loop = graph_of([("u_1", "u_1", 4.0, 0.5, 0)])
    assert rows(neighborhood.ego_network_aggregation(loop, 1)) == [("u_1", 1, 1, 4.0, 4.0, 4.0, None)]
    assert rows(neighborhood.khop_degree(loop, 1)) == rows(neighborhood.khop_degree(loop, 2)) == []


def test_rating_summary(hand):
    got = [tuple(r) for r in neighborhood.rating_summary(hand, 1).collect()]
    assert got == [
        ("p_1", 3, 4.333, 1.155, 3.0, 5.0, 0.767),
        ("p_2", 2, 2.5, 2.121, 1.0, 4.0, 0.1),
        ("p_3", 1, 2.0, None, 2.0, 2.0, None),
    ]


def test_paths(hand, rows):
    found = paths.shortest_path_metrics(hand, 1)  # from p_1
    assert rows(found.histogram) == [(0, 1), (1, 2), (2, 1), (3, 1)]
    assert rows(found.per_landmark) == [("p_1", 5, 1.4, 3)]
    reach = paths.reachability(hand, 1, 9)
    assert rows(reach.curve) == [(1, 3), (2, 4), (3, 5), (4, 5)]
    lengths = paths.path_length_distribution(hand, 2)  # u_1, u_2 to p_1, p_2
    assert rows(lengths.distribution) == [(1, 3), (3, 1)]
    assert rows(lengths.summary) == [(4, 1.5, 1, 3)]


def test_given_landmarks_and_maps(hand, rows, spark):
    marks = spark.createDataFrame([("u_4",), ("nobody",)], "id string")
    found = paths.distances(hand, marks)
    assert rows(found) == [("u_4", "p_3", 1), ("u_4", "u_4", 0)]
    maps = {r.id: r.distances for r in paths.distance_maps(found).collect()}
    assert maps == {"p_3": {"u_4": 1}, "u_4": {"u_4": 0}}


def test_clustering(hand, graph_of, rows):
    found = centrality.local_clustering_coefficient(hand)
    assert rows(found.summary) == [(7, 0.0, 0.0, 0)]
    triangle = graph_of([("u_1", "p_1"), ("p_1", "s_1"), ("s_1", "u_1"), ("u_2", "p_1")])
    found = centrality.local_clustering_coefficient(triangle)
    assert rows(found.per_vertex) == [
        ("p_1", 1, 3, 0.333333), ("s_1", 1, 2, 1.0), ("u_1", 1, 2, 1.0), ("u_2", 0, 1, 0.0),
    ]
    assert [r.id for r in found.top.collect()] == ["s_1", "u_1", "p_1", "u_2"]


def test_cores(hand, rows):
    found = centrality.k_cores(hand, 5)
    assert rows(found.profile, "k", "core_vertices", "core_edges") == [(1, 7, 5), (2, 0, 0)]
    assert rows(found.members) == []


def test_page_rank_known_values(graph_of, rows):
    graph = graph_of([("u_1", "p_11"), ("u_1", "p_11"), ("u_1", "p_12"), ("u_2", "p_11"), ("u_3", "p_12")])
    first = dict(rows(centrality.page_rank(graph, 1), "id", "pagerank"))
    assert first == pytest.approx(
        {"u_1": 0.227273, "u_2": 0.227273, "u_3": 0.227273, "p_11": 2.373737, "p_12": 1.944444}, abs=1e-6
    )
    later = dict(rows(centrality.page_rank(graph, 5), "id", "pagerank"))
    assert later == pytest.approx(
        {"u_1": 0.662252, "u_2": 0.662252, "u_3": 0.662252, "p_11": 1.600442, "p_12": 1.412804}, abs=1e-6
    )
    cycle = graph_of([("1", "2"), ("2", "3"), ("3", "1"), ("3", "4")])
    ranks = dict(rows(centrality.page_rank(cycle, 10), "id", "pagerank"))
    assert ranks == pytest.approx({"1": 0.848884, "2": 1.068921, "3": 1.23331, "4": 0.848884}, abs=1e-6)
    assert sum(ranks.values()) == pytest.approx(4)


def test_empty_slice(hand, rows):
    empty = dice.dice_score(hand, 9, 9)
    assert rows(empty.size()) == [(0, 0)]
    for query, params in {
        "multiHopDegreeDistribution": {"hops": 2},
        "egoNetworkAggregation": {"topN": 3},
        "ratingSummary": {"minReviews": 1},
        "shortestPathMetrics": {"landmarks": 2},
        "reachabilityCounts": {"seeds": 2, "maxHops": 2},
        "pathLengthDistribution": {"subsetSize": 2},
        "pageRankAggregation": {"iterations": 3},
    }.items():
        for name, df in batch.evaluate(empty, query, **params).items():
            assert df.count() == 0, (query, name)
    assert rows(centrality.k_cores(empty, 3).profile, "k", "core_vertices") == [(1, 0)]
    assert rows(centrality.local_clustering_coefficient(empty).summary, "vertices") == [(0,)]


def test_slice_of_a_slice_is_a_slice(hand):
    assert isinstance(dice.dice_score(GraphSlice(hand, ("x",)), 1, 5), GraphSlice)
    assert dice.dice_score(GraphSlice(hand, ("x",)), 1, 5).predicates[0] == "x"
