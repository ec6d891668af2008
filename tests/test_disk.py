"""What queries send and keep: shuffles freed with their job, lists as bytes, work in turns."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphslice.operators import centrality, neighborhood, views
from graphslice.plans import coding, workspace
from tests import brute
from tests.test_scale import random_edges


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_table_written_frees_its_shuffles(spark):
    before = shuffle_files(spark)
    folder = workspace.Workspace(spark, "test")
    found = folder.save(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert found.count() == 7 and spark.conf.get(workspace.FREE_SHUFFLES) == "false"


@pytest.mark.parametrize("sizes", [[], [1], [3, 1, 0, 40, 2]])
def test_lists_as_bytes(sizes):
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.integers(0, 1 << rng.integers(1, 50), n)) for n in sizes]
    flat, counts = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), np.array(sizes, np.int64)
    data, widths = coding.coded(coding.gaps(flat, counts))
    assert widths.sum() == len(data) and coding.summed(coding.decoded(data), counts).tolist() == flat.tolist()
    with pytest.raises(ValueError):
        coding.coded(np.array([3, -1]))


def test_vertex_numbers_are_dense_and_in_order(spark, graph_of):
    view = views.Undirected(graph_of(random_edges(4, [f"u_{i}" for i in range(500)], 900)), workspace.Workspace(spark, "test"))
    rows = views.number_vertices(view.degree(), view.workspace, "degree", "id").orderBy("vid").collect()
    assert [r.id for r in rows] == [r.id for r in sorted(rows, key=lambda r: (r.degree, r.id))]
    assert rows[-1].vid < 2 * len(rows) + 64 * 3


@pytest.mark.parametrize(("hot", "piece"), [("4000000", 1024), ("60", 4), ("3", 2)])
def test_hops_in_turns(graph_of, spark, monkeypatch, rows, hot, piece):
    """Two hops and blocks in several turns, with lists in pieces and wide origins beside them; no turn's rows are lost."""
    monkeypatch.setattr(neighborhood, "PIECE", piece)
    monkeypatch.setattr(neighborhood, "BLOCK", 1)
    monkeypatch.setattr(neighborhood, "ROUND_WALKS", 2_000)
    monkeypatch.setattr(neighborhood, "ROUND_HEARD", 1_000)
    monkeypatch.setattr(neighborhood, "DEALT_WALKS", 50)
    monkeypatch.setattr(neighborhood.skew, "SMALL_ROWS", 2_000)
    written, write = set(), workspace.Workspace.write

    def watched(self, df, name, *metrics):
        written.add(name)
        return write(self, df, name, *metrics)

    monkeypatch.setattr(workspace.Workspace, "write", watched)
    spark.conf.set("spark.graphslice.hotRows", hot)
    rng = random.Random(6)
    edges = random_edges(7, [f"u_{i}" for i in range(300)], 420) + [("u_0", f"u_{rng.randint(0, 299)}", 1.0, 0.5, 0) for _ in range(30)]
    try:
        for hops in (2, 3):
            assert dict(rows(neighborhood.khop_degree(graph_of(edges), hops))) == brute.khop_degrees(edges, hops)
    finally:
        spark.conf.unset("spark.graphslice.hotRows")
    assert {"heard-1", "wider-3-1"} <= written


def test_lists_are_dealt_without_a_join(graph_of, spark, monkeypatch):
    """Where every list is in one piece, those who ask are known from the list."""
    joins, join = [], neighborhood.skew.salted_join
    graph = neighborhood._Numbered(graph_of(random_edges(4, [f"u_{i}" for i in range(40)], 90)))
    monkeypatch.setattr(neighborhood.skew, "salted_join", lambda *a: joins.append(a) or join(*a))
    assert neighborhood._within(graph, 2, keep=False).others().count() == graph.numbers.count() and not joins


@pytest.mark.parametrize("hot", ["4000000", "50"])
def test_triangles_in_turns(graph_of, spark, monkeypatch, rows, hot):
    """Vertices are told in turns, lists in pieces among them, and tables that are done with are deleted."""
    monkeypatch.setattr(centrality, "PIECE", 4)
    monkeypatch.setattr(centrality, "ROUND_TOLD", 400)
    folders, write = {}, workspace.Workspace.write

    def watched(self, df, name, *metrics):
        folders[name] = self.path(name)
        return write(self, df, name, *metrics)

    monkeypatch.setattr(workspace.Workspace, "write", watched)
    spark.conf.set("spark.graphslice.hotRows", hot)
    core = [(f"u_{i}", f"u_{j}", 1.0, 0.5, 0) for i in range(16) for j in range(i)]
    edges = core + random_edges(2, [f"u_{i}" for i in range(60)], 150)
    try:
        assert dict(rows(centrality.triangle_count(graph_of(edges)))) == brute.triangles(edges)
    finally:
        spark.conf.unset("spark.graphslice.hotRows")
    assert "met-1" in folders
    assert os.path.exists(folders["numbers"]) and not any(os.path.exists(folders[n]) for n in ("pairs", "degrees", "ahead"))


def test_nothing_is_told_to_those_that_point_at_nobody(graph_of, spark, monkeypatch, rows):
    """Ten hubs joined with all others but not with each other: the lists of the others do not travel to them."""
    told, sent = [], centrality._sent
    monkeypatch.setattr(centrality, "_sent", lambda *a: told.append(sent(*a)) or told[-1])
    drop = workspace.Workspace.drop
    monkeypatch.setattr(workspace.Workspace, "drop", lambda self, *names: drop(self, *(n for n in names if n != "ahead")))
    edges = [(f"u_{i}", f"s_{j}", 1.0, 0.5, 0) for i in range(40) for j in range(10)]
    edges += [(f"u_{i}", f"u_{i + 1}", 1.0, 0.5, 0) for i in range(39)]
    assert dict(rows(centrality.triangle_count(graph_of(edges)))) == brute.triangles(edges)
    assert sum(t.count() for t in told) == 39


def test_pairs_are_stored_in_order(graph_of, spark):
    view = views.Undirected(graph_of(random_edges(4, [f"u_{i}" for i in range(50)], 300)), workspace.Workspace(spark, "test"))
    parts = view.pairs.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    found = [(r.file, r.a, r.b) for r in parts.orderBy("file", "at").collect()]
    assert found == sorted(found) and len(found) == view.pair_count
