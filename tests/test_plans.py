"""The shape of plans, and where tables go."""

import pytest

from graphslice.operators import dice, neighborhood, views
from graphslice.plans import skew, workspace
from graphslice.plans.workspace import Workspace, shared_folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_expand_moves_only_the_other_side(spark, hand, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_ROWS", 1)  # lay this small graph out like a large one
    view = views.Undirected(hand, Workspace(spark, "plan"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with view.adjacency() as adjacency:
            adjacency.rows.count()
            text = plan(adjacency.expand(view.degree().select("id")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = text.split("InMemoryRelation")[0]
    right = top[top.index("SortMergeJoin") :].split("InMemoryTableScan")[0].splitlines()[-3:]
    assert not any("Exchange" in line or "Sort [" in line for line in right), top


def test_filters_and_columns_reach_the_scan(spark, hand, tmp_path):
    path = str(tmp_path / "edges")
    hand.edges.write.parquet(path)
    from graphslice.model import PropertyGraph

    stored = PropertyGraph.from_edges(spark.read.parquet(path))
    text = plan(neighborhood.multi_hop_degree_distribution(dice.dice_score(stored, 4, 5), 1))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(score,4.0)" in scan
    assert "ReadSchema: struct<src:string,dst:string,score:double>" in scan


def test_counts_combine_before_the_exchange(hand):
    text = plan(neighborhood.rating_summary(hand, 1))
    assert "partial_count(1)" in text and text.index("functions=[count(1)") < text.index("partial_count(1)")


def test_hot_limit_bounds_the_number_of_hot_keys(spark):
    assert skew.hot_rows(spark) == skew.DEFAULT_HOT_ROWS
    huge = 10**13
    assert huge / skew.hot_rows(spark, huge) <= skew.BROADCAST_ROWS
    assert skew.partitions_for(spark, 4e9) == 1000
    assert skew.partitions_for(spark, 10) == 1
    assert skew.partitions_for(spark, 1e7) == int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Elsewhere:
    """A session on a cluster, as far as the folder choice can see."""

    def __init__(self, folder):
        self.folder, self.conf, self.sparkContext, self.master = folder, self, self, "yarn"

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):  # noqa: N802  as the context names it
        return None


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder(_Elsewhere("hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_folder(_Elsewhere(None))


def test_tables_can_be_released(spark, tmp_path):
    space = Workspace(spark, "mine")
    kept = space.save(spark.range(5), "five")
    assert kept.count() == 5
    before = list(workspace._roots)
    workspace._roots[:] = [space.root]
    workspace.release(spark)
    workspace._roots[:] = [r for r in before if r != space.root]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        space.read("five").count()
