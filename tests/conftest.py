import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from graphslice.model import EDGE_SCHEMA, PropertyGraph  # noqa: E402
from graphslice.plans.workspace import release  # noqa: E402
from graphslice.session import build_session  # noqa: E402

HAND_EDGES = [
    ("u_1", "p_1", 5.0, 1.0, 10),
    ("u_1", "p_1", 3.0, 0.5, 20),
    ("u_1", "p_2", 4.0, 0.0, 30),
    ("u_2", "p_1", 5.0, 0.8, 40),
    ("u_3", "p_2", 1.0, 0.2, 50),
    ("u_4", "p_3", 2.0, None, 60),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", master="local[4]", spark__sql__shuffle__partitions="3", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def graph_of(spark):
    def build(rows):
        rows = [tuple(r) + (1.0, 0.5, 0)[len(r) - 2 :] if len(r) < 5 else tuple(r) for r in rows]
        return PropertyGraph.from_edges(spark.createDataFrame(rows, EDGE_SCHEMA))

    return build


@pytest.fixture(scope="session")
def hand(graph_of):
    return graph_of(HAND_EDGES)


@pytest.fixture()
def all_hot(spark):
    """Make almost every vertex hot, so the salted and hub paths run."""
    spark.conf.set("spark.graphslice.hotRows", "3")
    yield
    spark.conf.unset("spark.graphslice.hotRows")


@pytest.fixture()
def rows():
    def collect(df, *columns):
        return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())

    return collect
