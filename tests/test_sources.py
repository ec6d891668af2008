"""Raw reviews, CSV and Parquet in and out."""

import gzip
import math
import random
from fractions import Fraction

import pytest

from graphslice.functions import measures
from graphslice.operators import dice
from graphslice.plans import batch
from graphslice.plans.workspace import Workspace
from graphslice.sources import reviews, tables
from pyspark.sql import functions as F


def record(product, user, name="n", helpfulness="1/1", score="5.0", time="1", **more):
    lines = [
        f"product/productId: {product}",
        f"review/userId: {user}",
        f"review/profileName: {name}",
        f"review/helpfulness: {helpfulness}",
        f"review/score: {score}",
        f"review/time: {time}",
        *(f"review/{k}: {v}" for k, v in more.items()),
    ]
    return "\n".join(lines)


RAW = "".join(
    [
        record("A", "x", "José: the first", "1/32", "4.0", "100", text="a: b\tc") + "\n \t\n",
        record("B", "x", "another name", "0/0", "x", "12.5") + "\n\n\n\n",
        record("A", "y", "Y", "3", "", "7") + "\n\n",
        record("A", "unknown") + "\n\n",
        record("", "z") + "\n\n",
        record("A", "") + "\n\n",
        "review/userId: only a user\n\n",
        record("C", "w", "W", "x/2", " 2.0 ", " 9 ") + "\nreview/score: 3.0\nno key here\n\n",
        record("D", "v", "V", "1/160", "1e0", "-5"),
    ]
)
EDGES = [
    ("u_v", "p_D", 1.0, 0.0063, -5),
    ("u_w", "p_C", 3.0, 0.0, 9),
    ("u_x", "p_A", 4.0, 0.0312, 100),
    ("u_x", "p_B", 0.0, 0.0, 0),
    ("u_y", "p_A", 0.0, 0.0, 7),
]
NAMES = [("u_v", "V"), ("u_w", "W"), ("u_x", "José: the first"), ("u_y", "Y")]


@pytest.mark.parametrize("form", ["plain", "gzip", "crlf"])
def test_raw_reviews(spark, tmp_path, rows, form):
    data = RAW.encode("latin-1")
    path = str(tmp_path / "reviews.txt")
    if form == "gzip":
        path += ".gz"
        with gzip.open(path, "wb") as out:
            out.write(data)
    else:
        if form == "crlf":
            data = data.replace(b"\n", b"\r\n")
        with open(path, "wb") as out:
            out.write(data)
    graph = reviews.read_review_graph(spark, path)
    assert rows(graph.edges) == EDGES
    users = graph.vertices.filter("label = 'User'")
    assert rows(users, "id", "name") == NAMES
    products = graph.vertices.filter("label = 'Product'")
    assert rows(products, "id", "name") == [(f"p_{x}", "") for x in "ABCD"]
    high = dice.dice_score(graph, 3.5, 5.0)  # the vertices keep their names
    assert rows(high.vertices, "id", "name") == [("p_A", ""), ("u_x", "José: the first")]


def test_a_folder_of_all_forms(spark, tmp_path, rows):
    """Files that end lines differently, one compressed, one that mixes ends; empty and blank files too."""
    folder = tmp_path / "reviews"
    folder.mkdir()
    forms = [("\n", "a.txt"), ("\r\n", "b.txt"), ("\r", "c.txt")]
    for end, name in forms:
        text = RAW.replace("x", name[0]).encode("latin-1").replace(b"\n", end.encode())
        (folder / name).write_bytes(text)
    with gzip.open(folder / "d.txt.gz", "wb") as out:
        out.write(RAW.replace("x", "d").encode("latin-1"))
    (folder / "e.txt").write_bytes(b"product/productId: E\r\nreview/userId: e\nreview/score: 2\r\n\n\r\n")
    (folder / "f.txt").write_bytes(b"")
    (folder / "g.txt").write_bytes(b"\n\r\n \n")
    graph = reviews.read_review_graph(spark, str(folder))
    users = {r[0] for r in rows(graph.edges, "src")}
    assert users == {"u_v", "u_w", "u_y", "u_a", "u_b", "u_c", "u_d", "u_e"}
    assert graph.edges.count() == 4 * len(EDGES) + 1
    assert rows(graph.edges.filter("src = 'u_b'")) == [("u_b", d, *m) for s, d, *m in EDGES if s == "u_x"]


@pytest.mark.parametrize("size", [61, 400])
def test_records_across_splits(spark, tmp_path, rows, size):
    """Splits shorter than a record, within lines, blank lines and line ends."""
    path = str(tmp_path / "cut.txt")
    with open(path, "wb") as out:
        for i in range(12):
            ends = (b"\r\n", b"\n")[i % 2]
            out.write(record(f"P{i}", f"U{i}", f"name {i}", score="3.0").encode().replace(b"\n", ends) + ends * (2 + i % 3))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = reviews.read_records(spark, path)
        got = sorted((r["ord"]["start"], r["ord"]["number"], r["user"], r["product"], r["name"], r["time"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [g[2:] for g in got] == [(f"U{i}", f"P{i}", f"name {i}", "1") for i in range(12)]


def test_first_name_holds_when_a_file_is_split(spark, tmp_path, rows):
    path = str(tmp_path / "many.txt")
    with open(path, "w", encoding="latin-1") as out:
        for i in range(3000):
            out.write(record(f"P{i % 7}", f"U{i % 50}", f"name {i:05d}") + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        graph = reviews.read_review_graph(spark, path)
        assert graph.edges.rdd.getNumPartitions() > 3
        assert graph.edges.count() == 3000
        users = graph.vertices.filter("label = 'User'")
        assert rows(users, "id", "name") == sorted((f"u_U{i}", f"name {i:05d}") for i in range(50))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def number(text):
    """The double that a text names; None if it names none."""
    try:
        return float(text)
    except ValueError:
        return None


def rounded_ratio(text):
    """The rule of the raw format: the nearest four-digit decimal to the double quotient, a tie to the even one."""
    parts = [number(part) for part in text.split("/")]
    if len(parts) != 2 or None in parts or not parts[1] > 0:
        return 0.0
    quotient = parts[0] / parts[1]
    if math.isnan(quotient) or math.isinf(quotient):
        return quotient
    scaled = Fraction(quotient) * 10_000
    below = math.floor(scaled)
    rest = scaled - below
    up = rest > Fraction(1, 2) or (rest == Fraction(1, 2) and below % 2 == 1)
    return float(Fraction(below + up, 10_000))


def test_helpfulness_rounds_like_python(spark):
    rng = random.Random(5)
    texts = [f"{rng.randint(0, 400)}/{rng.randint(0, 400)}" for _ in range(3000)]
    texts += [f"{n}/{d}" for d in (32, 96, 160, 320, 800, 1600, 20000) for n in range(1, 60)]
    texts += ["", "/", "1/", "/2", "1/2/3", "-1/3", "1/-3", "1.5/2", " 1 / 4 ", "inf/2", "1/inf", "nan/1", "0/5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.h for r in df.select("t", measures.helpfulness(F.col("t")).alias("h")).collect()}
    want = {t: rounded_ratio(t) for t in texts}
    wrong = {t: (got[t], want[t]) for t in texts if got[t] != want[t] and not math.isnan(want[t])}
    assert not wrong


def test_numbers(spark):
    df = spark.createDataFrame([(t,) for t in ["5", " 4.5 ", "1e2", "5d", "x", "", None]], "t string")
    got = df.select(measures.score(F.col("t")), measures.epoch_seconds(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        (5.0, 5), (4.5, 0), (100.0, 0), (0.0, 0), (0.0, 0), (0.0, 0), (0.0, 0),
    ]


def test_edges_csv(spark, tmp_path, rows, hand):
    path = str(tmp_path / "edges")
    tables.write_csv(hand.edges, path)
    back = tables.read_graph_csv(spark, path)
    assert rows(back.edges.fillna(-1.0)) == rows(hand.edges.fillna(-1.0))
    assert rows(back.vertices) == rows(hand.vertices)
    bad = tmp_path / "bad.csv"
    bad.write_text("src,dst,score,helpfulness,timestamp\nu_1,p_1,x,,1.5\n")
    assert rows(tables.read_edges_csv(spark, str(bad))) == [("u_1", "p_1", None, None, None)]
    assert rows(tables.read_edges_csv(spark, str(bad), "zero")) == [("u_1", "p_1", 0.0, 0.0, 0)]
    with pytest.raises(ValueError):
        tables.read_edges_csv(spark, str(bad), "skip")


def test_vertices_csv(spark, tmp_path, rows):
    named = spark.createDataFrame([("u_1", "User", 'a "b", c'), ("p_1", "Product", "")], "id string, label string, name string")
    path = str(tmp_path / "vertices")
    tables.write_csv(named, path)
    assert rows(tables.read_vertices_csv(spark, path)) == rows(named)


def test_stored_graph(spark, tmp_path, rows, hand):
    path = str(tmp_path / "graph")
    for _ in range(2):  # writing again replaces
        tables.write_graph(hand, path, by_year=True)
    back = tables.read_graph(spark, path)
    assert rows(back.vertices) == rows(hand.vertices)
    assert rows(back.edges.drop("year")) == rows(tables.zero_missing(hand.edges))
    assert tables.read_graph(spark, path, max_edges=2).edges.count() == 2
    cut = dice.dice_time(back, 15, 45)
    assert cut.edges.count() == 3
    plan = cut.edges._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_measurements(spark, tmp_path, hand, rows):
    with dice.dice_score(hand, 1, 5).cached() as cut:
        taken = [
            batch.measure(cut, "ratingSummary", minReviews=1),
            batch.measure(cut, "reachabilityCounts", seeds=2, maxHops=2),
            batch.measure(hand, "kCoreDecomposition", maxK=3),
        ]
    assert [t[:4] for t in taken] == [
        ("neighborhood", "ratingSummary_min1", 7, 6),
        ("path", "reachabilityCounts_h2", 7, 6),
        ("centrality", "kCoreDecomposition_k3", 7, 6),
    ]
    # p_1 and p_2 both reach p_1, p_2, u_1 and one more user in two hops.
    assert [t[5] for t in taken] == [3, 8, 2]
    assert taken[0][6] == "minReviews=1;score=[1.0,5.0]"
    path = str(tmp_path / "measured")
    tables.write_measurements(batch.measurements(spark, taken), path)
    assert rows(tables.read_measurements(spark, path)) == sorted(taken)


def test_rollups(spark):
    measured = batch.measurements(
        spark,
        [
            ("path", "b", 30, 3, 0, 1, "x,\"y\""),
            ("path", "a", 10, 1, 10, 1, ""),
            ("path", "a", 20, 2, 30, 1, ""),
            ("centrality", "c", 5, 5, 7, 1, ""),
        ],
    )
    assert [tuple(r) for r in batch.mean_times(measured).collect()] == [
        ("centrality", "c", 7.0, 1), ("path", "b", 0.0, 1), ("path", "a", 20.0, 2),
    ]
    assert [tuple(r) for r in batch.time_series(measured).collect()][1:] == [
        ("path", 10, 10, 10), ("path", 20, 30, 30), ("path", 30, 0, 1),
    ]
    summary = {r.query_class: r for r in batch.time_summary(measured).collect()}
    assert summary["path"].median_ms == 10.0 and summary["all"].runs == 4


def test_slice_sizes(hand, rows, all_hot):
    got = rows(batch.slice_sizes(hand, [1, 2, 3, 4]), "threshold", "second_dice", "vertices", "edges")
    want = []
    for t in (1, 2, 3, 4):
        base = dice.dice_popularity(hand, t)
        for name, cut in (
            ("helpfulness", dice.dice_helpfulness(base, 0.5)),
            ("none", base),
            ("score", dice.dice_score(base, 4, 5)),
        ):
            vertices, edges = rows(cut.size())[0]
            if edges:
                want.append((t, name, vertices, edges))
    assert got == sorted(want)


def test_demo_runs_every_evaluation(hand):
    slices = batch.demo_slices(hand, dense=2, busy=1)
    results = batch.run_batch(slices, batch.DEMO)
    assert len(batch.DEMO) == 18 and {q for q, _ in results} == set(batch.QUERIES)
    ranks = results["pageRankAggregation", "by_label"]
    assert {r["slice"] for r in ranks.select("slice").distinct().collect()} == {"dense", "rating", "apex"}


def test_only_edges_from_users_to_products_are_read_back(spark, graph_of, tmp_path, rows):
    edges = [("u_1", "p_1"), ("u_1", "p_1"), ("u_2", "p_2"), ("p_1", "u_1"), ("u_1", "u_2"), ("p_2", "p_1")]
    tables.write_graph(graph_of(edges), str(tmp_path))
    read = tables.read_graph(spark, str(tmp_path), check_labels=True)
    assert rows(read.edges, "src", "dst") == [("u_1", "p_1"), ("u_1", "p_1"), ("u_2", "p_2")]
    assert tables.read_graph(spark, str(tmp_path)).edges.count() == 6


def test_a_raw_line_is_looked_at_once(spark, tmp_path, monkeypatch):
    """Spark would do the work of the key again to filter by it."""
    plans, save = [], Workspace.save

    def spied(self, df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(self, df, name)

    monkeypatch.setattr(Workspace, "save", spied)
    text = " \x1c\nproduct/productId: 7\n review/userId : a:b \nreview/score\n:x\n\xa0\x85\n review/userId:\n"
    (tmp_path / "reviews").write_bytes(text.encode("ISO-8859-1"))
    found = reviews.read_records(spark, str(tmp_path / "reviews")).orderBy("ord").select("product", "user", "score").collect()
    assert [tuple(r) for r in found] == [("7", "a:b", None), (None, "", None)]
    assert plans[0].count("array_position") == 1
