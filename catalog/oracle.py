"""Plain SQL for each query, written apart from the library's own code.

Means of whole numbers are rounded through whole-number arithmetic, so ties
round up as they do on the decimal text of the mean.
"""

from __future__ import annotations

MAX_DEPTH = 40  # far above the depth of the test graphs, 6 at most

EDGES = """
edges AS MATERIALIZED (
  SELECT 'u_' || o_custkey AS src, 'p_' || l_partkey AS dst,
         CAST(CAST(l_quantity AS INT) % 5 + 1 AS DOUBLE) AS score,
         round(l_discount * 10, 4) AS helpfulness,
         CAST(epoch(l_shipdate) AS BIGINT) AS "timestamp"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

THREE_WAY = """
edges AS MATERIALIZED (
  SELECT 'u_' || o_custkey AS src, 'p_' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION
  SELECT 'p_' || l_partkey, 's_' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION
  SELECT 'u_' || o_custkey, 's_' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def popular(n: int, name: str = "sl", base: str = "edges") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT * FROM {base} WHERE dst IN "
        f"(SELECT dst FROM {base} GROUP BY dst HAVING count(*) >= {n}))"
    )


def label(column: str) -> str:
    return f"CASE WHEN starts_with({column}, 'u_') THEN 'User' ELSE 'Product' END"


def adjacency(base: str) -> str:
    return f"adj AS MATERIALIZED (SELECT src, dst FROM {base} UNION SELECT dst, src FROM {base})"


def degrees() -> str:
    return "deg AS MATERIALIZED (SELECT src AS id, count(*) AS degree FROM adj GROUP BY src)"


def mean(total: str, n: str, digits: int) -> str:
    """total / n for whole numbers, rounded half up."""
    scale = 10**digits
    return (
        f"(CAST({2 * scale} * CAST({total} AS HUGEINT) + ({n}) AS HUGEINT) // (2 * CAST(({n}) AS HUGEINT)))"
        f"::DOUBLE / {scale}.0"
    )


def search(base: str, hubs: str, depth: int = MAX_DEPTH) -> str:
    """CTEs up to found(landmark, id, dist) from a query of hub ids."""
    return f"""
{adjacency(base)}, {degrees()},
hubs AS MATERIALIZED ({hubs}),
walk AS (
  SELECT id AS landmark, id, 0 AS dist FROM hubs
  UNION
  SELECT w.landmark, a.dst, w.dist + 1 FROM walk w JOIN adj a ON a.src = w.id WHERE w.dist < {depth}),
found AS MATERIALIZED (SELECT landmark, id, CAST(min(dist) AS INT) AS dist FROM walk GROUP BY landmark, id)
"""


def top(n: int, where: str = "true") -> str:
    return f"SELECT id FROM deg WHERE {where} ORDER BY degree DESC, id LIMIT {n}"


def select_edges(condition: str) -> str:
    return f"WITH {EDGES} SELECT src, dst, score, helpfulness, \"timestamp\" FROM edges WHERE {condition}"


def ego(base_edges: str) -> str:
    return f"""{base_edges},
adj AS MATERIALIZED (SELECT src, dst, score FROM edges UNION SELECT dst, src, score FROM edges),
hubs AS MATERIALIZED (SELECT src AS ego FROM adj GROUP BY src ORDER BY count(*) DESC, src LIMIT 5),
members AS MATERIALIZED (
  SELECT ego, dst AS member FROM hubs JOIN adj ON src = ego UNION SELECT ego, ego FROM hubs),
internal AS MATERIALIZED (
  SELECT m1.ego, a.src, a.dst, a.score FROM members m1 JOIN adj a ON a.src = m1.member
  JOIN members m2 ON m2.ego = m1.ego AND m2.member = a.dst)"""


def ego_summary(base_edges: str) -> str:
    return f"""WITH {ego(base_edges)},
sizes AS (SELECT ego, count(*) AS ego_size FROM members GROUP BY ego),
stats AS (SELECT ego, count(*) AS internal_edges, {mean("sum(score)", "count(*)", 3)} AS avg_score,
                 min(score) AS min_score, max(score) AS max_score FROM internal GROUP BY ego)
SELECT ego, ego_size, internal_edges, avg_score, min_score, max_score,
       {mean("internal_edges", "(ego_size * (ego_size - 1))", 5)} AS ego_density
FROM sizes JOIN stats USING (ego)"""


def khop(base: str, hops: int) -> str:
    steps = [adjacency(base), "hop1 AS MATERIALIZED (SELECT src AS origin, dst AS reached FROM adj)"]
    for h in range(2, hops + 1):
        steps.append(
            f"hop{h} AS MATERIALIZED (SELECT * FROM hop{h - 1} UNION "
            f"SELECT h.origin, a.dst FROM hop{h - 1} h JOIN adj a ON a.src = h.reached)"
        )
    return ", ".join(steps)


def khop_degrees(hops: int) -> str:
    return (
        f"kd AS (SELECT origin AS id, count(*) AS khop_degree FROM hop{hops} WHERE origin <> reached GROUP BY origin)"
    )


KHOP_HISTOGRAM = "SELECT khop_degree, count(*) AS vertex_count FROM kd GROUP BY khop_degree"


def core_steps(base: str, ks: list[int], rounds: int) -> str:
    """CTEs core_<k>: rounds of deletion unrolled; extra rounds change nothing."""
    steps = [adjacency(base)]
    last = "adj"
    for k in ks:
        for r in range(rounds):
            name = f"core_{k}" if r == rounds - 1 else f"core_{k}_{r}"
            keep = f"(SELECT src FROM {last} GROUP BY src HAVING count(*) >= {k})"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT src, dst FROM {last} WHERE src IN {keep} AND dst IN {keep})"
            )
            last = name
    return ", ".join(steps)


def core_profile(base: str, max_k: int, rounds: int) -> str:
    ks = list(range(1, max_k + 1))
    rows = " UNION ALL ".join(
        f"SELECT {k} AS k, (SELECT count(DISTINCT src) FROM core_{k}) AS core_vertices, "
        f"(SELECT count(*) // 2 FROM core_{k}) AS core_edges"
        for k in ks
    )
    return f"""WITH {EDGES}, {core_steps(base, ks, rounds)}, profile AS ({rows})
SELECT k, core_vertices, core_edges FROM profile
WHERE k = 1 OR k - 1 <= (SELECT coalesce(max(k), 0) FROM profile WHERE core_vertices > 0)"""


def ranks(base: str, iterations: int, prefix: str = "") -> str:
    p = prefix
    steps = [
        f"{p}v AS MATERIALIZED (SELECT src AS id FROM {base} UNION SELECT dst FROM {base})",
        f"{p}link AS MATERIALIZED (SELECT src, dst, count(*) AS m FROM {base} GROUP BY src, dst)",
        f"{p}given AS MATERIALIZED (SELECT src, sum(m) AS given FROM {p}link GROUP BY src)",
        f"{p}r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS r FROM {p}v)",
    ]
    for i in range(1, iterations + 1):
        steps.append(
            f"{p}r{i} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(x.s, 0) AS r FROM {p}v v LEFT JOIN "
            f"(SELECT l.dst, sum(r.r * l.m / g.given) AS s FROM {p}link l JOIN {p}r{i - 1} r ON r.id = l.src "
            f"JOIN {p}given g ON g.src = l.src GROUP BY l.dst) x ON x.dst = v.id)"
        )
    steps.append(
        f"{p}pr AS MATERIALIZED (SELECT id, {label('id')} AS label, "
        f"r * (SELECT count(*) / sum(r) FROM {p}r{iterations}) AS pagerank FROM {p}r{iterations})"
    )
    return ", ".join(steps)


BY_LABEL = """SELECT label, count(*) AS vertices, round(sum(pagerank), 4) AS total_rank,
round(avg(pagerank), 6) AS avg_rank, round(max(pagerank), 4) AS max_rank"""

TRIANGLES = f"""{THREE_WAY}, {adjacency("edges")}, {degrees()},
tri AS MATERIALIZED (
  SELECT x.src AS a, x.dst AS b, y.dst AS c FROM adj x JOIN adj y ON y.src = x.dst AND y.src < y.dst
  JOIN adj z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst),
ends AS (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri),
counted AS (SELECT id, count(*) AS n FROM ends GROUP BY id),
lcc AS MATERIALIZED (
  SELECT id, coalesce(n, 0) AS triangles, degree,
         CASE WHEN degree > 1 THEN {mean("2 * coalesce(n, 0)", "(degree * (degree - 1))", 6)} ELSE 0.0 END AS lcc
  FROM deg LEFT JOIN counted USING (id))"""

LCC_SUMMARY = """SELECT count(*) AS vertices, round(avg(lcc), 6) AS avg_lcc, max(lcc) AS max_lcc,
CAST(sum(triangles) AS BIGINT) AS total_triangle_ends FROM lcc"""

# The texts of the raw measures and what cleaning makes of them.
RAW = """
raw AS (
  SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, l_partkey % 8 AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
halves AS (
  SELECT *, CASE WHEN part = 2 THEN q::DOUBLE WHEN part IN (0, 1) THEN 0.0 ELSE q::DOUBLE + 0.5 END AS score,
         CASE WHEN part IN (3, 4, 5) OR q::INT = 0 THEN 0.0 ELSE l_linenumber / q::DOUBLE END AS x,
         CASE WHEN part IN (6, 7) THEN 0 ELSE CAST(epoch(l_shipdate) AS BIGINT) END AS "timestamp"
  FROM raw),
tied AS (
  SELECT *, floor(x * 10000) AS k,
         CASE WHEN part IN (3, 4, 5) OR q::INT = 0 THEN false
              ELSE (l_linenumber * 20000) % (2 * q::INT) = 0 AND ((l_linenumber * 20000) // q::INT) % 2 = 1 END AS tie,
         CASE WHEN q::INT = 0 THEN false ELSE (q::INT & (q::INT - 1)) = 0 END AS dyadic
  FROM halves),
clean AS (
  SELECT *, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x, 4) END AS helpfulness FROM tied)
"""

USABLE = "o_custkey % 11 <> 0"

MEASURED = """measured AS (SELECT l_linestatus AS query_class, 'q' || l_linenumber AS query_name,
l_partkey AS v, l_suppkey AS e, CAST(l_quantity AS BIGINT) AS ms FROM lineitem)"""

MEASURE_FIGURES = """count(*) AS runs, quantile_cont(ms, 0.5)::DOUBLE AS median_ms,
round(corr(ms, v), 6) AS r_vertices, round(corr(ms, e), 6) AS r_edges"""

SLICES = f"""{EDGES}, {popular(35, "dense")}, {popular(30, "busy")},
rating AS MATERIALIZED (SELECT * FROM busy WHERE score BETWEEN 5 AND 5),
quality AS MATERIALIZED (SELECT * FROM busy WHERE helpfulness >= 0.8)"""


def rating_summary(base: str, least: int, extra: str = "") -> str:
    helpful = mean("sum(CAST(round(helpfulness * 1000000) AS BIGINT))", "(1000000 * count(*))", 3)
    return f"""SELECT dst, count(*) AS n_reviews, {mean("sum(score)", "count(*)", 3)} AS avg_score,
round(stddev_samp(score), 3) AS stddev_score, min(score) AS min_score, max(score) AS max_score,
{helpful} AS avg_helpfulness{extra} FROM {base} GROUP BY dst HAVING count(*) >= {least}"""


def slice_sizes(thresholds: tuple[int, ...]) -> str:
    parts = []
    for t in thresholds:
        for name, test in (("none", "true"), ("score", "score BETWEEN 4 AND 5"), ("helpfulness", "helpfulness >= 0.5")):
            cut = f"(SELECT * FROM counted WHERE n >= {t} AND {test})"
            parts.append(
                f"SELECT CAST({t} AS BIGINT) AS threshold, '{name}' AS second_dice, "
                f"(SELECT count(*) FROM (SELECT src FROM {cut} UNION SELECT dst FROM {cut})) AS vertices, "
                f"(SELECT count(*) FROM {cut}) AS edges"
            )
    union = " UNION ALL ".join(parts)
    return f"""WITH {EDGES}, counted AS MATERIALIZED (
  SELECT e.*, c.n FROM edges e JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) c USING (dst))
SELECT * FROM ({union}) WHERE edges > 0"""


PATHS = f"WITH RECURSIVE {EDGES}, {search('edges', top(3))}"
HISTOGRAM = "SELECT dist, count(*) AS vertex_count FROM found GROUP BY dist"
REACH = f"""WITH RECURSIVE {EDGES}, {search('edges', top(3), 3)},
hops AS (SELECT CAST(unnest([1, 2, 3]) AS INT) AS hop),
per AS (SELECT landmark AS seed, hop, count(*) AS reachable FROM found JOIN hops ON dist <= hop GROUP BY landmark, hop)"""


def pairs(base: str, slice_cte: str = "") -> str:
    return f"""WITH RECURSIVE {EDGES}{slice_cte}, {search(base, top(5, "starts_with(id, 'u_')"))},
b AS (SELECT id FROM deg WHERE starts_with(id, 'p_') ORDER BY degree DESC, id LIMIT 5),
pairs AS (SELECT landmark AS from_a, id, dist AS path_len FROM found WHERE id IN (SELECT id FROM b))"""


SAMPLE = """numbered AS (SELECT *, row_number() OVER (PARTITION BY src, dst, score, helpfulness, "timestamp") AS number
  FROM edges),
sampled AS (SELECT * FROM numbered WHERE CAST('0x' || md5(concat_ws('|', 42, src, dst, score, helpfulness, "timestamp",
  number))[1:8] AS BIGINT) < 1073741824)"""

ORACLE: dict[str, str] = {
    "clean_measures": f"""WITH {RAW} SELECT l_orderkey, l_linenumber, score, helpfulness, "timestamp" FROM clean""",
    "raw_review_edges": f"""WITH {RAW} SELECT 'u_' || o_custkey AS src, 'p_' || l_partkey AS dst, score,
helpfulness, "timestamp" FROM clean WHERE {USABLE}""",
    "raw_review_vertices": f"""WITH {RAW}
SELECT 'u_' || o_custkey AS id, 'User' AS label, 'José: ' || min(l_orderkey) AS name FROM raw WHERE {USABLE} GROUP BY o_custkey
UNION ALL SELECT DISTINCT 'p_' || l_partkey, 'Product', '' FROM raw WHERE {USABLE}""",
    "build_edges": select_edges("true"),
    "edges_csv_roundtrip": select_edges("true"),
    "edge_cap": f"""WITH {EDGES} SELECT * FROM edges
ORDER BY src, dst, score, helpfulness, "timestamp" LIMIT 1000""",
    "graph_summary": f"""WITH {EDGES}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
SELECT {label("id")} AS item, count(*) AS n FROM v GROUP BY 1
UNION ALL SELECT 'vertices', count(*) FROM v UNION ALL SELECT 'edges', count(*) FROM edges""",
    "derive_vertices": f"""WITH {EDGES}
SELECT id, {label("id")} AS label FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)""",
    "persist_roundtrip": select_edges('"timestamp" BETWEEN 820454400 AND 883612799'),
    "dice_all": select_edges("true"),
    "dice_score": select_edges("score BETWEEN 4 AND 5"),
    "dice_time": select_edges('"timestamp" BETWEEN 820454400 AND 883612799'),
    "dice_helpfulness": select_edges("helpfulness >= 0.5"),
    "dice_popularity": f"WITH {EDGES}, {popular(30)} SELECT * FROM sl",
    "dice_sample": f'WITH {EDGES}, {SAMPLE} SELECT src, dst, score, helpfulness, "timestamp" FROM sampled',
    "dice_sample_vertices": f"""WITH {EDGES}, {SAMPLE}
SELECT id, {label("id")} AS label FROM (SELECT src AS id FROM sampled UNION SELECT dst FROM sampled)""",
    "induced_vertices": f"""WITH {EDGES}, {popular(30)}
SELECT id, {label("id")} AS label FROM (SELECT src AS id FROM sl UNION SELECT dst FROM sl)""",
    "slice_size": f"""WITH {EDGES}, {popular(30)}
SELECT (SELECT count(*) FROM (SELECT src FROM sl UNION SELECT dst FROM sl)) AS vertices,
       (SELECT count(*) FROM sl) AS edges""",
    "slice_description": f"""WITH {EDGES}, {popular(30)},
cut AS (SELECT * FROM sl WHERE score BETWEEN 4 AND 5 AND helpfulness >= 0.5)
SELECT (SELECT count(*) FROM (SELECT src FROM cut UNION SELECT dst FROM cut)) AS vertices,
       (SELECT count(*) FROM cut) AS edges,
       'productReviews>=30 & score=[4.0,5.0] & helpfulness>=0.50' AS description""",
    "undirected_edges": f"WITH {EDGES}, {adjacency('edges')} SELECT src, dst FROM adj",
    "undirected_scored": f"""WITH {EDGES}
SELECT src, dst, score FROM edges UNION SELECT dst, src, score FROM edges""",
    "degree": f"WITH {EDGES}, {adjacency('edges')}, {degrees()} SELECT id, degree FROM deg",
    "top_hubs": f"""WITH {EDGES}, {adjacency('edges')}, {degrees()}
SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 5""",
    "top_hubs_by_label": f"""WITH {EDGES}, {adjacency('edges')}, {degrees()}
SELECT {label("id")} AS label, id, degree FROM deg
QUALIFY row_number() OVER (PARTITION BY {label("id")} ORDER BY degree DESC, id) <= 5""",
    "khop_pairs": f"""WITH {EDGES}, {khop('edges', 2)}, {degrees()}
SELECT origin, reached FROM hop2 WHERE origin IN (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 50)""",
    "khop_degree": f"WITH {EDGES}, {khop('edges', 2)}, {khop_degrees(2)} SELECT id, khop_degree FROM kd",
    "multi_hop_degree_h1": f"WITH {EDGES}, {khop('edges', 1)}, {khop_degrees(1)} {KHOP_HISTOGRAM}",
    "multi_hop_degree_h2": f"WITH {EDGES}, {khop('edges', 2)}, {khop_degrees(2)} {KHOP_HISTOGRAM}",
    "multi_hop_degree_h3": f"WITH {EDGES}, {khop('edges', 3)}, {khop_degrees(3)} {KHOP_HISTOGRAM}",
    "ego_members": f"WITH {ego(EDGES)} SELECT ego, member FROM members",
    "ego_edges": f"WITH {ego(EDGES)} SELECT ego, src, dst, score FROM internal",
    "ego_network": ego_summary(EDGES),
    "ego_network_three_way": ego_summary(
        THREE_WAY.replace("edges AS", "bare AS", 1)
        + ", edges AS MATERIALIZED (SELECT src, dst, length(src)::DOUBLE AS score FROM bare)"
    ),
    "rating_summary": f"WITH {EDGES}, {popular(30)} {rating_summary('sl', 35)}",
    "bfs_distances": f"{PATHS} SELECT landmark, id, dist FROM found",
    "distance_maps": f"{PATHS} SELECT landmark, id, dist FROM found",
    "sp_histogram": f"{PATHS} {HISTOGRAM}",
    "sp_per_landmark": f"""{PATHS} SELECT landmark, count(*) AS reached,
{mean("sum(dist)", "count(*)", 3)} AS avg_dist, max(dist) AS max_dist FROM found GROUP BY landmark""",
    "reachability": f"{REACH} SELECT seed, hop, reachable FROM per",
    "reach_curve": f"{REACH} SELECT hop, CAST(sum(reachable) AS BIGINT) AS reachable FROM per GROUP BY hop",
    "path_pairs": f"{pairs('edges')} SELECT from_a, id, path_len FROM pairs",
    "path_length_dist": f"{pairs('edges')} SELECT path_len, count(*) AS pair_count FROM pairs GROUP BY path_len",
    "path_length_summary": f"""{pairs('edges')} SELECT count(*) AS pairs_connected,
{mean("sum(path_len)", "count(*)", 3)} AS avg_path_len, min(path_len) AS min_path_len,
max(path_len) AS max_path_len FROM pairs""",
    "triangle_count": f"WITH {TRIANGLES} SELECT id, triangles FROM lcc",
    "local_clustering": f"WITH {TRIANGLES} SELECT id, triangles, degree, lcc FROM lcc",
    "lcc_summary": f"WITH {TRIANGLES} {LCC_SUMMARY}",
    "lcc_top": f"WITH {TRIANGLES} SELECT id, triangles, degree, lcc FROM lcc ORDER BY lcc DESC, id LIMIT 10",
    "lcc_bipartite": f"WITH {TRIANGLES.replace(THREE_WAY, EDGES, 1)} {LCC_SUMMARY}",
    "kcore_members": f"""WITH {EDGES}, {core_steps("edges", [20], 25)}
SELECT DISTINCT src AS id FROM core_20""",
    "kcore_profile": core_profile("edges", 25, 12),  # at most 10 rounds change anything on the test graphs
    "pagerank": f"WITH {EDGES}, {ranks('edges', 10)} SELECT id, label, round(pagerank, 6) AS pagerank FROM pr",
    "pagerank_three_way": f"""WITH {THREE_WAY}, {ranks('edges', 10)}
SELECT id, label, round(pagerank, 6) AS pagerank FROM pr""",
    "pagerank_by_label": f"WITH {EDGES}, {ranks('edges', 10)} {BY_LABEL} FROM pr GROUP BY label",
    "pagerank_top": f"""WITH {EDGES}, {ranks('edges', 10)}
SELECT id, label, round(pagerank, 6) AS pagerank FROM pr ORDER BY round(pagerank, 6) DESC, id LIMIT 10""",
    "slice_sizes": slice_sizes((20, 25, 30, 35, 40, 45, 50)),
    "rating_by_slice": "WITH " + SLICES + " " + " UNION ALL ".join(
        rating_summary(base, 8, f", '{name}' AS slice")
        for name, base in (("dense", "dense"), ("rating", "rating"), ("quality", "quality"), ("apex", "edges"))
    ),
    "pagerank_by_slice": "WITH " + SLICES + ", " + ", ".join(
        ranks(base, 5, f"{name}_")
        for name, base in (("dense", "dense"), ("rating", "rating"), ("quality", "quality"), ("apex", "edges"))
    ) + " " + " UNION ALL ".join(
        f"{BY_LABEL}, '{name}' AS slice FROM {name}_pr GROUP BY label" for name in ("dense", "rating", "quality", "apex")
    ),
    "measurements_csv": """SELECT l_linestatus AS query_class, 'q' || l_linenumber AS query_name,
l_partkey AS vertices_involved, l_suppkey AS edges_involved, CAST(l_quantity AS BIGINT) AS elapsed_ms,
CAST(l_linenumber AS BIGINT) AS result_rows, 'k=' || l_linenumber || ', flag="' || l_returnflag || '"' AS params
FROM lineitem""",
    "measure_rollup": f"""WITH {MEASURED}
SELECT query_class, query_name, avg(ms) AS mean_ms, count(*) AS runs FROM measured GROUP BY ALL""",
    "measure_summary": f"""WITH {MEASURED}
SELECT query_class, {MEASURE_FIGURES} FROM measured GROUP BY query_class
UNION ALL SELECT 'all', {MEASURE_FIGURES} FROM measured""",
    "measure_series": f"""WITH {MEASURED}
SELECT query_class, v AS vertices_involved, ms AS elapsed_ms, greatest(ms, 1) AS log_ms FROM measured""",
}
