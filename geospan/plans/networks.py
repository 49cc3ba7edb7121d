"""Queries over the trade network between nations, and over sample points."""

from __future__ import annotations

from pyspark.sql import functions as F

from geospan.functions import numeric as N
from geospan.operators import geostat as S
from geospan.operators import network as W
from geospan.plans.bindings import SAMPLES_SQL, samples
from geospan.plans.registry import query, r6, table

c = F.col
EDGES_SQL = """edges AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst, CAST(1 + (c_nationkey * 3 + s_nationkey * 5) % 10 AS DOUBLE) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 WHERE c_nationkey <> s_nationkey)"""
#: Least costs by 24 rounds: no shortest way over 25 nations has more arcs.
REACH_SQL = f"WITH {EDGES_SQL}, reach0 AS (SELECT 0 AS node, CAST(0 AS DOUBLE) AS cost)" + "".join(f", reach{i + 1} AS MATERIALIZED (SELECT node, min(cost) AS cost FROM (SELECT * FROM reach{i} UNION ALL SELECT dst, reach{i}.cost + edges.cost FROM reach{i} JOIN edges ON src = node) GROUP BY node)" for i in range(24)) + ", reach AS (SELECT * FROM reach24)"


def edges(spark, sf_dir):
    """Arcs from customers' to suppliers' nations."""
    line, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(orders, c("l_orderkey") == c("o_orderkey")).join(customer, c("o_custkey") == c("c_custkey")).join(supplier, c("l_suppkey") == c("s_suppkey"))
    a, b = c("c_nationkey"), c("s_nationkey")
    return joined.where(a != b).select(a.alias("src"), b.alias("dst"), (1 + (a * 3 + b * 5) % 10).cast("double").alias("cost")).distinct()


def _origin(spark, node: int = 0):
    return spark.range(1).select(F.lit(node).cast("int").alias("node"))


@query("sssp", f"{REACH_SQL} SELECT node, cost FROM reach")
def sssp(spark, sf_dir):
    return W.shortest_paths(edges(spark, sf_dir), _origin(spark)).select("node", "cost")


@query("service_area", f"{REACH_SQL} SELECT node, cost FROM reach WHERE cost <= 7")
def service_area(spark, sf_dir):
    return W.service_area(edges(spark, sf_dir), _origin(spark), 7.0).select("node", "cost")


@query("closest_facility", f"{REACH_SQL} SELECT node AS facility, cost FROM reach WHERE node IN (5, 9, 17, 21) ORDER BY cost, node LIMIT 1")
def closest_facility(spark, sf_dir):
    places = table(spark, sf_dir, "nation").where(c("n_nationkey").isin(5, 9, 17, 21)).select(c("n_nationkey").alias("node"), c("n_nationkey").alias("pos"))
    return W.closest_facility(edges(spark, sf_dir), _origin(spark), places).select("facility", "cost")


@query("network_arcs", f"WITH {EDGES_SQL} SELECT src, dst, cost FROM edges UNION ALL SELECT dst, src, cost FROM edges")
def network_arcs(spark, sf_dir):
    return W.both_ways(edges(spark, sf_dir))


@query("astar", f"{REACH_SQL} SELECT node, cost FROM reach WHERE node <> 0")
def astar(spark, sf_dir):
    """The cost of the way from nation 0 to each other one, by a search on the small graph in memory."""
    adjacency: dict = {}
    for e in edges(spark, sf_dir).collect():  # at most one arc for each two nations
        adjacency.setdefault(e.src, []).append((e.dst, e.cost))
    nodes = {i: (0.0, 0.0) for i in {*adjacency, *(b for ways in adjacency.values() for b, _ in ways)}}
    finder = W.AStarPathfinder(nodes, adjacency, "none")
    found = [(i, finder.find_path(0, i)) for i in nodes if i != 0]
    return spark.createDataFrame([(i, way["cost"]) for i, way in found if way["success"]], "node int, cost double")


PAIRS_SQL = f"p AS (SELECT a.id AS a, b.id AS b, a.v AS va, b.v AS vb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM {SAMPLES_SQL} a JOIN {SAMPLES_SQL} b ON a.id <> b.id)"


@query("pair_distance", f"WITH {PAIRS_SQL} SELECT a, b, {r6('d')} AS d FROM p WHERE d <= 20.5")
def pair_distance(spark, sf_dir):
    return S.near_pairs(samples(spark, sf_dir), 20.5).select("a", "b", N.rounded(c("d")).alias("d"))


@query(
    "variogram_bins",
    f"""WITH {PAIRS_SQL}, b AS (SELECT CAST(greatest(0, ceil(d / (50.3e0 / 10)) - 1) AS BIGINT) AS bin, avg(0.5e0 * (va - vb) ** 2) AS g, count(*) AS n FROM p WHERE a < b AND d <= 50.3e0 GROUP BY 1)
SELECT i AS bin, {r6("(i + 0.5e0) * 5.03e0")} AS lag, {r6("coalesce(g, 0)", "1e1")} AS gamma, coalesce(n, 0) AS pairs FROM range(0, 10) r(i) LEFT JOIN b ON bin = i""",
)
def variogram_bins(spark, sf_dir):
    return S.variogram_bins(samples(spark, sf_dir), 10, 50.3).select("bin", N.rounded(c("lag")).alias("lag"), N.rounded(c("gamma"), 1).alias("gamma"), "pairs")


@query(
    "variogram_models",
    f"""SELECT id, {r6("1 + 4 * (CASE WHEN x / 40 < 1 THEN 1.5e0 * (x / 40) - 0.5e0 * (x / 40) * (x / 40) * (x / 40) ELSE 1 END)")} AS spherical, {r6("1 + 4 * (1 - exp(-x / 40))")} AS exponential,
 {r6("1 + 4 * (1 - exp(-(x / 40) * (x / 40)))")} AS gaussian, {r6("1 + 4 * (x / 40)")} AS linear, {r6("1 + 4 * (x / 40) ** 1.5")} AS power FROM {SAMPLES_SQL}""",
)
def variogram_models(spark, sf_dir):
    return samples(spark, sf_dir).select("id", *(N.rounded(S.model(c("x"), kind, 1.0, 4.0, 40.0)).alias(kind) for kind in S.MODELS))


@query(
    "morans_i",
    f"""WITH s AS (SELECT * FROM {SAMPLES_SQL}), {PAIRS_SQL}, m AS (SELECT avg(v) AS m, var_pop(v) * count(*) AS ss, CAST(count(*) AS DOUBLE) AS n FROM s), k AS (SELECT sum(pow(v - m, 4)) AS m4 FROM s, m),
 q AS (SELECT p.*, m.m FROM p, m WHERE d <= 30.5), r AS (SELECT a, CAST(count(*) AS DOUBLE) AS r FROM q GROUP BY a), w AS (SELECT q.a, q.b, 1 / x.r AS wa, 1 / y.r AS wb, (va - m) * (vb - m) AS zz FROM q JOIN r x ON x.a = q.a JOIN r y ON y.a = q.b),
 c AS (SELECT b, sum(wa) AS c FROM w GROUP BY b), g AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM r) AS s0, sum(wa * zz) AS num, 0.5e0 * sum((wa + wb) * (wa + wb)) AS s1, (SELECT sum((c + 1) * (c + 1)) FROM c) AS s2 FROM w),
 f AS (SELECT n / s0 * num / ss AS i, -1 / (n - 1) AS e, (n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0 AS t, (n - 1) * (n - 2) * (n - 3) * s0 * s0 AS u, n * m4 / (ss * ss) AS b2, n, s0, s1, s2 FROM g, m, k),
 h AS (SELECT *, greatest((n * t - (n * n - n) * t) / u, 1e-10) AS v FROM f)
SELECT {r6("i")} AS statistic, {r6("e")} AS expected, v * 1e10 AS variance, {r6("(i - e) / sqrt(v)", "1e-1")} AS z_score, CASE WHEN abs((i - e) / sqrt(v)) > 40 THEN 0e0 END AS p_value, CAST(n AS BIGINT) AS n,
 {r6("(n * t - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / u - e * e", "1e8")} AS variance_randomised FROM h""",
)
def morans_i(spark, sf_dir):
    found = S.morans_i(samples(spark, sf_dir), 30.5)
    return found.select(N.rounded(c("statistic")).alias("statistic"), N.rounded(c("expected")).alias("expected"), (c("variance") * 1e10).alias("variance"), N.rounded(c("z_score"), -1).alias("z_score"), "p_value", "n", N.rounded(c("variance_randomised"), 8).alias("variance_randomised"))


@query(
    "gearys_c",
    f"""WITH s AS (SELECT * FROM {SAMPLES_SQL}), {PAIRS_SQL}, m AS (SELECT var_pop(v) * count(*) AS ss, count(*) AS n FROM s), q AS (SELECT sum((va - vb) ** 2) AS num, count(*) AS w FROM p WHERE d <= 30.5)
SELECT {r6("(n - 1) * num / (2 * w * ss)")} AS statistic, n FROM m, q""",
)
def gearys_c(spark, sf_dir):
    return S.gearys_c(samples(spark, sf_dir), 30.5).select(N.rounded(c("statistic")).alias("statistic"), "n")


@query("drift_matrix", f"SELECT id, 1e0 AS drift_one, x AS drift_x, y AS drift_y, x * x AS drift_xx, y * y AS drift_yy, x * y AS drift_xy FROM {SAMPLES_SQL}")
def drift_matrix(spark, sf_dir):
    return S.drift_matrix(samples(spark, sf_dir), "quadratic")


@query("kriging_cv")
def kriging_cv(spark, sf_dir):
    return S.cross_validate(samples(spark, sf_dir), "exponential", 3)


@query("variogram_fit")
def variogram_fit(spark, sf_dir):
    v = S.Variogram("spherical", 10, 50.3).fit(samples(spark, sf_dir))
    return spark.createDataFrame([v.fitted], "nugget double, sill double, reach double")


@query("kriging")
def kriging(spark, sf_dir):
    """Values at customers, from the samples of suppliers."""
    known = samples(spark, sf_dir)
    key = c("c_custkey")
    targets = table(spark, sf_dir, "customer").select(key.alias("id"), (key * 41 % 101).cast("double").alias("x"), (key * 59 % 97).cast("double").alias("y"))
    return S.krige(known, targets, S.Variogram("exponential", 10, 50.3).fit(known))
