"""Fixtures with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geospan.functions import geometry as G
from geospan.functions import indices as I
from geospan.functions import numeric as N
from geospan.functions import pixels as P
from geospan.functions import sar as S
from geospan.operators import focal as W
from geospan.operators import geostat as K
from geospan.operators import network as net
from geospan.operators import raster as R
from geospan.operators import vector as V
from geospan.operators import zonal as Z


def grid_of(spark, array, name="z"):
    return R.from_array(spark, np.asarray(array, float), name).select("row", "col", name)


def array_of(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


@pytest.fixture(scope="module")
def road(spark):
    return net.both_ways(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 4, 5.0)], "src int, dst int, cost double"))


def one(spark, node):
    return spark.createDataFrame([(node,)], "node int")


def test_shortest_path(road):
    assert net.route(road, 1, 3) == ([1, 2, 3], 2.0)
    assert net.route(road, 1, 1) == ([1], 0.0)
    assert net.route(road, 1, 9) is None


def test_service_area(spark, road):
    assert {r.node for r in net.service_area(road, one(spark, 1), 1.5).collect()} == {1, 2}
    assert len(net.service_area(road, one(spark, 1), 10.0).collect()) == 4


def test_closest_facility(spark, road):
    places = spark.createDataFrame([(3, 0), (4, 1)], "node int, pos int")
    assert [(r.facility, r.cost) for r in net.closest_facility(road, one(spark, 1), places).collect()] == [(3, 2.0)]


def test_astar_agrees():
    nodes = {i: (float(i), 0.0) for i in range(1, 5)}
    roads = {1: [(2, 1.0), (4, 5.0)], 2: [(1, 1.0), (3, 1.0)], 3: [(2, 1.0), (4, 1.0)], 4: []}
    found = net.astar(nodes, roads, 1, 4)
    assert found["path"] == [1, 2, 3, 4] and found["cost"] == 3.0 and found["success"]
    assert not net.astar(nodes, roads, 4, 1)["success"]


def test_zonal(spark):
    values = grid_of(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    zones = values.select("row", "col", F.col("row").alias("zone"))
    found = {r.zone_id: r for r in Z.zonal_join(values, zones, value="z").collect()}
    assert [found[i]["mean"] for i in range(3)] == [2, 5, 8]
    assert [found[i]["sum"] for i in range(3)] == [6, 15, 24]


def test_zonal_skips_nan_and_empty(spark):
    values = grid_of(spark, [[1, float("nan")], [float("nan"), float("nan")]]).withColumn("zone", F.col("row"))
    assert [(r.zone_id, r["count"]) for r in Z.zonal_statistics(values, value="z").collect()] == [(0, 1)]


def test_overlay(spark):
    a, b = grid_of(spark, [[1, 2], [3, 4]], "value"), grid_of(spark, [[4, 3], [2, 1]], "value")
    found = Z.weighted_overlay({"a": a, "b": b}, {"a": 1.0, "b": 1.0}, normalize=False)
    assert (array_of(found, "suitability", (2, 2)) == 2.5).all()
    constant = Z.weighted_overlay({"a": grid_of(spark, [[10.0]], "value"), "b": grid_of(spark, [[0.0]], "value")}, {"a": 0.8, "b": 0.2})
    assert constant.first().suitability == 8.0


def test_ahp():
    fitted = Z.AHP(["a", "b", "c"]).fit([[1, 2, 4], [0.5, 1, 2], [0.25, 0.5, 1]])
    assert fitted.weights["a"] == pytest.approx(4 / 7)
    assert fitted.is_consistent()
    assert Z.AHP(["a", "b"]).fit([[1, 3], [1 / 3, 1]]).weights["a"] == pytest.approx(0.75)


def test_gradient_as_numpy(spark):
    z = np.random.default_rng(1).normal(size=(7, 9))
    found = W.gradient(grid_of(spark, z), "z", 2.0, z.shape)
    dy, dx = np.gradient(z, 2.0)
    assert np.allclose(array_of(found, "dy", z.shape), dy) and np.allclose(array_of(found, "dx", z.shape), dx)


@pytest.mark.parametrize("size", [3, 4, 11])
def test_uniform_mirrors(spark, size):
    z = np.random.default_rng(2).normal(size=(5, 4))
    before, after = size // 2, size - size // 2 - 1
    wide = np.pad(z, ((before, after), (before, after)), mode="symmetric")
    wanted = np.array([[wide[i : i + size, j : j + size].mean() for j in range(4)] for i in range(5)])
    assert np.allclose(array_of(W.uniform(grid_of(spark, z), ["z"], size, z.shape), "z", z.shape), wanted)


def test_unwrap_as_numpy(spark):
    p = np.random.default_rng(3).uniform(-np.pi, np.pi, size=(3, 20))
    found = W.unwrap_rows(grid_of(spark, p, "phase"))
    assert np.allclose(array_of(found, "unwrapped", p.shape), np.unwrap(p, axis=1))


def test_tiles(spark):
    z = grid_of(spark, np.zeros((256, 256)))
    assert R.tiles(z, 128).select("tile_row", "tile_col").distinct().count() == 4
    assert R.tile_grid(spark, 256, 256, 64).count() == 16
    with pytest.raises(ValueError):
        R.tiles(z, 8, 8)


def test_resample(spark):
    z = np.arange(16.0).reshape(4, 4)
    found = R.resample(grid_of(spark, z), 4, 4, 0.5)
    assert array_of(found, "z", (2, 2)).tolist() == [[0, 3], [12, 15]]


def test_decibels(spark):
    row = spark.range(1).select(S.to_db(F.lit(1.0)).alias("a"), S.to_db(F.lit(10.0)).alias("b"), S.to_db(F.lit(0.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.0, 20.0, -40.0)


def test_self_coherence(spark):
    z = np.random.default_rng(4).normal(size=(12, 12))
    pair = grid_of(spark, z).select("row", "col", N.complex_of(F.col("z"), F.col("z") * 0.5).alias("s1")).withColumn("s2", F.col("s1"))
    assert W.coherence(pair, (12, 12)).agg(F.min("coherence")).first()[0] > 0.999999


def test_index_errors(spark):
    with pytest.raises(ValueError, match="Missing bands"):
        I.compute_index("NDVI", spark.range(1))
    with pytest.raises(ValueError, match="Unknown index"):
        I.compute_index("NOPE", spark.range(1))


def test_zero_guards(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "NIR double, RED double")
    assert I.compute_index("NDVI", df, "v").first().v == 0.0
    row = df.select(I.evi(F.lit(1.0), F.lit(-1.0), F.lit(-4.0 / 7.5)).alias("v"), N.divided(F.lit(1.0), F.lit(0.0)).alias("inf"), N.divided(F.lit(0.0), F.lit(0.0)).alias("nan")).first()
    assert row.inf == math.inf and math.isnan(row.nan)


def test_threshold_nan(spark):
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (0.6,), (0.5,)], "p double").select(P.threshold(F.col("p"))).collect()] == [0, 1, 0]


def test_suppression(spark):
    rows = [(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 1, 0.8, 1.0, 0.0, 11.0, 10.0), (3, 1, 0.7, 20.0, 20.0, 30.0, 30.0), (4, 2, 0.5, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "id long, image long, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.id for r in V.suppress(df).collect()) == [1, 3, 4]


def test_point_text(spark):
    row = spark.createDataFrame([("POINT (1.5 -2e1)",), ("LINESTRING (0 0)",)], "w string").select(G.from_point_wkt(F.col("w")).alias("p")).collect()
    assert (row[0].p.x, row[0].p.y) == (1.5, -20.0) and row[1].p.x is None


def test_kriging_is_exact_at_samples(spark):
    rows = [(i, float(i % 4), float(i // 4), float(i % 3)) for i in range(12)]
    known = spark.createDataFrame(rows, "id long, x double, y double, v double")
    v = K.Variogram("linear")
    v.fitted = (0.0, 1.0, 1.0)
    found = {r.id: r.prediction for r in K.krige(known, known.select("id", "x", "y"), v).collect()}
    assert all(abs(found[i] - value) < 1e-6 for i, _, _, value in rows)


def test_variogram_needs_fit():
    with pytest.raises(RuntimeError):
        K.Variogram().predict(F.lit(1.0))


def test_box_joins_over_all_images(spark):
    """Every event takes part; against all pairs of boxes of each image and the next."""
    from geospan.plans.bindings import boxes
    from geospan.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = boxes(spark, folder).collect()
    images = {r.image for r in rows}
    wanted, alone = {}, {(r.image, r.id) for r in rows}
    for a in rows:
        for b in rows:
            if (a.image + 1) % 50 == b.image and a.x1 <= b.x2 and a.x2 >= b.x1 and a.y1 <= b.y2 and a.y2 >= b.y1:
                wanted[a.image, a.id, b.id] = (min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1))
                alone.discard((a.image, a.id))
    found = QUERIES["bbox_join"](spark, folder).collect()
    assert len(images) > 2 and len(found) == len(wanted) and {(r.image, r.a, r.b): (r.w, r.h) for r in found} == wanted
    assert sorted((r.image, r.id) for r in QUERIES["bbox_anti"](spark, folder).collect()) == sorted(alone)


def test_networks_over_all_arcs(spark):
    """All trade arcs; against plain joins and Dijkstra's method."""
    import heapq

    from geospan.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet").toPandas() for n in ("lineitem", "orders", "customer", "supplier")}
    customer_of, nation_of = dict(zip(tables["orders"].o_orderkey, tables["orders"].o_custkey, strict=True)), dict(zip(tables["customer"].c_custkey, tables["customer"].c_nationkey, strict=True))
    at = dict(zip(tables["supplier"].s_suppkey, tables["supplier"].s_nationkey, strict=True))
    pairs = {(int(nation_of[customer_of[o]]), int(at[s])) for o, s in zip(tables["lineitem"].l_orderkey, tables["lineitem"].l_suppkey, strict=True) if customer_of.get(o) in nation_of and s in at}
    arcs = {(a, b): 1.0 + (a * 3 + b * 5) % 10 for a, b in pairs if a != b}
    cost, queue = {}, [(0.0, 0)]
    while queue:
        so_far, node = heapq.heappop(queue)
        if node not in cost:
            cost[node] = so_far
            for (a, b), more in arcs.items():
                if a == node:
                    heapq.heappush(queue, (so_far + more, b))
    run = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())
    assert any((a * 7 + b * 13) % 11 >= 2 for a, b in arcs)
    assert run("network_arcs") == sorted([(a, b, w) for (a, b), w in arcs.items()] + [(b, a, w) for (a, b), w in arcs.items()])
    assert run("sssp") == sorted(cost.items())
    assert run("service_area") == sorted((n, w) for n, w in cost.items() if w <= 7)
    assert run("closest_facility") == [min(((n, cost[n]) for n in (5, 9, 17, 21) if n in cost), key=lambda x: (x[1], x[0]))]
