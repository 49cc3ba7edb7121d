"""What was added around the operators: judgements, journals, the zoo, scenes, warps, networks, the service and the command line."""

import http.client
import json
import math
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from geospan import serving, workflow, zoo
from geospan.__main__ import main
from geospan.functions import geometry as G
from geospan.operators import geostat as K
from geospan.operators import inference, joins, nets, synthesis
from geospan.operators import network as net
from geospan.operators import priorities as P
from geospan.operators import raster as R
from geospan.operators import vector as V
from geospan.streaming import events as E
from tests.test_operators import array_of, grid_of


def test_priorities(spark):
    """Against the eigenvectors of random judgements, many judges at once; given halves are completed."""
    rng = np.random.default_rng(1)
    rows, wanted = [], {}
    for judge in range(20):
        n = int(rng.integers(1, 6))
        m = np.ones((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                m[i, j] = rng.choice([1 / 5, 1 / 3, 1 / 2, 1, 2, 3, 5])
                m[j, i] = 1 / m[i, j]
                rows.append((judge, i, j, float(m[i, j])))
        if n == 1:
            rows.append((judge, 0, 0, 1.0))
        values, vectors = np.linalg.eig(m)
        k = int(values.real.argmax())
        w = np.abs(vectors[:, k].real)
        index = [0.0, 0.0, 0.58, 0.90, 1.12, 1.24][n]
        wanted[judge] = (w / w.sum(), (values[k].real - n) / (n - 1) / index if n > 1 else 0.0)
    found = {r.judge: r for r in P.priorities(spark.createDataFrame(rows, "judge int, i int, j int, a double"), ["judge"]).collect()}
    for judge, (w, ratio) in wanted.items():
        assert np.allclose(found[judge].weights, w, atol=1e-6) and found[judge].consistency_ratio == pytest.approx(ratio, abs=1e-6)
        if len(w) > 1:
            one = P.AHP(list(range(len(w)))).fit([[next((a for k, x, y, a in rows if (k, x, y) == (judge, i, j)), None) or 1 / next((a for k, x, y, a in rows if (k, x, y) == (judge, j, i)), 1.0) for j in range(len(w))] for i in range(len(w))])
            assert np.allclose(list(one.weights.values()), w, atol=1e-6) and one.consistency_ratio == pytest.approx(ratio, abs=1e-6)
    with pytest.raises(ValueError):
        P.AHP(["a", "b"]).fit([[1, 2]])
    assert P.AHP(list("abc"), strict=True).fit([[1, 2, 5], [0.5, 1, 2], [0.2, 0.5, 1]]).consistency_ratio > P.AHP(list("abc")).fit([[1, 2, 5], [0.5, 1, 2], [0.2, 0.5, 1]]).consistency_ratio


def test_journals(spark, tmp_path):
    chain = workflow.Pipeline(workflow.PipelineConfig("double", "Double", seed=42)).add_step(lambda df: df.withColumn("v", F.col("id") * 2))
    assert [r.v for r in chain(spark.range(3)).collect()] == [0, 2, 4]
    for _ in range(2):
        chain.run(spark.range(3)).append(spark, str(tmp_path / "runs"))
    broken = workflow.Pipeline(workflow.PipelineConfig("broken"), lambda given: given["missing"])
    with pytest.raises(KeyError):
        broken.run({"a": 1})
    broken.runs[0].append(spark, str(tmp_path / "runs"))
    workflow.Journal("waiting").note("setting", "name", "x")
    waiting = workflow.Journal("waiting")
    waiting.note("setting", "name", "x")
    waiting.append(spark, str(tmp_path / "runs"))
    rows = workflow.runs(spark.read.parquet(str(tmp_path / "runs"))).collect()
    assert sorted((r.pipeline_id, r.status, r.steps) for r in rows) == [("broken", "FAILED", 1), ("double", "COMPLETED", 1), ("double", "COMPLETED", 1), ("waiting", "PENDING", 0)]
    failed = next(r for r in rows if r.status == "FAILED")
    assert failed.inputs == {"a": "1"} and "missing" in failed.error and failed.seconds >= 0 and waiting.status == "PENDING"
    with pytest.raises(AttributeError):
        chain.config.nothing
    assert chain.config.seed == 42 and workflow.Pipeline.from_config(chain.config).config.name == "Double"


def test_registries(spark):
    assert len(zoo.entries()) == 59 and zoo.MODELS.get("ship_detector_large")["num_classes"] == 5 and zoo.MODELS.get("nothing") is None
    assert set(zoo.list_models("detection", "energy")) == {f"{n}_{s}" for n in ("solar_panel_detector", "wind_turbine_detector", "oil_tank_detector") for s in ("tiny", "base")}
    assert zoo.models(spark, "regression").count() == 4 and zoo.models(spark, domain="sar").count() == 3
    zoo.register_capability("water", "Water", "water", "beta", pipeline_id="water_detection")
    assert zoo.CAPABILITIES.where(maturity="beta") == ["water"] and zoo.CAPABILITIES.table(spark).first().pipeline_id == "water_detection"
    with pytest.raises(ValueError):
        zoo.register_capability("x", "X", "nowhere")
    loaded = zoo.Loaded()
    loaded.register("m", lambda: object())
    assert loaded.get("m") is loaded.get("m") and loaded.get("n") is None and loaded.ids() == ["m"]
    loaded.clear_cache()
    assert {"ship_detection", "change_detection", "water_detection", "super_resolution"} <= set(workflow.PipelineRegistry.ids())
    a, b = (grid_of(spark, [[0.0, 0.9]], "value"), grid_of(spark, [[0.0, 0.1]], "value"))
    run = workflow.PipelineRegistry.create("change_detection").run({"input1": a, "input2": b})
    assert run.status == "COMPLETED" and "change" in run.outputs
    big = zoo.super_resolution().steps[0]({"input": grid_of(spark, np.arange(12.0).reshape(3, 4))})["enhanced"]
    assert big.count() == 48
    row = spark.range(1).select(zoo.product("index", F.lit("ndvi"), F.lit("a"), mean=F.lit(0.5)).alias("p"), zoo.product("index", F.lit("ndvi"), F.lit("b")).alias("q")).first()
    assert row.p.product_type == "index" and row.p.properties == {"mean": "0.5"} and row.p.product_id != row.q.product_id
    with pytest.raises(ValueError):
        zoo.product("song", F.lit("x"))


def test_cache(spark, tmp_path):
    root = str(tmp_path / "cache")
    assert zoo.cache_info(spark, zoo.cache_dir(root)).collect() == [] and not zoo.is_cached("m", root)
    (tmp_path / "cache" / "m").mkdir()
    (tmp_path / "cache" / "m" / "w.bin").write_bytes(b"x" * 3_000_000)
    assert [tuple(r) for r in zoo.cache_info(spark, root).collect()] == [("m", 1, 3_000_000, 2.86)] and zoo.is_cached("m", root)
    assert zoo.clear_cache(root=root) == 1 and zoo.clear_cache("m", root) == 0
    evidence = workflow.Evidence.of(__file__, "this test")
    told = workflow.evidence(spark, __file__).first()
    assert (told.checksum, told["size"]) == (evidence.checksum, evidence.size)


def test_scenes(spark):
    """The generator's stream of numbers, replayed here."""
    for seed in (3, 42):
        draw = np.random.RandomState(seed)
        mask = np.zeros((40, 50), int)
        y, x = np.mgrid[0:40, 0:50]
        for _ in range(draw.randint(2, 6)):
            cx, cy, radius, cls = draw.randint(0, 50), draw.randint(0, 40), draw.randint(10, 30), draw.randint(1, 4)
            mask[np.hypot(x - cx, y - cy) <= radius] = cls
        found = synthesis.SyntheticGenerator(spark, seed).mask(40, 50, 4)
        assert (array_of(found, "cls", (40, 50)) == mask).all()
        many = synthesis.masks(spark, spark.createDataFrame([(3,), (42,)], "seed long"), 40, 50, 4).where(F.col("seed") == seed)
        assert (array_of(many, "cls", (40, 50)) == mask).all()
    draw = np.random.RandomState(5)
    image = draw.rand(3, 32, 32).astype(np.float32) * 0.3 + 0.2
    for _ in range(draw.randint(1, 5)):
        cx, cy, size = draw.randint(10, 22), draw.randint(10, 22), draw.randint(5, 15)
        image[:, max(0, cy - size // 2) : cy + size // 2, max(0, cx - size // 2) : cx + size // 2] = (draw.rand(3).astype(np.float32) * 0.5 + 0.5)[:, None, None]
    found = synthesis.SyntheticGenerator(spark, 5).rgb_image(32, 32)
    assert all(np.allclose(array_of(found, n, (32, 32)), image[k], atol=1e-6) for k, n in enumerate("rgb"))
    before, after, change = synthesis.SyntheticGenerator(spark, 6).change_pair(32, 32)
    moved = np.any([array_of(before, n, (32, 32)) != array_of(after, n, (32, 32)) for n in "rgb"], axis=0)
    assert (moved <= (array_of(change, "change", (32, 32)) == 1)).all() and moved.any()
    rows = synthesis.SyntheticGenerator(spark, 7).tabular_features(5, 3).orderBy("sample").collect()
    assert np.allclose([r.features for r in rows], np.random.RandomState(7).rand(5, 3).astype(np.float32))


def test_padding_and_sizes(spark):
    z = np.random.default_rng(2).normal(size=(5, 4))
    for mode in ("edge", "reflect", "symmetric", "wrap", "constant"):
        found = R.pad_by(grid_of(spark, z), 5, 4, 19, 11, mode)
        assert np.allclose(array_of(found, "z", (19, 11)), np.pad(z, ((0, 14), (0, 7)), mode))
    with pytest.raises(ValueError):
        R.pad_by(grid_of(spark, z), 5, 4, 6, 6, "nothing")
    flat = R.resize(grid_of(spark, np.full((9, 7), 3.0)), 9, 7, 4, 20)
    assert np.allclose(array_of(flat, "z", (4, 20)), 3.0)
    slope = np.tile(np.arange(20.0), (6, 1))
    twice = array_of(R.resize(grid_of(spark, slope), 6, 20, 6, 40), "z", (6, 40))
    assert np.allclose(twice[:, 1:-1], (np.arange(40) / 2 - 0.25)[1:-1])
    half = array_of(R.resize(grid_of(spark, slope), 6, 20, 3, 10), "z", (3, 10))
    assert np.allclose(half[:, 3:-3], (np.arange(10) * 2 + 0.5)[3:-3])
    image = np.arange(24.0).reshape(2, 4, 3)
    df = spark.createDataFrame([(image.ravel().tolist(),)], "data array<double>")
    first = R.to_channels_first(df, (2, 4, 3))
    assert first.first().data == image.transpose(2, 0, 1).ravel().tolist()
    assert R.to_channels_last(first, (3, 2, 4)).first().data == image.ravel().tolist()
    assert R.to_channels_first(df, (4, 6)) is df and R.to_channels_first(df, (2, 6, 2)) is df


def test_warp(spark):
    """A surface that is linear in the other system's coordinates comes out as it is there."""
    degrees = R.Transform(a=0.05, c=5.0, e=-0.05, f=48.0)
    r, k = np.mgrid[0:30, 0:40] + 0.5
    lon, lat = 5.0 + 0.05 * k, 48.0 - 0.05 * r
    x, y = np.radians(lon) * 6378137, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * 6378137
    z = (x + 2 * y) / 1e5
    out, new = R.reproject(grid_of(spark, z), degrees, G.to_mercator, G.from_mercator, nodata=float("nan"))
    h, w = R.shape(out)
    got = array_of(out, "z", (h, w))
    rr, kk = np.mgrid[0:h, 0:w] + 0.5
    wanted = (new.a * kk + new.c + 2 * (new.e * rr + new.f)) / 1e5
    inside = np.zeros((h, w), bool)
    inside[2:-2, 2:-2] = True
    assert abs(h * w - 30 * 40) < 400 and np.isfinite(got[inside]).all() and np.allclose(got[inside], wanted[inside], atol=2e-3)
    same, _ = R.reproject(grid_of(spark, z), degrees, lambda a, b: (a, b), lambda a, b: (a, b), resolution=0.05)
    assert np.allclose(array_of(same, "z", (30, 40)), z, atol=1e-6)


def test_networks(spark):
    """Published numbers of parameters, layers against plain loops, and checkpoints."""
    assert [nets.count_parameters(nets.ResNet(d)) for d in (18, 34, 50)] == [11_689_512, 21_797_672, 25_557_032]
    rng = np.random.default_rng(3)
    conv = nets.Conv(2, 3, 3, 2, 1, bias=True)
    w = nets.fresh(conv, 4) | {"bias": rng.normal(size=3)}
    x = rng.normal(size=(1, 2, 7, 6))
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    wanted = np.array([[[(padded[0, :, i * 2 : i * 2 + 3, j * 2 : j * 2 + 3] * w["weight"][o]).sum() + w["bias"][o] for j in range(3)] for i in range(4)] for o in range(3)])
    assert np.allclose(conv(x, w)[0], wanted)
    assert nets.pool(2, 2)(x, {})[0, 0, 0, 0] == x[0, 0, :2, :2].max()
    norm = nets.Norm(2)
    assert np.allclose(norm(x, nets.fresh(norm)), x / np.sqrt(1 + 1e-5))
    for layer, shape, out in ((nets.UNet(3, 5, (4, 6, 8, 10)), (2, 3, 16, 16), (2, 5, 16, 16)), (nets.ResNet(18, 2, 7), (1, 2, 32, 32), (1, 7)), (nets.ResNet(50, 1, 4), (1, 1, 32, 32), (1, 4)), (nets.srcnn(1), (1, 1, 9, 9), (1, 1, 9, 9)), (nets.Siamese(2, 3, (4, 6)), (1, 4, 8, 8), (1, 3, 8, 8)), (nets.segmentation_head(4, 3), (1, 4, 5, 5), (1, 3, 5, 5)), (nets.classification_head(4, 3), (1, 4, 5, 5), (1, 3))):
        weights = nets.fresh(layer, 1)
        assert layer(rng.normal(size=shape), weights).shape == out and nets.key_difference(layer, weights) == ([], [])
    back = nets.ResNet(18, 1, 2)
    features = back.features(rng.normal(size=(1, 1, 64, 64)), nets.fresh(back))
    pyramid = nets.Pyramid(back.widths, 8)
    assert [f.shape for f in pyramid.levels(features, nets.fresh(pyramid))] == [(1, 8, 16 >> k, 16 >> k) for k in range(4)]
    heads = nets.detection_head(8, 3, 2)
    assert {n: h(rng.normal(size=(1, 8, 4, 4)), nets.fresh(h)).shape[1] for n, h in heads.items()} == {"classes": 6, "boxes": 8}
    with pytest.raises(ValueError, match="unknown"):
        nets.check(conv, w | {"more": np.zeros(1)})
    layer = nets.srcnn(1)
    weights = nets.fresh(layer, 2)
    images = rng.normal(size=(5, 64))
    rows = nets.applied(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(images)], "id long, data array<double>"), layer, weights, (1, 8, 8), at_once=2).orderBy("id").collect()
    assert np.allclose([r.output for r in rows], layer(images.reshape(5, 1, 8, 8), weights).reshape(5, -1)) and rows[0].shape == [1, 8, 8]


def onnx_linear(weights):
    """A model file of one matrix product, written byte by byte."""

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3]) + varint(value)
        return bytes([number << 3 | 2]) + varint(len(value)) + value

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def value(name, *dims):
        shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d.encode())) for d in dims)
        return field(1, name.encode()) + field(2, field(1, field(1, 1) + field(2, shape)))

    n, m = weights.shape
    tensor = field(1, n) + field(1, m) + field(2, 1) + field(8, b"w") + field(9, weights.astype("<f4").tobytes())
    node = field(1, b"x") + field(1, b"w") + field(2, b"y") + field(4, b"MatMul")
    graph = field(1, node) + field(2, b"g") + field(5, tensor) + field(11, value("x", "n", n)) + field(12, value("y", "n", m))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_onnx_scores(spark, tmp_path):
    rng = np.random.default_rng(4)
    weights, x = rng.normal(size=(6, 2)), rng.normal(size=(7, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, data array<double>")
    found = inference.onnx_scores(rows, onnx_linear(weights), "data", "id").orderBy("id").collect()
    assert np.allclose([r.scores for r in found], x @ weights, atol=1e-5)
    (tmp_path / "m.onnx").write_bytes(onnx_linear(weights))
    rows.write.parquet(str(tmp_path / "in"))
    assert main(["infer", str(tmp_path / "m.onnx"), str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_morans_i(spark):
    """All columns against matrices."""
    rng = np.random.default_rng(5)
    n = 60
    x, y, v = rng.uniform(0, 10, n), rng.uniform(0, 10, n), rng.normal(size=n)
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    df = spark.createDataFrame([(i, float(a), float(b), float(z)) for i, (a, b, z) in enumerate(zip(x, y, v, strict=True))], "id long, x double, y double, v double")
    for distance in (1.0, 2.5, None):
        w = (d <= (distance or d[np.triu_indices(n, 1)].mean())) & ~np.eye(n, dtype=bool)
        w = w / np.where(w.sum(1, keepdims=True) == 0, 1, w.sum(1, keepdims=True))
        z, s0 = v - v.mean(), w.sum()
        s1, s2 = 0.5 * ((w + w.T) ** 2).sum(), ((w.sum(0) + w.sum(1)) ** 2).sum()
        r = K.morans_i(df, distance).first()
        common = (n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0
        below = (n - 1) * (n - 2) * (n - 3) * s0 * s0
        assert r.statistic == pytest.approx(n / s0 * (w * np.outer(z, z)).sum() / (z * z).sum()) and r.expected == pytest.approx(-1 / (n - 1))
        lonely = (w.sum(1) == 0).any()
        if not lonely:
            kurtosis = (z**4).mean() / (z * z).mean() ** 2
            assert r.variance == pytest.approx(max(1e-10, (n * common - (n * n - n) * common) / below)) and r.z_score == pytest.approx((r.statistic - r.expected) / math.sqrt(r.variance))
            assert r.variance_randomised == pytest.approx((n * common - kurtosis * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / below - 1 / (n - 1) ** 2)
            assert r.p_value == pytest.approx(math.erfc(abs(r.z_score) / math.sqrt(2)))
    same = K.morans_i(df.withColumn("v", F.lit(1.0)), 2.0).first()
    assert (same.statistic, same.p_value, same.variance) == (0.0, 1.0, 0.0)


def test_distances_and_drift(spark):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(a + b)) for i, (a, b) in enumerate(p)], "id long, x double, y double, v double")
    assert K.max_distance(df) == pytest.approx(np.hypot(p[:, None, 0] - p[:, 0], p[:, None, 1] - p[:, 1]).max()) and K.max_distance(df.limit(0)) == 0.0
    assert K.max_distance(df.limit(1)) == 0.0 and len(K.variogram_bins(df, 5).collect()) == 5
    assert K.drift_matrix(df, "quadratic").columns == ["id", "drift_one", "drift_x", "drift_y", "drift_xx", "drift_yy", "drift_xy"] and K.drift_matrix(df, "constant").columns == ["id", "drift_one"]
    with pytest.raises(ValueError):
        K.drift_matrix(df, "cubic")


def plain_suppression(rows, least):
    kept = []
    for r in sorted(rows, key=lambda r: (r.image, -r.conf, r.id)):
        clear = True
        for k in kept:
            if k.image == r.image:
                w, h = max(0.0, min(k.x2, r.x2) - max(k.x1, r.x1)), max(0.0, min(k.y2, r.y2) - max(k.y1, r.y1))
                union = (k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - w * h
                clear = clear and not (union > 0 and w * h >= least * union)
        if clear:
            kept.append(r)
    return sorted((r.image, r.id) for r in kept)


def test_suppression_by_brute_force(spark):
    """In order, in rounds, and mixed; and the query over the shared table."""
    from geospan.plans.bindings import boxes

    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 20)) / 20, *(float(a) for a in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(*rng.integers(0, 60, (2, 400)), *rng.integers(1, 40, (2, 400)), strict=True))]
    df = spark.createDataFrame(rows, "id long, image int, conf double, x1 double, y1 double, x2 double, y2 double")
    for least in (0.2, 0.5):
        wanted = plain_suppression(df.collect(), least)
        assert sorted((r.image, r.id) for r in V.suppress(df, least).collect()) == wanted
        assert sorted((r.image, r.id) for r in V.suppress_in_rounds(df, least, cell=16.0).collect()) == wanted
        assert sorted((r.image, r.id) for r in V.suppress(df, least, most=133).collect()) == wanted
    from geospan.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    assert sorted((r.image, r.id) for r in QUERIES["nms"](spark, folder).collect()) == plain_suppression(boxes(spark, folder).collect(), 0.5)


def test_anti_join_with_nulls(spark):
    left = spark.createDataFrame([(1, None, 0.0, 0.0, 2.0, 2.0), (2, "a", 5.0, 5.0, 6.0, 6.0), (2, "a", 5.0, 5.0, 6.0, 6.0)], "id long, note string, xmin double, ymin double, xmax double, ymax double")
    right = spark.createDataFrame([(1.0, 1.0, 3.0, 3.0)], "xmin double, ymin double, xmax double, ymax double")
    assert [r.id for r in V.box_join(left, right, 4.0, "anti").collect()] == [2, 2]


def test_long_ways(spark):
    """A chain of many arcs, and the finder with its heuristics."""
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(0, 40, 100.0)], "src int, dst int, cost double")
    assert net.route(chain, 0, 40) == (list(range(41)), 40.0) and net.route(chain, 40, 0) is None
    nodes, ways = {i: (float(i), 0.0) for i in range(5)}, {i: [(i + 1, 1.0)] for i in range(4)}
    for name in ("euclidean", "manhattan", "none", None, lambda a, b: 0.0):
        assert net.AStarPathfinder(nodes, ways, name).find_path(0, 4)["path"] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        net.AStarPathfinder(nodes, ways, "dreams")


def test_spiral_mask(spark):
    """A long winding part is one part, over several bands of columns."""
    mask = np.zeros((31, 31), int)
    r, c, dr, dc = 0, 0, 0, 1
    mask[r, c] = 1
    for _ in range(2000):
        nr, nc = r + dr, c + dc
        ahead = (nr + dr, nc + dc)
        if not (0 <= nr < 31 and 0 <= nc < 31) or mask[nr, nc] or (0 <= ahead[0] < 31 and 0 <= ahead[1] < 31 and mask[ahead]):
            dr, dc = dc, -dr
            nr, nc = r + dr, c + dc
            if not (0 <= nr < 31 and 0 <= nc < 31) or mask[nr, nc] or mask[min(30, max(0, nr + dr)), min(30, max(0, nc + dc))]:
                break
        r, c = nr, nc
        mask[r, c] = 1
    whole = int(mask.sum())
    kept = inference.small_objects_removed(grid_of(spark, mask, "mask"), whole - 1, band=4)
    assert (array_of(kept, "mask", mask.shape) == mask).all() and whole > 300
    assert not array_of(inference.small_objects_removed(grid_of(spark, mask, "mask"), whole, band=4), "mask", mask.shape).any()


def test_running_totals(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "value")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = E.running(stream, "event_type").writeStream.format("memory").queryName("totals").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    last = {r.event_type: (r.n, round(r.total, 6)) for r in spark.table("totals").groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")).collect()}
    assert last == {r.event_type: (r.n, round(r.total, 6)) for r in E.running(table, "event_type").collect()}


def test_service():
    service = serving.Service(api_key="k").add("detect", "d", lambda image: [(0, float(image.max()), 0, 0, 1, 1), (1, 0.1, 0, 0, 1, 1)]).add("segment", "s", lambda image: image > 1).add("infer", "i", lambda x: x * 2)
    running = serving.server(service)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    try:

        def ask(method, path, body=None, key="k", kind="application/json"):
            link = http.client.HTTPConnection("127.0.0.1", running.server_address[1], timeout=10)
            link.request(method, path, body if body is None or isinstance(body, bytes) else json.dumps(body), {"X-API-Key": key, "Content-Type": kind})
            answer = link.getresponse()
            return answer.status, json.loads(answer.read())

        assert ask("GET", "/health") == (200, {"status": "healthy"}) and ask("GET", "/health", key="x")[0] == 401 and ask("GET", "/nothing")[0] == 404
        assert len(ask("GET", "/models")[1]["models"]) == 59 and "capabilities" in ask("GET", "/capabilities")[1]
        image = {"height": 1, "width": 2, "data": [0.5, 2.0]}
        assert [d["confidence"] for d in ask("POST", "/detect/d", image)[1]["detections"]] == [2.0] and ask("POST", "/segment/s", image)[1]["mask"] == [[0, 1]]
        assert ask("POST", "/infer/i", {"data": [1, 2]})[1]["output"] == [2.0, 4.0]
        assert ask("POST", "/detect/x", image)[0] == 404 and ask("POST", "/detect/d", {"data": [1]})[0] == 422 and ask("POST", "/infer/i", b"[")[0] == 422 and ask("POST", "/infer/i", {"data": 1}, kind="text/plain")[0] == 415
        serving.MOST_BYTES, usual = 10, serving.MOST_BYTES
        try:
            assert ask("POST", "/infer/i", {"data": list(range(100))})[0] == 413
        finally:
            serving.MOST_BYTES = usual
    finally:
        running.shutdown()
        running.server_close()


def test_commands(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "zonal_raster" in capsys.readouterr().out
    assert main(["info"]) == 0 and json.loads(capsys.readouterr().out)["models"] == 59
    assert main(["zoo", "list", "--task", "regression", "--json"]) == 0 and len(capsys.readouterr().out.splitlines()) == 4
    assert main(["zoo", "where", "m", "--cache", str(tmp_path)]) == 0 and capsys.readouterr().out.strip().endswith("/m")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "w").write_bytes(struct.pack("<I", 7))
    (tmp_path / "sums").write_text(f"{workflow.Evidence.of(str(tmp_path / 'm' / 'w')).checksum}  w\n")
    assert main(["zoo", "verify", "m", "--cache", str(tmp_path), "--manifest", str(tmp_path / "sums")]) == 0
    (tmp_path / "sums").write_text("0" * 64 + "  w\n")
    assert main(["zoo", "verify", "m", "--cache", str(tmp_path), "--manifest", str(tmp_path / "sums")]) == 1
    assert main(["pipeline", "list"]) == 0 and "change_detection" in capsys.readouterr().out
    for name in ("a", "b"):
        grid_of(spark, [[0.0, 1.0]], "value").write.parquet(str(tmp_path / name))
    assert main(["pipeline", "run", "change_detection", f"input1={tmp_path / 'a'}", f"input2={tmp_path / 'b'}"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["status"] == "COMPLETED"
    assert main(["run", "nothing", "x"]) == 1


def test_projections(spark):
    """Known places, there and back, and systems that are not known."""
    rows = [(9.0, 0.0), (2.2944813, 48.8583701), (-3.0, 80.0), (10.5, -33.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    step = 1e-4
    near = [(11.5, 48.0), (11.5 + step, 48.0), (11.5, 48.0 + step), (9.0, 0.0), (9.0, 45.0)]
    p = [(r.x, r.y) for r in spark.createDataFrame(near, "lon double, lat double").select(*(c.alias(n) for c, n in zip(G.to_zone(F.col("lon"), F.col("lat"), 32), "xy", strict=True))).collect()]
    assert p[3] == (pytest.approx(500000), pytest.approx(0, abs=1e-6)) and p[4] == (pytest.approx(500000), pytest.approx(0.9996 * 4984944.378, abs=0.01))  # a quarter of the way along the meridian
    # The same scale east and north, and a right angle between them.
    e2, phi = 0.00669437999014, math.radians(48.0)
    across, along = 6378137 * math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2), 6378137 * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5
    east, north = ((q[0] - p[0][0], q[1] - p[0][1]) for q in p[1:3])
    assert math.hypot(*east) / across == pytest.approx(math.hypot(*north) / along, rel=2e-6) and abs(east[0] * north[0] + east[1] * north[1]) < 1e-3
    for code in (4326, 3857, 32632, 32732):
        there = df.select("lon", "lat", *(c.alias(n) for c, n in zip(G.reproject(F.col("lon"), F.col("lat"), 4326, code), "xy", strict=True)))
        back = there.select("lon", "lat", *(c.alias(n) for c, n in zip(G.reproject(F.col("x"), F.col("y"), code, 4326), "ab", strict=True)))
        assert all(r.a == pytest.approx(r.lon, abs=1e-7) and r.b == pytest.approx(r.lat, abs=1e-7) for r in back.where("abs(lon - 9) < 13").collect())
    with pytest.raises(ValueError):
        G.projection(27700)


def test_joins_by_order(spark):
    rng = np.random.default_rng(8)
    left = [(i, int(k) if k < 3 else None, float(t) if t < 95 else None) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(0, 100, 200), strict=True))]
    right = [(int(k), float(t), int(n)) for k, t, n in zip(rng.integers(0, 3, 60), rng.integers(0, 100, 60), range(60), strict=True)]
    l, r = spark.createDataFrame(left, "id int, k int, t double"), spark.createDataFrame(right, "k int, t double, n int")  # noqa: E741
    for width in (1.0, 7.0, 1000.0):
        found = {x.id: x.r_n for x in joins.asof_join(l, r, "t", ["k"], width).collect()}
        assert found == {i: max(((b, a, n) for a, b, n in right if a == k and b <= t), default=(0, 0, None))[2] if k is not None and t is not None else None for i, k, t in left}
        spans = spark.createDataFrame([(n, t, t + n % 9) for _, t, n in right] + [(99, 5.0, 4.0)], "n int, a double, b double")
        pairs = sorted((x.id, x.r_n) for x in joins.interval_join(l, spans, "t", "a", "b", width).collect())
        assert pairs == sorted((i, n) for i, _, t in left if t is not None for _, a, n in right if a <= t <= a + n % 9)
    assert joins.asof_join(l.limit(0), r, "t", ["k"], 1.0).count() == 0 and joins.asof_join(l, r.limit(0), "t", ["k"], 1.0).where("r_n IS NOT NULL").count() == 0


def test_interval_counts(spark):
    """As many as there are pairs, with null, equal and infinite places, and without a row for each pair."""
    rng = np.random.default_rng(9)
    odd = [None, float("inf"), float("-inf"), float("nan")]
    places = lambda n: [odd[i] if i < 4 else float(t) for i, t in enumerate(rng.integers(-20, 60, n))]
    points = [(int(k) if k < 3 else None, t) for k, t in zip(rng.integers(0, 4, 150), places(150), strict=True)]
    spans = [(i % 70, int(k) if k < 3 else None, a, b) for i, (k, a, b) in enumerate(zip(rng.integers(0, 4, 90), places(90), rng.permutation(np.array(places(90), object)), strict=True))]
    p, s = spark.createDataFrame(points, "k int, t double"), spark.createDataFrame(spans, "n int, k int, a double, b double")
    order = lambda t: (math.isnan(t), 0 if math.isnan(t) else t)
    wanted: dict = {}
    for n, k, a, b in spans:
        if k is not None and a is not None and b is not None:
            m = sum(order(a) <= order(t) <= order(b) for j, t in points if j == k and t is not None)
            wanted[n] = wanted.get(n, 0) + m
    for width in (1.0, 7.0, 1000.0):
        assert {r.n: r.m for r in joins.interval_counts(p, s.withColumnRenamed("n", "id"), "t", "a", "b", width, ["k"], "id").selectExpr("id AS n", "n AS m").collect()} == {n: m for n, m in wanted.items() if m}
    # 4e10 pairs
    wide = spark.range(200_000).selectExpr("id", "0 AS k", "id % 1000 AS a", "id % 1000 + 1000 AS b")
    assert joins.interval_counts(wide, wide, "a", "a", "b", 64.0, ["k"], "id").agg({"n": "sum"}).first()[0] == 200_000 * 200 * 1001 // 2


def test_parts_over_blocks(spark):
    """Against a flood fill, near the share of pixels at which parts wind most; null, repeated and negative pixels."""
    rng = np.random.default_rng(10)
    mask = (rng.random((70, 41)) < 0.6).astype(int)
    size, seen = np.zeros(mask.shape, int), np.zeros(mask.shape, bool)
    for start in zip(*mask.nonzero(), strict=True):
        if not seen[start]:
            part, todo = [], [start]
            seen[start] = True
            while todo:
                r, c = todo.pop()
                part.append((r, c))
                for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if 0 <= p[0] < 70 and 0 <= p[1] < 41 and mask[p] and not seen[p]:
                        seen[p] = True
                        todo.append(p)
            for p in part:
                size[p] = len(part)
    given = grid_of(spark, mask, "mask")
    for band, least in ((8, 3), (8, 20), (16, 200), (512, 3)):
        assert (array_of(inference.small_objects_removed(given, least, band=band), "mask", mask.shape) == (size > least)).all()
    moved = given.selectExpr("row - 33 AS row", "col - 20 AS col", "mask")
    odd = moved.unionByName(moved.where("row = 0")).unionByName(spark.createDataFrame([(None, 1, 1.0), (900, 900, None)], "row long, col long, mask double"))
    found = inference.small_objects_removed(odd, 3, band=8).collect()
    assert len(found) == 70 * 41 + 41 + 2 and sum(r["mask"] for r in found) == (size > 3).sum() + (size[33] > 3).sum()


def test_statistics_over_places(spark):
    """Points at one place, with one id, without a place: against all pairs."""
    rng = np.random.default_rng(11)
    rows = [(i if i < 190 else 7, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(rng.integers(0, 9, 200), rng.integers(0, 7, 200), rng.normal(5, 3, 200), strict=True))]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 3.0), (901, float("nan"), 1.0, 4.0)], "id long, x double, y double, v double")
    k, x, y, v = np.array(rows).T
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    other = k[:, None] != k
    found = sorted((r.a, r.b, round(r.d, 9)) for r in K.near_pairs(df, 2.5).collect())
    assert found == sorted((int(k[i]), int(k[j]), round(float(d[i, j]), 9)) for i, j in zip(*np.nonzero((d <= 2.5) & other), strict=True))
    upper = np.triu(np.ones(d.shape, bool), 1)
    bins = {r.bin: r for r in K.variogram_bins(df, 4, 6.0).collect()}
    for b in range(4):
        taken = upper & (d <= 6) & (np.maximum(0, np.ceil(d / 1.5) - 1) == b)
        assert bins[b].pairs == taken.sum() and bins[b].gamma == pytest.approx((0.5 * (v[:, None] - v) ** 2)[taken].mean())
    assert K.mean_distance(df) == pytest.approx(d[upper].mean())
    near, mean = (d <= 2.5) & other, np.array([*v, 3.0, 4.0])
    geary = K.gearys_c(df, 2.5).first()
    assert geary.statistic == pytest.approx(201 * ((v[:, None] - v) ** 2)[near].sum() / (2 * near.sum() * ((mean - mean.mean()) ** 2).sum()))
    single = df.where("id <> 7 AND x IS NOT NULL AND NOT isnan(x)")
    own = k != 7
    near, z = near[own][:, own], v[own] - v[own].mean()
    w = near / near.sum(1, keepdims=True)
    moran = K.morans_i(single, 2.5).first()
    assert moran.statistic == pytest.approx(len(z) / w.sum() * (z @ w @ z) / (z @ z))


def test_finer_cells(spark):
    """Crowded points are joined over finer cells and in shares; the pairs stay the same."""
    df = spark.range(3000).selectExpr("id", "double(id * 37 % 101) / 10 AS x", "double(id * 53 % 97) / 10 AS y", "double(id) AS v")
    assert K._fineness(df, 2.0)[0] == 1 and K._fineness(df, 10.0)[0] > 1
    at = df.toPandas()
    for distance in (2.0, 10.0):
        d = np.sqrt((at.x.to_numpy()[:, None] - at.x.to_numpy()) ** 2 + (at.y.to_numpy()[:, None] - at.y.to_numpy()) ** 2)
        assert K.near_pairs(df, distance).count() == (d <= distance).sum() - 3000


def test_kriging_over_blocks(spark):
    """Many samples, some at one place, against the one system of all; more of them than fit one system on the driver."""
    rng = np.random.default_rng(12)
    rows = [(i, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(rng.integers(0, 20, 300), rng.integers(0, 20, 300), rng.normal(5, 3, 300), strict=True))]
    known = spark.createDataFrame([*rows, (900, 1.0, 1.0, None)], "id long, x double, y double, v double")
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-2, 22, (40, 2)))] + [(100, 3.0, 3.0), (101, None, 1.0)], "id long, x double, y double")
    _, x, y, v = np.array(rows).T
    for kind in ("exponential", "spherical", "linear"):
        fitted = K.Variogram(kind)
        fitted.fitted = (0.5, 2.0, 7.0)
        k = np.ones((301, 301))
        k[:300, :300] = fitted.values(np.hypot(x[:, None] - x, y[:, None] - y))
        k[300, 300] = 0
        inverse = np.linalg.pinv(k, rcond=1e-10)
        for direct, block in ((2048, 1024), (0, 64)):
            found = {r.id: r for r in K.krige(known, targets, fitted, direct, block).collect()}
            assert len(found) == 42
            for t in targets.where("x IS NOT NULL").collect():
                b = np.append(fitted.values(np.hypot(x - t.x, y - t.y)), 1.0)
                w = inverse @ b
                assert found[t.id].prediction == pytest.approx(w[:300] @ v, abs=1e-6) and found[t.id].variance == pytest.approx(w @ b, abs=1e-6)
    fitted.fitted = (0.5, 0.0, 7.0)
    assert K.krige(known, targets, fitted, 0).first().prediction == pytest.approx(v.mean())
    many = spark.range(5001).selectExpr("id", "double(id % 80) AS x", "double(id div 80) AS y", "double(id % 7) AS v")
    fitted.fitted = (0.5, 2.0, 7.0)
    assert K.krige(many, many.where("id % 1000 = 3"), fitted).count() == 5


def test_suppression_of_the_best_first(spark):
    """Large images by cuts of the confidence, with ties, NaN and null, and one whose confidences are all alike; the same rows as in one task."""
    rng = np.random.default_rng(14)
    odd = {5: None, 9: float("nan")}
    low = rng.integers(0, 60, (900, 2))
    rows = [(i, i % 3, odd.get(i, float(c) / 40) if i % 3 < 2 else 0.5, *map(float, (*a, *(a + b)))) for i, (c, a, b) in enumerate(zip(rng.integers(0, 40, 900), low, rng.integers(5, 25, (900, 2)), strict=True))]
    df = spark.createDataFrame(rows, "id long, image long, conf double, x1 double, y1 double, x2 double, y2 double")
    wanted = sorted(r.id for r in V.suppress(df).collect())
    assert sorted(r.id for r in V.suppress(df, most=60).collect()) == wanted and len(wanted) < 850
    # No pairs are joined where confidences differ.
    before, V.suppress_in_rounds = V.suppress_in_rounds, None
    try:
        assert sorted(r.id for r in V.suppress(df.where("image < 2"), most=60).collect()) == [i for i in wanted if i % 3 < 2]
    finally:
        V.suppress_in_rounds = before
