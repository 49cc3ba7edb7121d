"""Zonal statistics, metrics, overlays, tiling and mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from geospan.functions import geometry as G
from geospan.functions import numeric as N
from geospan.operators import metrics as M
from geospan.operators import raster as R
from geospan.operators import zonal as Z
from geospan.plans.bindings import DEM_SQL, dem
from geospan.plans.registry import query, r6, table

c = F.col
STATS_SQL = f"""count(*) AS count, {r6("sum(z)", "1e3")} AS sum, {r6("avg(z)", "1e3")} AS mean, {r6("stddev_pop(z)", "1e3")} AS std, min(z) AS min, max(z) AS max, {r6("median(z)", "1e4")} AS median, count(DISTINCT z) AS variety,
 {r6("quantile_cont(z, 0.25)", "1e4")} AS p25, {r6("quantile_cont(z, 0.5)", "1e4")} AS p50, {r6("quantile_cont(z, 0.75)", "1e4")} AS p75"""


def _tidy(df):
    return df.withColumns({n: N.rounded(c(n), 3 if n in ("sum", "mean", "std") else 4) for n in ("sum", "mean", "std", "median", "p25", "p50", "p75") if n in df.columns})


@query("zonal_raster", f"SELECT CAST(row // 25 AS BIGINT) AS zone_id, {STATS_SQL} FROM {DEM_SQL} GROUP BY 1")
def zonal_raster(spark, sf_dir):
    """Statistics of order totals by strips of 25 rows; the zones are a second raster."""
    pixels = dem(spark, sf_dir)
    zones = pixels.select("row", "col", F.expr("row div 25").alias("zone"))
    return _tidy(Z.zonal_join(pixels, zones, value="z", percentiles=[25, 50, 75]))


@query("zonal_attribute", f"SELECT o_orderpriority AS zone_id, count(*) AS count, {r6('avg(o_totalprice)', '1e3')} AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1")
def zonal_attribute(spark, sf_dir):
    out = Z.zonal_statistics(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", stats=("count", "mean", "min", "max"))
    return out.withColumn("mean", N.rounded(c("mean"), 3))


@query(
    "zonal_rollup",
    f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {r6('avg(o_totalprice)', '1e3')} AS mean FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
)
def zonal_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), N.rounded(F.avg("o_totalprice"), 3).alias("mean"))


ZONES_SQL = "(SELECT n_nationkey AS zone, n_nationkey % 5 * 18 + 1.25e0 AS x1, -(n_nationkey // 5 * 4 + 9.75e0) AS y1, n_nationkey % 5 * 18 + 23.25e0 AS x2, -(n_nationkey // 5 * 4 + 1.25e0) AS y2 FROM nation)"


@query(
    "zonal_vector",
    f"SELECT CAST(zone AS BIGINT) AS zone_id, {STATS_SQL} FROM {DEM_SQL} JOIN {ZONES_SQL} ON col + 0.5 > x1 AND col + 0.5 < x2 AND -(row + 0.5) > y1 AND -(row + 0.5) < y2 GROUP BY 1",
)
def zonal_vector(spark, sf_dir):
    """Overlapping boxes as polygons; pixels belong by their centres."""
    k = c("n_nationkey")
    x1, y2 = k % 5 * 18 + 1.25, -(F.floor(k / 5) * 4 + 1.25)
    zones = table(spark, sf_dir, "nation").select(k.cast("long").alias("zone"), G.box_ring(x1, y2 - 8.5, x1 + 22, y2).alias("ring"))
    return _tidy(Z.zonal_vector(dem(spark, sf_dir), zones, R.Transform(), 16.0, value="z", percentiles=[25, 50, 75]))


@query(
    "weighted_overlay",
    f"""WITH d AS (SELECT row, col, z, (row * 7 + col * 13) % 101 AS q FROM {DEM_SQL}), m AS (SELECT min(z) AS z0, max(z) AS z1, min(q) AS q0, max(q) AS q1 FROM d)
SELECT row, col, {r6("(z - z0) / (z1 - z0) * (3e0 / 4) + (q - q0) / (q1 - q0) * (1e0 / 4)")} AS suitability FROM d, m""",
)
def weighted_overlay(spark, sf_dir):
    pixels = dem(spark, sf_dir)
    other = pixels.select("row", "col", ((c("row") * 7 + c("col") * 13) % 101).cast("double").alias("value"))
    out = Z.weighted_overlay({"a": pixels.withColumnRenamed("z", "value"), "b": other}, {"a": 3.0, "b": 1.0})
    return out.withColumn("suitability", N.rounded(c("suitability")))


@query("change_pair", f"SELECT row, col, CAST(abs(z - (z * 0.9e0 + (row * 7 + col) % 50 * 500)) > 12000 AS INTEGER) AS change FROM {DEM_SQL}")
def change_pair(spark, sf_dir):
    before = dem(spark, sf_dir).withColumnRenamed("z", "value")
    after = before.withColumn("value", c("value") * 0.9 + (c("row") * 7 + c("col")) % 50 * 500)
    return Z.change_pair(before, after, 12000.0)


@query(
    "display_stretch",
    f"""WITH d AS (SELECT * FROM {DEM_SQL}), p AS (SELECT quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM d)
SELECT row, col, CAST(floor(least(greatest((z - lo) / (hi - lo + 1e-8), 0), 1) * 255 + 1e-9) AS INTEGER) AS z FROM d, p""",
)
def display_stretch(spark, sf_dir):
    return Z.stretch(dem(spark, sf_dir))


LABELS = "(SELECT quality AS pred, toxic AS target FROM labels)"
BINARY = f"""WITH s AS (SELECT CAST(sum(pred * target) AS DOUBLE) AS tp, CAST(sum(pred) AS DOUBLE) AS p, CAST(sum(target) AS DOUBLE) AS t, avg(CAST(pred = target AS DOUBLE)) AS acc FROM {LABELS}),
 q AS (SELECT *, tp / (tp + (p - tp) + 1e-8) AS pr, tp / (tp + (t - tp) + 1e-8) AS re FROM s)"""


def _metric(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        pairs = table(spark, sf_dir, "labels").select(c("quality").alias("pred"), c("toxic").alias("target"))
        return M.evaluate(pairs, [name]).select(N.rounded(c(name)).alias("value"))

    query(f"metric_{name}", f"{BINARY} SELECT {r6(sql)} AS value FROM q")(run)


_metric("iou", "(tp + 1e-6) / (p + t - tp + 1e-6)")
_metric("dice", "(2 * tp + 1e-6) / (p + t + 1e-6)")
_metric("precision", "pr")
_metric("recall", "re")
_metric("f1", "2 * pr * re / (pr + re + 1e-8)")
_metric("accuracy", "acc")

FIT = "(SELECT z / 5e5 * 0.9e0 + 0.02e0 AS pred, z / 5e5 AS target FROM " + DEM_SQL + ")"


def _regression(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        pairs = dem(spark, sf_dir).select((c("z") / 5e5 * 0.9 + 0.02).alias("pred"), (c("z") / 5e5).alias("target"))
        return M.evaluate(pairs, [name]).select(N.rounded(c(name)).alias("value"))

    query(f"metric_{name}", f"SELECT {r6(sql)} AS value FROM {FIT}")(run)


_regression("mse", "avg((pred - target) * (pred - target))")
_regression("rmse", "sqrt(avg((pred - target) * (pred - target)))")
_regression("mae", "avg(abs(pred - target))")
_regression("psnr", "10 * log10(1 / (avg((pred - target) * (pred - target)) + 1e-8))")
_regression("r2", "1 - sum((target - pred) * (target - pred)) / (var_pop(target) * count(*) + 1e-8)")


@query("metric_psnr_exact", f"SELECT CASE WHEN avg((pred - target) ** 2) = 0 THEN CAST('inf' AS DOUBLE) ELSE {r6('10 * log10(1 / avg((pred - target) ** 2))')} END AS value FROM {FIT}")
def metric_psnr_exact(spark, sf_dir):
    pairs = dem(spark, sf_dir).select((c("z") / 5e5 * 0.9 + 0.02).alias("pred"), (c("z") / 5e5).alias("target"))
    return pairs.agg(N.rounded(M.psnr_exact()).alias("value"))


@query(
    "mean_iou",
    f"""WITH d AS (SELECT label AS target, vec_id % 7 % 10 AS pred FROM embeddings), c AS (SELECT k AS cls FROM range(0, 10) r(k)), s AS (SELECT cls, CAST(count(*) FILTER (pred = cls AND target = cls) AS DOUBLE) AS b, count(*) FILTER (pred = cls) AS p, count(*) FILTER (target = cls) AS t FROM d, c GROUP BY cls)
SELECT {r6("avg((b + 1e-6) / (p + t - b + 1e-6))")} AS mean_iou FROM s WHERE t > 0""",
)
def mean_iou(spark, sf_dir):
    pairs = table(spark, sf_dir, "embeddings").select((c("vec_id") % 7 % 10).cast("int").alias("pred"), c("label").alias("target"))
    return M.mean_iou(pairs, 10).select(N.rounded(c("mean_iou")).alias("mean_iou"))


TILED = f"""t AS (SELECT row, col, z, tr, tc FROM {DEM_SQL}, range(0, 1000) a(tr), range(0, 20) b(tc) WHERE tr >= greatest(0, ceil((row - 32 + 1) / 24e0)) AND tr <= row // 24 AND tc >= greatest(0, ceil((col - 32 + 1) / 24e0)) AND tc <= col // 24)"""


@query("tiles", f"WITH {TILED} SELECT CAST(tr AS BIGINT) AS tile_row, CAST(tc AS BIGINT) AS tile_col, count(*) AS n, {r6('avg(z)', '1e3')} AS mean, 'z0/r' || tr || '/c' || tc AS key FROM t GROUP BY tr, tc")
def tiles(spark, sf_dir):
    """Tiles of 32 pixels that overlap by 8, with their keys and means."""
    tiled = R.tiles(dem(spark, sf_dir), 32, 8)
    return tiled.groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"), N.rounded(F.avg("z"), 3).alias("mean")).withColumn("key", R.tile_key(F.lit(0), c("tile_row"), c("tile_col")))


@query(
    "tile_shifted",
    f"""WITH d AS (SELECT * FROM {DEM_SQL}), s AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM d), a AS (SELECT i AS n, greatest(0, least(i * 28 + 32, h) - 32) AS st FROM s, range(0, 1000) r(i) WHERE i * 28 < h - 4), b AS (SELECT i AS n, greatest(0, least(i * 28 + 32, w) - 32) AS st FROM s, range(0, 1000) r(i) WHERE i * 28 < w - 4)
SELECT CAST(a.n AS BIGINT) AS tile_row, CAST(b.n AS BIGINT) AS tile_col, CAST(any_value(a.st) AS BIGINT) AS row_start, CAST(any_value(b.st) AS BIGINT) AS col_start, count(*) AS n FROM d JOIN a ON row >= a.st AND row < a.st + 32 JOIN b ON col >= b.st AND col < b.st + 32 GROUP BY 1, 2""",
)
def tile_shifted(spark, sf_dir):
    pixels = dem(spark, sf_dir)
    h, w = R.shape(pixels)
    out = R.shifted_tiles(pixels, h, w, 32, 4)
    return out.groupBy("tile_row", "tile_col").agg(F.max("tile_row_start").alias("row_start"), F.max("tile_col_start").alias("col_start"), F.count("*").alias("n"))


@query("tile_grid", f"WITH s AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM {DEM_SQL}) SELECT CAST(r AS BIGINT) AS tile_row, CAST(q AS BIGINT) AS tile_col, CAST(r * 24 AS BIGINT) AS row_off, CAST(q * 24 AS BIGINT) AS col_off, CAST(least(32, h - r * 24) AS BIGINT) AS height, CAST(least(32, w - q * 24) AS BIGINT) AS width FROM s, range(0, 1000) a(r), range(0, 1000) b(q) WHERE r * 24 < h AND q * 24 < w")
def tile_grid(spark, sf_dir):
    h, w = R.shape(dem(spark, sf_dir))
    return R.tile_grid(spark, h, w, 32, 8)


@query("mosaic", f"WITH {TILED} SELECT row, col, max_by(z + tr * 10 + tc, tr * 1000 + tc) AS z FROM t GROUP BY row, col")
def mosaic(spark, sf_dir):
    """The last tile wins; each tile is offset so that it shows."""
    pixels = dem(spark, sf_dir)
    h, w = R.shape(pixels)
    tiled = R.tiles(pixels, 32, 8).withColumn("z", c("z") + c("tile_row") * 10 + c("tile_col")).withColumn("seq", c("tile_row") * 1000 + c("tile_col"))
    return R.mosaic(tiled, h, w)


@query("stitch", f"WITH {TILED} SELECT row, col, {r6('avg(z + tr * 10 + tc)', '1e3')} AS z FROM t GROUP BY row, col")
def stitch(spark, sf_dir):
    pixels = dem(spark, sf_dir)
    h, w = R.shape(pixels)
    tiled = R.tiles(pixels, 32, 8).withColumn("z", c("z") + c("tile_row") * 10 + c("tile_col"))
    return R.stitch(tiled, h, w).withColumn("z", N.rounded(c("z"), 3))


@query("pad", f"WITH d AS (SELECT * FROM {DEM_SQL}), s AS (SELECT max(row) + 1 AS h FROM d) SELECT * FROM d UNION ALL SELECT r, q, 0 FROM s, range(0, 100000) a(r), range(0, 120) b(q) WHERE r < h + 5 AND (r >= h OR q >= 100)")
def pad(spark, sf_dir):
    pixels = dem(spark, sf_dir)
    h, w = R.shape(pixels)
    return R.pad(pixels, h, w, h + 5, 120)


#: The target grid of half the size, its places in the source, and the raster's size.
ZOOM = f"""d AS (SELECT * FROM {DEM_SQL}), e AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w, CAST(round_even((max(row) + 1) * 0.5e0, 0) AS BIGINT) AS oh, CAST(round_even((max(col) + 1) * 0.5e0, 0) AS BIGINT) AS ow FROM d),
 g AS (SELECT r AS row, q AS col, r * CAST(h - 1 AS DOUBLE) / CAST(greatest(oh - 1, 1) AS DOUBLE) AS sr, q * CAST(w - 1 AS DOUBLE) / CAST(greatest(ow - 1, 1) AS DOUBLE) AS sc, h, w FROM e, range(0, 100000) a(r), range(0, 50) b(q) WHERE r < oh AND q < ow)"""


def _sized(spark, sf_dir):
    pixels = dem(spark, sf_dir)
    return pixels, *R.shape(pixels)


@query("resample_nearest", f"WITH {ZOOM} SELECT g.row, g.col, d.z FROM g JOIN d ON d.row = CAST(floor(sr + 0.5e0) AS BIGINT) AND d.col = CAST(floor(sc + 0.5e0) AS BIGINT)")
def resample_nearest(spark, sf_dir):
    pixels, h, w = _sized(spark, sf_dir)
    return R.resample(pixels, h, w, 0.5, "nearest")


@query(
    "resample_bilinear",
    f"""WITH {ZOOM},
 k AS (SELECT row, col, CAST(least(floor(sr) + i, h - 1) AS BIGINT) AS a, CAST(least(floor(sc) + j, w - 1) AS BIGINT) AS b, (CASE WHEN i = 0 THEN 1 - (sr - floor(sr)) ELSE sr - floor(sr) END) * (CASE WHEN j = 0 THEN 1 - (sc - floor(sc)) ELSE sc - floor(sc) END) AS wt FROM g, range(0, 2) x(i), range(0, 2) y(j))
SELECT k.row, k.col, {r6("sum(wt * z)", "1e3")} AS z FROM k JOIN d ON d.row = a AND d.col = b GROUP BY 1, 2""",
)
def resample_bilinear(spark, sf_dir):
    pixels, h, w = _sized(spark, sf_dir)
    return R.resample(pixels, h, w, 0.5).withColumn("z", N.rounded(c("z"), 3))
