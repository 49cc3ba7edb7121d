"""Neighbourhood queries on the raster of order totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from geospan.functions import numeric as N
from geospan.operators import focal as W
from geospan.operators import raster as R
from geospan.plans.bindings import DEM_SQL, dem
from geospan.plans.registry import query, r6

c = F.col


def _dem(spark, sf_dir, scale: float = 1.0):
    df = dem(spark, sf_dir)
    dims = R.shape(df)
    return (df if scale == 1.0 else df.withColumn("z", c("z") / scale)), dims


GRAD = f"""d AS (SELECT row, col, z / 1000 AS z FROM {DEM_SQL}), gx AS (SELECT *,
 CASE WHEN lag(z) OVER x IS NULL THEN (lead(z) OVER x - z) / 30 WHEN lead(z) OVER x IS NULL THEN (z - lag(z) OVER x) / 30 ELSE (lead(z) OVER x - lag(z) OVER x) / 60 END AS dx,
 CASE WHEN lag(z) OVER y IS NULL THEN (lead(z) OVER y - z) / 30 WHEN lead(z) OVER y IS NULL THEN (z - lag(z) OVER y) / 30 ELSE (lead(z) OVER y - lag(z) OVER y) / 60 END AS dy
 FROM d WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row))"""


@query("slope", f"WITH {GRAD} SELECT row, col, {r6('degrees(atan(sqrt(dx * dx + dy * dy)))')} AS slope FROM gx")
def slope(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.slope(df, 30.0, dims).select("row", "col", N.rounded(c("slope")).alias("slope"))


@query("aspect", f"WITH {GRAD}, a AS (SELECT *, degrees(atan2(-dy, dx)) AS a FROM gx) SELECT row, col, {r6('CASE WHEN a < 0 THEN 360 + a ELSE a END')} AS aspect FROM a")
def aspect(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.aspect(df, 30.0, dims).select("row", "col", N.rounded(c("aspect")).alias("aspect"))


@query(
    "hillshade",
    f"""WITH {GRAD}, h AS (SELECT row, col, 255 * (sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(315) - atan2(-dy, dx))) AS s FROM gx)
SELECT row, col, {r6("s")} AS shade, CAST(floor(least(greatest(s, 0), 255) + 1e-9) AS INTEGER) AS hillshade FROM h""",
)
def hillshade(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.hillshade(df, 30.0, dims).withColumn("shade", N.rounded(c("shade")))


def _again(v: str) -> str:
    return f"""CASE WHEN lag({v}) OVER x IS NULL THEN (lead({v}) OVER x - {v}) / 30 WHEN lead({v}) OVER x IS NULL THEN ({v} - lag({v}) OVER x) / 30 ELSE (lead({v}) OVER x - lag({v}) OVER x) / 60 END"""


@query(
    "curvature",
    f"""WITH {GRAD}, g2 AS (SELECT *, {_again("dx")} AS dxx, {_again("dx").replace("OVER x", "OVER y")} AS dxy, {_again("dy").replace("OVER x", "OVER y")} AS dyy FROM gx WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)),
 p AS (SELECT *, dx * dx + dy * dy AS p FROM g2)
SELECT row, col, {r6("-(dxx * dx * dx + 2 * dxy * dx * dy + dyy * dy * dy) / (p * sqrt((p + 1) * (p + 1) * (p + 1)) + 1e-8)")} AS profile, {r6("-(dxx * dy * dy - 2 * dxy * dx * dy + dyy * dx * dx) / (p ** 1.5 + 1e-8)", "1e4")} AS plan FROM p""",
)
def curvature(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.curvature(df, 30.0, dims).select("row", "col", N.rounded(c("profile")).alias("profile"), N.rounded(c("plan"), 4).alias("plan"))


@query("twi", f"WITH {GRAD} SELECT row, col, {r6('ln(1 / (tan(atan(sqrt(dx * dx + dy * dy))) + 0.001e0))')} AS twi FROM gx")
def twi(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.twi(df, 30.0, dims).select("row", "col", N.rounded(c("twi")).alias("twi"))


def near(k: int, values: str, src: str = "d", kc: int | None = None) -> str:
    """SQL of means over k x kc pixels of mirrored neighbours."""
    kc = kc or k
    fold = lambda x, n: f"least(({x}) % (2 * {n}) + CASE WHEN {x} < 0 THEN 2 * {n} ELSE 0 END, 2 * {n} - 1 - (({x}) % (2 * {n}) + CASE WHEN {x} < 0 THEN 2 * {n} ELSE 0 END))"
    return f"""(SELECT p.row, p.col, {values} FROM (SELECT row, col, {fold("row + i", "h")} AS r, {fold("col + j", "w")} AS c FROM (SELECT row, col FROM {src}) CROSS JOIN (SELECT unnest(range({-(k // 2)}, {k - k // 2})) AS i) CROSS JOIN (SELECT unnest(range({-(kc // 2)}, {kc - kc // 2})) AS j) CROSS JOIN dims) p
 JOIN {src} q ON q.row = p.r AND q.col = p.c GROUP BY p.row, p.col)"""


BASE = f"d AS (SELECT row, col, z / 1000 AS z FROM {DEM_SQL}), dims AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM d)"


@query("boxcar", f"WITH {BASE} SELECT row, col, {r6('z')} AS z FROM {near(5, 'avg(q.z) AS z')}")
def boxcar(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.speckle(df, "boxcar", dims).select("row", "col", N.rounded(c("z")).alias("z"))


@query("median_filter", f"WITH {BASE} SELECT row, col, {r6('z')} AS z FROM {near(3, 'median(q.z) AS z')}")
def median_filter(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.speckle(df, "median", dims, 3).select("row", "col", N.rounded(c("z")).alias("z"))


LEE = f"WITH {BASE}, m AS {near(5, 'avg(q.z) AS m, avg(q.z * q.z) AS s')}, v AS (SELECT row, col, z, m, s - m * m AS var FROM m JOIN d USING (row, col))"


@query("lee", f"{LEE} SELECT row, col, {r6('m + var / (var + var / (m * m + 1e-10) * m * m + 1e-10) * (z - m)')} AS z FROM v")
def lee(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.speckle(df, "lee", dims).select("row", "col", N.rounded(c("z")).alias("z"))


@query(
    "frost",
    f"{LEE}, e AS (SELECT row, col, z, exp(-((sqrt(var) / (m + 1e-10)) ** 2)) AS wt FROM v) SELECT row, col, {r6('f / (wt + 1e-10)')} AS z FROM {near(5, 'avg(q.z * q.wt) AS f, avg(q.wt) AS wt', 'e')}",
)
def frost(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.speckle(df, "frost", dims).select("row", "col", N.rounded(c("z")).alias("z"))


@query("roughness", f"WITH {BASE} SELECT row, col, {r6('sqrt(greatest(s - 2 * z * m + z * z, 0))', '1e4')} AS roughness FROM {near(3, 'avg(q.z) AS m, avg(q.z * q.z) AS s')} JOIN d USING (row, col)")
def roughness(spark, sf_dir):
    df, dims = _dem(spark, sf_dir, 1000.0)
    return W.roughness(df, dims).select("row", "col", N.rounded(c("roughness"), 4).alias("roughness"))


PAIR = f"""p AS (SELECT row, col, sin(z / 1e4) * (1 + row % 3) AS a, cos(z / 1e4) AS b, sin(z / 1e4 + 0.3e0) AS e, cos(z / 1e4 + col % 5 / 10e0) AS f FROM {DEM_SQL}),
 d AS (SELECT row, col, a * e + b * f AS re, b * e - a * f AS im, a * a + b * b AS p1, e * e + f * f AS p2 FROM p), dims AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM d)"""


def _pair(spark, sf_dir):
    """Two complex images from the raster."""
    df = dem(spark, sf_dir)
    t = c("z") / 1e4
    s1 = N.complex_of(F.sin(t) * (1 + c("row") % 3), F.cos(t))
    s2 = N.complex_of(F.sin(t + 0.3), F.cos(t + c("col") % 5 / 10.0))
    return df.select("row", "col", s1.alias("s1"), s2.alias("s2")), R.shape(df)


@query(
    "coherence",
    f"WITH {PAIR} SELECT row, col, {r6('least(greatest(sqrt(re * re + im * im) / greatest(sqrt(p1 * p2), 1e-10), 0), 1)')} AS coherence FROM {near(5, 'avg(q.re) AS re, avg(q.im) AS im, avg(q.p1) AS p1, avg(q.p2) AS p2')}",
)
def coherence(spark, sf_dir):
    pair, dims = _pair(spark, sf_dir)
    return W.coherence(pair, dims).select("row", "col", N.rounded(c("coherence")).alias("coherence"))


@query("multilook", f"WITH {PAIR} SELECT row, col, {r6('re')} AS re, {r6('im')} AS im FROM {near(4, 'avg(q.re) AS re, avg(q.im) AS im', kc=3)}")
def multilook(spark, sf_dir):
    """An interferogram smoothed by an even and an odd number of looks."""
    pair, dims = _pair(spark, sf_dir)
    i = N.c_mul_conj(c("s1"), c("s2"))
    m = W.uniform(pair.select("row", "col", i["re"].alias("re"), i["im"].alias("im")), ["re", "im"], (4, 3), dims)
    return m.select("row", "col", N.rounded(c("re")).alias("re"), N.rounded(c("im")).alias("im"))


@query(
    "unwrap_rows",
    f"""WITH p AS (SELECT row, col, atan2(sin(z / 2e4), cos(z / 2e4)) AS phase FROM {DEM_SQL}), d AS (SELECT *, coalesce(phase - lag(phase) OVER (PARTITION BY row ORDER BY col), 0) AS d FROM p),
 m AS (SELECT *, d + pi() - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi() AS dm FROM d)
SELECT row, col, {r6("phase + sum(CASE WHEN abs(d) < pi() THEN 0 ELSE dm - d END) OVER (PARTITION BY row ORDER BY col ROWS UNBOUNDED PRECEDING)", "1e4")} AS unwrapped FROM m""",
)
def unwrap_rows(spark, sf_dir):
    t = c("z") / 2e4
    phase = dem(spark, sf_dir).select("row", "col", F.atan2(F.sin(t), F.cos(t)).alias("phase"))
    return W.unwrap_rows(phase).select("row", "col", N.rounded(c("unwrapped"), 4).alias("unwrapped"))


MASK = f"m AS (SELECT row, col, CAST(z > 150000 AS INTEGER) AS mask FROM {DEM_SQL})"


def _step(src: str, of: str) -> str:
    """Erosion or dilation by 3 x 3 ones with zeros beyond the edge."""
    value = "CAST(sum(q.mask) = 9 AS INTEGER)" if of == "min" else "max(q.mask)"
    return f"(SELECT p.row, p.col, {value} AS mask FROM (SELECT row, col, row + i AS r, col + j AS c FROM {src} CROSS JOIN (SELECT unnest(range(-1, 2)) AS i) CROSS JOIN (SELECT unnest(range(-1, 2)) AS j)) p JOIN {src} q ON q.row = p.r AND q.col = p.c GROUP BY p.row, p.col)"


def _morphology(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        df, dims = _dem(spark, sf_dir)
        return W.morphology(df.select("row", "col", (c("z") > 150000).cast("int").alias("mask")), name, dims)

    query(f"morph_{name}", f"WITH {MASK}{sql}")(run)


_morphology("erode", f" SELECT * FROM {_step('m', 'min')}")
_morphology("dilate", f" SELECT * FROM {_step('m', 'max')}")
_morphology("open", f", e AS {_step('m', 'min')} SELECT * FROM {_step('e', 'max')}")
_morphology("close", f", e AS {_step('m', 'max')} SELECT * FROM {_step('e', 'min')}")


@query(
    "ssim",
    f"""WITH d AS (SELECT row, col, z / 5e5 AS p, z / 5e5 * 0.9e0 + row % 7 / 100e0 AS t FROM {DEM_SQL}), dims AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM d),
 s AS {near(7, "avg(q.p) AS mp, avg(q.t) AS mt, avg(q.p * q.p) AS pp, avg(q.t * q.t) AS tt, avg(q.p * q.t) AS pt")}
SELECT {r6("avg(((2 * mp * mt + 1e-4) * (2 * (pt - mp * mt) + 9e-4)) / ((mp * mp + mt * mt + 1e-4) * ((pp - mp * mp) + (tt - mt * mt) + 9e-4)))")} AS ssim FROM s""",
)
def ssim(spark, sf_dir):
    from geospan.operators import metrics as M

    df, dims = _dem(spark, sf_dir)
    pair = df.select("row", "col", (c("z") / 5e5).alias("pred"), (c("z") / 5e5 * 0.9 + c("row") % 7 / 100.0).alias("target"))
    return M.ssim(pair, dims, 7).select(N.rounded(c("ssim")).alias("ssim"))
