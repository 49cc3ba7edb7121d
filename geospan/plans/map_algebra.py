"""Pixel-wise queries: spectral indices, model pre- and post-processing, radar products."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geospan.functions import geometry as G
from geospan.functions import indices as I
from geospan.functions import numeric as N
from geospan.functions import pixels as P
from geospan.functions import sar as S
from geospan.operators import raster as R
from geospan.plans.bindings import DEM_SQL, KEY, KEY_SQL, SPECTRA_SQL, dem, spectra
from geospan.plans.registry import query, r6, table

Z = "CASE WHEN {0} = 0 THEN 1e-10 ELSE {0} END"


def _index(name: str, sql: str, **parameters: float) -> None:
    def run(spark, sf_dir):
        return I.compute_index(name, spectra(spark, sf_dir), "value", **parameters).select(*KEY, N.rounded(F.col("value")).alias("value"))

    query(f"idx_{name.lower()}", f"SELECT {KEY_SQL}, {r6(sql)} AS value FROM {SPECTRA_SQL}")(run)


_index("NDVI", f"(nir - red) / ({Z.format('(nir + red)')})")
_index("NDWI", f"(green - nir) / ({Z.format('(green + nir)')})")
_index("NBR", f"(nir - swir2) / ({Z.format('(nir + swir2)')})")
_index("EVI", f"2.5e0 * (nir - red) / ({Z.format('(nir + 6e0 * red - 7.5e0 * blue + 1e0)')})")
_index("SAVI", f"((nir - red) / ({Z.format('(nir + red + 0.5e0)')})) * 1.5e0")
_index("MSI", f"swir1 / ({Z.format('nir')})")


def _function(name: str, build, sql: str) -> None:
    def run(spark, sf_dir):
        return spectra(spark, sf_dir).select(*KEY, N.rounded(build()).alias("value"))

    query(f"idxfn_{name}", f"SELECT {KEY_SQL}, {r6(sql)} AS value FROM {SPECTRA_SQL}")(run)


c = F.col
_function("ndvi", lambda: I.ndvi(c("GREEN"), c("BLUE")), "(green - blue) / (green + blue + 1e-8)")
_function("ndwi", lambda: I.ndwi(c("GREEN"), c("NIR")), "(green - nir) / (green + nir + 1e-8)")
_function("evi", lambda: I.evi(c("NIR"), c("RED"), c("BLUE")), "2.5e0 * (nir - red) / (nir + 6e0 * red - 7.5e0 * blue + 1e0)")
_function("savi", lambda: I.savi(c("NIR"), c("RED")), "((nir - red) * 1.5e0) / (nir + red + 0.5e0 + 1e-8)")
_function("nbr", lambda: I.nbr(c("NIR"), c("SWIR2")), "(nir - swir2) / (nir + swir2 + 1e-8)")
_function("msi", lambda: I.msi(c("SWIR1"), c("NIR")), "swir1 / (nir + 1e-8)")


@query(
    "idx_zero_guard",
    f"SELECT {KEY_SQL}, {r6('(green - blue) / (' + Z.format('(green + blue)') + ')')} AS value FROM {SPECTRA_SQL}",
)
def idx_zero_guard(spark, sf_dir):
    """The registry's guard on bands that are both zero in places."""
    renamed = spectra(spark, sf_dir).withColumnsRenamed({"NIR": "n0", "RED": "r0"}).withColumnsRenamed({"GREEN": "NIR", "BLUE": "RED"})
    return I.compute_index("NDVI", renamed, "value").select(*KEY, N.rounded(c("value")).alias("value"))


@query(
    "idx_formula",
    f"SELECT {KEY_SQL}, {r6('(swir1 - swir2) / (swir1 + swir2 + 1e-8)')} AS value FROM {SPECTRA_SQL}",
)
def idx_formula(spark, sf_dir):
    """A user's index, registered as a formula."""
    I.IndexRegistry.register_formula("MOISTURE_DIFFERENCE", "moisture", ("SWIR1", "SWIR2"), "(SWIR1 - SWIR2) / (SWIR1 + SWIR2 + 1e-8D)")
    return I.compute_index("MOISTURE_DIFFERENCE", spectra(spark, sf_dir), "value").select(*KEY, N.rounded(c("value")).alias("value"))


@query(
    "idx_dnbr",
    f"""WITH e AS (SELECT l_partkey // 50 AS row, l_partkey % 50 AS col, l_returnflag, {r6("avg((l_extendedprice / 1e5 - l_tax) / (l_extendedprice / 1e5 + l_tax + 1e-8))")} AS b FROM lineitem GROUP BY ALL)
SELECT a.row, a.col, {r6("a.b - b.b")} AS value FROM e a JOIN e b USING (row, col) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'""",
)
def idx_dnbr(spark, sf_dir):
    """Burn ratio before and after, joined by pixel."""
    price, key = c("l_extendedprice") / 1e5, c("l_partkey")
    pixels = table(spark, sf_dir, "lineitem").where(c("l_returnflag").isin("A", "R")).groupBy(F.expr("l_partkey div 50").alias("row"), (key % 50).alias("col"), "l_returnflag").agg(N.rounded(F.avg(I.nbr(price, c("l_tax")))).alias("b"))
    pre, post = (pixels.where(c("l_returnflag") == flag).select("row", "col", c("b").alias(n)) for flag, n in (("A", "pre"), ("R", "post")))
    return pre.join(post, ["row", "col"]).select("row", "col", N.rounded(I.dnbr(c("pre"), c("post"))).alias("value"))


@query("norm_minmax", f"SELECT row, col, {r6('(z - 1000e0) / (500000e0 - 1000e0 + 1e-8)')} AS value FROM {DEM_SQL}")
def norm_minmax(spark, sf_dir):
    return dem(spark, sf_dir).select("row", "col", N.rounded(P.normalize(c("z"), min_val=1000.0, max_val=500000.0)).alias("value"))


@query("norm_meanstd", f"SELECT row, col, {r6('(z / 1e5 - 0.485e0) / 0.229e0')} AS value FROM {DEM_SQL}")
def norm_meanstd(spark, sf_dir):
    return dem(spark, sf_dir).select("row", "col", N.rounded(P.normalize(c("z") / 1e5, 0.485, 0.229)).alias("value"))


@query(
    "norm_bands",
    f"SELECT {KEY_SQL}, {r6('(red - 0.485e0) / 0.229e0')} AS r, {r6('(green - 0.456e0) / 0.224e0')} AS g, {r6('(blue - 0.406e0) / 0.225e0')} AS b FROM {SPECTRA_SQL}",
)
def norm_bands(spark, sf_dir):
    """Per-band mean and deviation, as models are fed."""
    bands = P.normalize_bands(F.array("RED", "GREEN", "BLUE"), [0.485, 0.456, 0.406], [0.229, 0.224, 0.225])
    return spectra(spark, sf_dir).select(*KEY, bands.alias("n")).select(*KEY, *(N.rounded(c("n")[i]).alias(n) for i, n in enumerate("rgb")))


@query("threshold", "SELECT event_id, CAST(value > 250 AS INTEGER) AS above, CAST(value < 100 AS INTEGER) AS below FROM events")
def threshold(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", P.threshold(c("value"), 250.0).alias("above"), P.threshold(c("value"), 100.0, above=False).alias("below"))


EMB = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS cls FROM embeddings")
def argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", P.argmax(c("embedding")).alias("cls"))


@query(
    "softmax",
    f"""WITH e AS (SELECT vec_id, {EMB} AS v FROM embeddings), s AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS x FROM e)
SELECT vec_id, {r6("x[1] / list_sum(x)")} AS p0, {r6("list_max(x) / list_sum(x)")} AS p_max FROM s""",
)
def softmax(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", P.softmax(c("embedding").cast("array<double>")).alias("p"))
    return p.select("vec_id", N.rounded(c("p")[0]).alias("p0"), N.rounded(F.array_max("p")).alias("p_max"))


@query("sigmoid", f"SELECT event_id, {r6('1 / (1 + exp(-(value - 250) / 100))')} AS p FROM events")
def sigmoid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.rounded(P.sigmoid((c("value") - 250) / 100)).alias("p"))


@query("class_mask", "SELECT vec_id, CAST(label = 3 AS INTEGER) AS mask FROM embeddings")
def class_mask(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", P.class_mask(c("label"), 3).cast("int").alias("mask"))


@query(
    "segmentation_post",
    f"SELECT row, col, CAST(z / 500000 > 0.5 AS INTEGER) AS mask FROM {DEM_SQL}",
)
def segmentation_post(spark, sf_dir):
    return dem(spark, sf_dir).select("row", "col", P.threshold(c("z") / 500000, 0.5).alias("mask"))


@query("sar_calibrate", f"SELECT {KEY_SQL}, {r6('sqrt(l_quantity * l_quantity + l_discount * l_discount) * 2')} AS a FROM lineitem")
def sar_calibrate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*KEY, N.rounded(S.calibrate_amplitude(c("l_quantity"), c("l_discount"), 2.0)).alias("a"))


@query("sar_sigma0", f"SELECT {KEY_SQL}, {r6('l_quantity * l_quantity * sin(0.5e0 + l_tax) / 3')} AS s FROM lineitem")
def sar_sigma0(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*KEY, N.rounded(S.sigma0(c("l_quantity"), 0.5 + c("l_tax"), 3.0)).alias("s"))


@query("sar_gamma0", f"SELECT {KEY_SQL}, {r6('l_discount / greatest(cos(1e0 + l_tax * 10), 1e-10)', '1e3')} AS g FROM lineitem")
def sar_gamma0(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*KEY, N.rounded(S.gamma0(c("l_discount"), 1.0 + c("l_tax") * 10), 3).alias("g"))


@query("sar_db", f"SELECT {KEY_SQL}, {r6('greatest(20 * log10(greatest(l_discount, 1e-10)), -40)')} AS db FROM lineitem")
def sar_db(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*KEY, N.rounded(S.to_db(c("l_discount"))).alias("db"))


M, V = ("l_quantity", "l_discount"), ("l_tax", "l_discount")


@query(
    "sar_ifg",
    f"""SELECT {KEY_SQL}, {r6("l_quantity * l_tax + l_discount * l_discount")} AS re, {r6("l_discount * l_tax - l_quantity * l_discount")} AS im,
 {r6("atan2(l_discount * l_tax - l_quantity * l_discount, l_quantity * l_tax + l_discount * l_discount)")} AS phase FROM lineitem""",
)
def sar_ifg(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*KEY, S.interferogram(N.complex_of(*map(c, M)), N.complex_of(*map(c, V))).alias("i"))
    return rows.select(*KEY, N.rounded(c("i.re")).alias("re"), N.rounded(c("i.im")).alias("im"), N.rounded(S.phase(c("i"))).alias("phase"))


@query("sar_displacement", f"SELECT event_id, {r6('0.056e0 * value / (4 * pi())')} AS d FROM events")
def sar_displacement(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.rounded(S.displacement(c("value"), 0.056)).alias("d"))


def _quad(spark, sf_dir):
    """Three complex channels from the columns of line items."""
    q = c("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").select(*KEY, N.complex_of(q, c("l_discount")).alias("hh"), N.complex_of(c("l_tax"), c("l_discount") / 2).alias("hv"), N.complex_of(c("l_discount") * 4 - 0.2, c("l_tax") - q / 4).alias("vv"))


QUAD_SQL = f"""quad AS (SELECT {KEY_SQL}, l_quantity / 50e0 AS hr, l_discount AS hi, l_tax AS xr, l_discount / 2e0 AS xi, l_discount * 4 - 0.2e0 AS vr, l_tax - l_quantity / 50e0 / 4e0 AS vi FROM lineitem),
pw AS (SELECT *, (hr + vr) * (hr + vr) + (hi + vi) * (hi + vi) AS s2, (hr - vr) * (hr - vr) + (hi - vi) * (hi - vi) AS d2, xr * xr + xi * xi AS x2, hr * hr + hi * hi AS h2, vr * vr + vi * vi AS v2 FROM quad)"""


def _decomposed(name: str, spark, sf_dir, wanted: tuple[str, ...], digits: int = 6):
    parts = S.polarimetric_decomposition(c("hh"), c("hv"), c("vv"), name)
    return _quad(spark, sf_dir).select(*KEY, *(N.rounded(parts[w], digits).alias(w) for w in wanted))


@query("sar_pauli", f"WITH {QUAD_SQL} SELECT {KEY_SQL}, {r6('s2 / 2')} AS surface, {r6('d2 / 2')} AS double_bounce, {r6('2 * x2')} AS volume FROM pw")
def sar_pauli(spark, sf_dir):
    return _decomposed("pauli", spark, sf_dir, ("surface", "double_bounce", "volume"))


@query(
    "sar_freeman",
    f"""WITH {QUAD_SQL}, f AS (SELECT *, 8 * x2 / 3 AS fv, hr * vr + hi * vi AS cr, hi * vr - hr * vi AS ci FROM pw),
g AS (SELECT *, h2 - fv / 2 AS c11, v2 - fv / 2 AS c33, cr - fv / 6 AS re, (cr - fv / 6) * (cr - fv / 6) + ci * ci AS cx FROM f),
k AS (SELECT *, c33 + cx / (c11 + 1e-10) AS more, c11 - cx / (c33 + 1e-10) AS less FROM g)
SELECT {KEY_SQL}, {r6("greatest(CASE WHEN re >= 0 THEN more ELSE less END, 0)", "1e3")} AS surface, {r6("greatest(CASE WHEN re >= 0 THEN less ELSE more END, 0)", "1e3")} AS double_bounce, {r6("greatest(fv, 0)", "1e3")} AS volume FROM k""",
)
def sar_freeman(spark, sf_dir):
    return _decomposed("freeman_durden", spark, sf_dir, ("surface", "double_bounce", "volume"), 3)


@query(
    "sar_halpha",
    f"""WITH {QUAD_SQL}, t AS (SELECT *, s2 / 2 AS t1, d2 / 2 AS t2, 2 * x2 AS t3, greatest(s2 / 2 + d2 / 2 + 2 * x2, 1e-10) AS tr FROM pw),
p AS (SELECT *, greatest(t1 / tr, 1e-10) AS p1, greatest(t2 / tr, 1e-10) AS p2, greatest(t3 / tr, 1e-10) AS p3 FROM t)
SELECT {KEY_SQL}, {r6("-(p1 * ln(p1) + p2 * ln(p2) + p3 * ln(p3)) / ln(3)")} AS entropy, {r6("(p2 - p3) / (p2 + p3 + 1e-10)")} AS anisotropy, {r6("degrees(acos(sqrt(p1)))", "1e4")} AS alpha FROM p""",
)
def sar_halpha(spark, sf_dir):
    parts = S.h_alpha(c("hh"), c("hv"), c("vv"))
    return _quad(spark, sf_dir).select(*KEY, N.rounded(parts["entropy"]).alias("entropy"), N.rounded(parts["anisotropy"]).alias("anisotropy"), N.rounded(parts["alpha"], 4).alias("alpha"))


@query("crop", f"SELECT row, col, z FROM {DEM_SQL} WHERE row >= 3 AND row < 9 AND col >= 10 AND col < 60")
def crop(spark, sf_dir):
    """Bounds in map units: one unit a pixel, north up."""
    transform = R.Transform(1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    return R.crop(dem(spark, sf_dir), (10.5, -9.5, 60.5, -3.5), transform)


@query("window_read", f"SELECT row, col, z FROM {DEM_SQL} WHERE row BETWEEN 2 AND 11 AND col BETWEEN 90 AND 109")
def window_read(spark, sf_dir):
    return R.read_window(dem(spark, sf_dir), 2, 90, 10, 20)


@query("band_select", f"SELECT {KEY_SQL}, swir1, nir, blue FROM {SPECTRA_SQL}")
def band_select(spark, sf_dir):
    picked = R.select_bands(spectra(spark, sf_dir), ["SWIR1", "NIR", "NOSUCH", "BLUE"], KEY)
    return picked.withColumnsRenamed({b: b.lower() for b in ("SWIR1", "NIR", "BLUE")})


@query("bands_long", f"SELECT {KEY_SQL}, band, value FROM (UNPIVOT {SPECTRA_SQL} ON red, green, blue INTO NAME band VALUE value)")
def bands_long(spark, sf_dir):
    """A scene as one row for each pixel and band."""
    return R.to_long(spectra(spark, sf_dir).select(*KEY, *(c(b).alias(b.lower()) for b in ("RED", "GREEN", "BLUE"))), ["red", "green", "blue"], KEY)


@query(
    "colorize",
    "SELECT vec_id, CASE label WHEN 1 THEN 255 WHEN 4 THEN 255 WHEN 5 THEN 255 ELSE 0 END AS r, CASE label WHEN 2 THEN 255 WHEN 4 THEN 255 ELSE 0 END AS g, CASE label WHEN 3 THEN 255 WHEN 5 THEN 255 ELSE 0 END AS b FROM embeddings",
)
def colorize(spark, sf_dir):
    r, g, b = P.colour(c("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", r.alias("r"), g.alias("g"), b.alias("b"))


@query("overlay_mask", "SELECT event_id, CAST(CASE WHEN user_id % 3 > 0 THEN floor(0.6e0 * floor(value / 2) + 0.4e0 * 255) ELSE floor(value / 2) END AS INTEGER) AS v FROM events")
def overlay_mask(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", P.overlay(F.floor(c("value") / 2), c("user_id") % 3, 0.4, 255).alias("v"))


@query(
    "geo_distances",
    f"""SELECT event_id, {r6("sqrt(value * value + (user_id % 90) * (user_id % 90))")} AS euclidean, {r6("abs(value) + abs(user_id % 90)")} AS manhattan,
 {r6("6371 * 2 * atan2(sqrt(a), sqrt(1 - a))", "1e4")} AS haversine FROM (SELECT *, sin(radians(value / 10 - user_id % 90) / 2) ** 2 + cos(radians(user_id % 90)) * cos(radians(value / 10)) * sin(radians(event_id % 180) / 2) ** 2 AS a FROM events)""",
)
def geo_distances(spark, sf_dir):
    lat = (c("user_id") % 90).cast("double")
    zero = F.lit(0.0)
    return table(spark, sf_dir, "events").select(
        "event_id", N.rounded(G.euclidean(c("value"), lat, zero, zero)).alias("euclidean"), N.rounded(G.manhattan(c("value"), lat, zero, zero)).alias("manhattan"),
        N.rounded(G.haversine(lat, zero, c("value") / 10, (c("event_id") % 180).cast("double")), 4).alias("haversine"),
    )


@query("stretch_scalar", f"SELECT event_id, {r6('0e0 - ((value / 100) ** 1.5) * pi()', '1e4')} AS v FROM events")
def stretch_scalar(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.rounded(-F.pow(c("value") / 100, F.lit(1.5)) * math.pi, 4).alias("v"))


@query(
    "mlp_forward",
    f"""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), h AS (SELECT vec_id, greatest(0.5e0 * a - 0.25e0 * b + 0.1e0, 0) AS h0, greatest(-a + 2 * b, 0) AS h1 FROM e)
SELECT vec_id, {r6("h0 - 0.5e0 * h1 + 0.2e0")} AS y FROM h""",
)
def mlp_forward(spark, sf_dir):
    """Two dense layers over an array column."""
    x = F.slice(c("embedding"), 1, 2).cast("array<double>")
    hidden = table(spark, sf_dir, "embeddings").select("vec_id", P.dense_layer(x, [[0.5, -0.25], [-1.0, 2.0]], [0.1, 0.0]).alias("h"))
    return hidden.select("vec_id", N.rounded(P.dense_layer(c("h"), [[1.0, -0.5]], [0.2], relu=False)[0]).alias("y"))


