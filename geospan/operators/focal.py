"""Neighbourhood operators over pixel tables.

Means over k x k windows are separable: one window function along rows and one
along columns, each a shuffle by line. The raster's edge is mirrored by adding
the few mirrored pixels before each pass. Gradients are lag and lead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = {"row": "col", "col": "row"}


def _mirrored(df: DataFrame, axis: str, before: int, after: int, n: int) -> DataFrame:
    """Adds the pixels beyond both ends of each line that mirror it, as often as the window is wider than the raster."""
    turns = math.ceil((max(before, after) + n) / (2 * n)) + 1
    i = F.col(axis)
    places = F.flatten(F.transform(F.sequence(F.lit(-turns), F.lit(turns)), lambda t: F.array(i + 2 * n * t, 2 * n * (t + 1) - 1 - i)))
    inside = F.filter(places, lambda p: (p >= -before) & (p < n + after))
    return df.withColumn(axis, F.explode(inside))


def uniform(df: DataFrame, values: list[str], size: int | tuple[int, int], dims: tuple[int, int]) -> DataFrame:
    """The mean of each column of ``values`` over size x size pixels, edges mirrored; even sizes reach one further back."""
    sizes = (size, size) if isinstance(size, int) else size
    out = df.select("row", "col", *values)
    for axis, k, n in (("col", sizes[1], dims[1]), ("row", sizes[0], dims[0])):
        before, after = k // 2, k - k // 2 - 1
        window = Window.partitionBy(LINE[axis]).orderBy(axis).rowsBetween(-before, after)
        out = _mirrored(out, axis, before, after, n).select("row", "col", *(F.sum(v).over(window).alias(v) for v in values)).where((F.col(axis) >= 0) & (F.col(axis) < n))
    return out.select("row", "col", *((F.col(v) / float(sizes[0] * sizes[1])).alias(v) for v in values))


def neighbourhood(df: DataFrame, value: str, size: int, dims: tuple[int, int]) -> DataFrame:
    """``row, col, values``: all values of the window around each pixel, edges mirrored."""
    h = size // 2
    rows = Window.partitionBy("row").orderBy("col").rowsBetween(-h, size - h - 1)
    cols = Window.partitionBy("col").orderBy("row").rowsBetween(-h, size - h - 1)
    out = _mirrored(df.select("row", "col", value), "col", h, size - h - 1, dims[1]).select("row", "col", F.collect_list(value).over(rows).alias("v")).where((F.col("col") >= 0) & (F.col("col") < dims[1]))
    out = _mirrored(out, "row", h, size - h - 1, dims[0]).select("row", "col", F.flatten(F.collect_list("v").over(cols)).alias("values"))
    return out.where((F.col("row") >= 0) & (F.col("row") < dims[0]))


def gradient(df: DataFrame, value: str, spacing: float, dims: tuple[int, int], dy: str = "dy", dx: str = "dx") -> DataFrame:
    """Central differences inside, one-sided at the edges; dy grows downwards."""
    if min(dims) < 2:
        raise ValueError("a gradient needs two rows and columns")

    def along(axis: str) -> Column:
        w = Window.partitionBy(LINE[axis]).orderBy(axis)
        back, here, on = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
        return F.when(back.isNull(), (on - here) / spacing).when(on.isNull(), (here - back) / spacing).otherwise((on - back) / (2 * spacing))

    return df.withColumn(dx, along("col")).withColumn(dy, along("row"))


def slope_of(dy: Column, dx: Column) -> Column:
    return F.atan(F.sqrt(dx * dx + dy * dy))


def slope(df: DataFrame, spacing: float, dims: tuple[int, int], value: str = "z") -> DataFrame:
    """In degrees."""
    return gradient(df, value, spacing, dims).select("row", "col", F.degrees(slope_of(F.col("dy"), F.col("dx"))).alias("slope"))


def aspect(df: DataFrame, spacing: float, dims: tuple[int, int], value: str = "z") -> DataFrame:
    """In degrees counted from east against the clock."""
    angle = F.degrees(F.atan2(-F.col("dy"), F.col("dx")))
    return gradient(df, value, spacing, dims).select("row", "col", F.when(angle < 0, 360 + angle).otherwise(angle).alias("aspect"))


def hillshade(df: DataFrame, spacing: float, dims: tuple[int, int], azimuth: float = 315.0, altitude: float = 45.0, value: str = "z") -> DataFrame:
    """0 to 255, truncated; ``shade`` is the value before."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    s, a = slope_of(F.col("dy"), F.col("dx")), F.atan2(-F.col("dy"), F.col("dx"))
    shade = math.sin(alt) * F.cos(s) + math.cos(alt) * F.sin(s) * F.cos(az - a)
    out = gradient(df, value, spacing, dims).select("row", "col", (shade * 255).alias("shade"))
    return out.withColumn("hillshade", F.floor(F.least(F.greatest("shade", F.lit(0.0)), F.lit(255.0)) + 1e-9).cast("int"))


def curvature(df: DataFrame, spacing: float, dims: tuple[int, int], value: str = "z") -> DataFrame:
    """Profile and plan curvature from second differences."""
    out = gradient(df, value, spacing, dims)
    out = gradient(gradient(out, "dy", spacing, dims, "dyy", "dyx"), "dx", spacing, dims, "dxy", "dxx")
    dx, dy, dxx, dxy, dyy = (F.col(n) for n in ("dx", "dy", "dxx", "dxy", "dyy"))
    p = dx * dx + dy * dy
    q = p + 1
    profile = -(dxx * dx * dx + 2 * dxy * dx * dy + dyy * dy * dy) / (p * F.sqrt(q * q * q) + 1e-8)
    plan = -(dxx * dy * dy - 2 * dxy * dx * dy + dyy * dx * dx) / (F.pow(p, F.lit(1.5)) + 1e-8)
    return out.select("row", "col", profile.alias("profile"), plan.alias("plan"))


def twi(df: DataFrame, spacing: float, dims: tuple[int, int], value: str = "z") -> DataFrame:
    """Wetness with a flow accumulation of one."""
    s = slope_of(F.col("dy"), F.col("dx"))
    return gradient(df, value, spacing, dims).select("row", "col", F.ln(1 / (F.tan(s) + 0.001)).alias("twi"))


def roughness(df: DataFrame, dims: tuple[int, int], value: str = "z") -> DataFrame:
    """Root of the mean squared difference to the centre over 3 x 3 pixels: mean of squares - 2 c mean + c squared."""
    squares = df.select("row", "col", value, (F.col(value) * F.col(value)).alias("_s"))
    means = uniform(squares.select("row", "col", F.col(value).alias("m"), "_s"), ["m", "_s"], 3, dims)
    c = F.col(value)
    return df.select("row", "col", value).join(means, ["row", "col"]).select("row", "col", F.sqrt(F.greatest(F.col("_s") - 2 * c * F.col("m") + c * c, F.lit(0.0))).alias("roughness"))


def speckle(df: DataFrame, kind: str, dims: tuple[int, int], size: int = 5, value: str = "z") -> DataFrame:
    """Boxcar, median, lee or frost filter; even sizes grow by one."""
    size += 1 - size % 2
    own = df.select("row", "col", value)
    if kind == "boxcar":
        return uniform(own, [value], size, dims)
    if kind == "median":
        return neighbourhood(own, value, size, dims).select("row", "col", F.array_sort("values")[size * size // 2].alias(value))
    x, m, s = F.col(value), F.col("m"), F.col("s")
    means = uniform(own.select("row", "col", x.alias("m"), (x * x).alias("s")), ["m", "s"], size, dims)
    joined = own.join(means, ["row", "col"]).withColumn("var", s - m * m)
    var = F.col("var")
    if kind == "lee":
        noise = var / (m * m + 1e-10)
        k = var / (var + noise * m * m + 1e-10)
        return joined.select("row", "col", (m + k * (x - m)).alias(value))
    if kind == "frost":
        weight = F.exp(-F.pow(F.sqrt(var) / (m + 1e-10), F.lit(2.0)))
        both = joined.select("row", "col", (x * weight).alias("f"), weight.alias("w"))
        return uniform(both, ["f", "w"], size, dims).select("row", "col", (F.col("f") / (F.col("w") + 1e-10)).alias(value))
    raise ValueError(f"Unknown filter type: {kind}")


def coherence(df: DataFrame, dims: tuple[int, int], size: int = 5, first: str = "s1", second: str = "s2") -> DataFrame:
    """Of two complex columns; all four window means in one pass."""
    from geospan.functions.numeric import c_abs2, c_mul_conj

    size += 1 - size % 2
    cross = c_mul_conj(F.col(first), F.col(second))
    parts = df.select("row", "col", cross["re"].alias("re"), cross["im"].alias("im"), c_abs2(F.col(first)).alias("p1"), c_abs2(F.col(second)).alias("p2"))
    m = uniform(parts, ["re", "im", "p1", "p2"], size, dims)
    value = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.greatest(F.sqrt(F.col("p1") * F.col("p2")), F.lit(1e-10))
    return m.select("row", "col", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("coherence"))


def unwrap_rows(df: DataFrame, value: str = "phase") -> DataFrame:
    """Row-wise phase unwrapping: a running sum of whole turns."""
    order = Window.partitionBy("row").orderBy("col")
    pi = math.pi
    d = F.col(value) - F.lag(value).over(order)
    dm = F.pmod(F.col("_d") + pi, F.lit(2 * pi)) - pi
    dm = F.when((dm == -pi) & (F.col("_d") > 0), F.lit(pi)).otherwise(dm)
    correction = F.when(F.abs("_d") < pi, 0.0).otherwise(dm - F.col("_d"))
    return df.withColumn("_d", F.coalesce(d, F.lit(0.0))).withColumn("_c", correction).withColumn("unwrapped", F.col(value) + F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_d", "_c")


def morphology(df: DataFrame, operation: str, dims: tuple[int, int], size: int = 3, value: str = "mask") -> DataFrame:
    """Erode, dilate, open or close a 0/1 mask with a square of ones; beyond the edge is 0."""
    steps = {"erode": ["min"], "dilate": ["max"], "open": ["min", "max"], "close": ["max", "min"]}
    if operation not in steps:
        raise ValueError(f"Unknown operation: {operation}")
    out = df.select("row", "col", F.col(value).cast("int").alias(value))
    for step in steps[operation]:
        for axis, n in (("col", dims[1]), ("row", dims[0])):
            # The square's origin lies at size // 2; dilation uses the mirrored square.
            before, after = (size // 2, size - size // 2 - 1) if step == "min" else (size - size // 2 - 1, size // 2)
            w = Window.partitionBy(LINE[axis]).orderBy(axis).rowsBetween(-before, after)
            if step == "max":
                out = out.withColumn(value, F.max(value).over(w))
            else:
                whole = (F.col(axis) >= before) & (F.col(axis) < n - after)
                out = out.withColumn(value, F.when(whole, F.min(value).over(w)).otherwise(0))
    return out
