"""Rasters as pixel tables (row, col, one column a band): access, tiling, mosaicking and resampling.

A dense raster has one row for each pixel. Windows, crops and tiles are filters
and generators over pixel positions, so they prune and shuffle like any table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transform:
    """Pixel to map coordinates: x = a * col + b * row + c, y = d * col + e * row + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        r, k = row + 0.5, col + 0.5
        return self.a * k + self.b * r + self.c, self.d * k + self.e * r + self.f

    def moved(self, row: int, col: int) -> Transform:
        return Transform(self.a, self.b, self.c + self.a * col + self.b * row, self.d, self.e, self.f + self.d * col + self.e * row)


@dataclass(frozen=True)
class RasterMetadata:
    """What a raster's pixels do not say themselves."""

    width: int
    height: int
    count: int = 1
    dtype: str = "float32"
    crs: str = "EPSG:4326"
    transform: Transform = field(default_factory=Transform)
    nodata: float | None = None
    tags: dict[str, str] = field(default_factory=dict)

    def to_dict(self) -> dict:
        t = self.transform
        return {"width": self.width, "height": self.height, "count": self.count, "dtype": self.dtype, "crs": self.crs, "transform": [t.a, t.b, t.c, t.d, t.e, t.f], "nodata": self.nodata, "tags": dict(self.tags)}

    @classmethod
    def from_dict(cls, given: dict) -> RasterMetadata:
        return cls(**{**given, "transform": Transform(*given["transform"])})


def shape(df: DataFrame) -> tuple[int, int]:
    """Height and width of a raster whose pixels start at 0, 0."""
    row = df.agg(F.max("row"), F.max("col")).first()
    return (0, 0) if row[0] is None else (int(row[0]) + 1, int(row[1]) + 1)


def from_array(spark, array, band: str = "value") -> DataFrame:
    """A small array of the driver as a pixel table; three dimensions give ``band`` numbers as a column of their own."""
    if array.ndim == 2:
        array = array[None]
    rows = [(b + 1, r, c, float(array[b, r, c])) for b in range(array.shape[0]) for r in range(array.shape[1]) for c in range(array.shape[2])]
    return spark.createDataFrame(rows, f"band int, row long, col long, {band} double")


def read_window(df: DataFrame, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
    """The pixels of a window; it is clipped where it leaves the raster."""
    return df.where(F.col("row").between(row_off, row_off + height - 1) & F.col("col").between(col_off, col_off + width - 1))


def crop(df: DataFrame, bounds: tuple[float, float, float, float], transform: Transform) -> DataFrame:
    """Pixels from the one that holds the upper left bound up to, without, the one that holds the lower right bound."""
    left, bottom, right, top = bounds
    r0, r1 = math.floor((top - transform.f) / transform.e), math.floor((bottom - transform.f) / transform.e)
    c0, c1 = math.floor((left - transform.c) / transform.a), math.floor((right - transform.c) / transform.a)
    return df.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))


def mask_nodata(df: DataFrame, nodata: float, columns: Iterable[str]) -> DataFrame:
    """Null where a band has the nodata value or NaN."""
    return df.withColumns({c: F.when((F.col(c) != nodata) & ~F.isnan(c), F.col(c)) for c in columns})


def select_bands(df: DataFrame, bands: list[str], key: Iterable[str] = ("row", "col")) -> DataFrame:
    """Bands by name and order; unknown names are left out."""
    return df.select(*key, *(b for b in bands if b in df.columns))


def to_long(df: DataFrame, bands: list[str], key: Iterable[str] = ("row", "col")) -> DataFrame:
    return df.unpivot(list(key), bands, "band", "value")


def to_wide(df: DataFrame, bands: list[str], key: Iterable[str] = ("row", "col")) -> DataFrame:
    return df.groupBy(*key).pivot("band", bands).agg(F.max("value"))


def tile_cover(position: Column, size: int, step: int) -> Column:
    """Numbers of the tiles that hold a position, along one axis."""
    return F.sequence(F.greatest(F.lit(0), F.ceil((position - size + 1) / step)).cast("long"), F.floor(position / step).cast("long"))


def tiles(df: DataFrame, size: int = 256, overlap: int = 0) -> DataFrame:
    """Each pixel once for each tile that holds it; tiles at the edges are smaller."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    out = df.withColumn("tile_row", F.explode(tile_cover(F.col("row"), size, step))).withColumn("tile_col", F.explode(tile_cover(F.col("col"), size, step)))
    return out.withColumn("in_row", F.col("row") - F.col("tile_row") * step).withColumn("in_col", F.col("col") - F.col("tile_col") * step)


def tile_grid(spark, height: int, width: int, size: int, overlap: int = 0) -> DataFrame:
    """Offsets and sizes of all tiles of a raster, row by row."""
    step = size - overlap
    rows, cols = math.ceil(height / step), math.ceil(width / step)
    grid = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("tile_row"), (F.col("id") % cols).alias("tile_col"))
    grid = grid.withColumn("row_off", F.col("tile_row") * step).withColumn("col_off", F.col("tile_col") * step)
    return grid.withColumn("height", F.least(F.lit(size), height - F.col("row_off"))).withColumn("width", F.least(F.lit(size), width - F.col("col_off")))


def shifted_starts(length: int, size: int, overlap: int) -> list[int]:
    """Where tiles start that are moved back at the edge so that all are full."""
    return [max(0, min(i + size, length) - size) for i in range(0, length - overlap, size - overlap)]


def shifted_tiles(df: DataFrame, height: int, width: int, size: int = 512, overlap: int = 64) -> DataFrame:
    """Each pixel once for each full-size tile that holds it."""
    out = df
    for name, position, length in (("tile_row", "row", height), ("tile_col", "col", width)):
        starts = F.array(*(F.struct(F.lit(i).cast("long").alias("n"), F.lit(s).cast("long").alias("s")) for i, s in enumerate(shifted_starts(length, size, overlap))))
        at = F.col(position)
        held = F.filter(starts, lambda t: (t["s"] <= at) & (at < t["s"] + size))  # noqa: B023
        out = out.withColumn("_t", F.explode(held)).withColumn(name, F.col("_t.n")).withColumn(f"{name}_start", F.col("_t.s")).drop("_t")
    return out


def tile_key(level: Column, row: Column, col: Column) -> Column:
    return F.format_string("z%d/r%d/c%d", level, row, col)


def grid(spark, height: int, width: int) -> DataFrame:
    """All pixel positions."""
    return spark.range(height * width).select(F.expr(f"id div {width}").alias("row"), (F.col("id") % width).alias("col"))


def mosaic(tiled: DataFrame, height: int, width: int, value: str = "z", order: str = "seq", nodata: float = 0.0) -> DataFrame:
    """One raster from overlapping tiles: the last tile wins, holes get ``nodata``."""
    last = tiled.groupBy("row", "col").agg(F.max_by(value, order).alias(value))
    return grid(tiled.sparkSession, height, width).join(last, ["row", "col"], "left").select("row", "col", F.coalesce(value, F.lit(nodata)).alias(value))


def stitch(tiled: DataFrame, height: int, width: int, value: str = "z") -> DataFrame:
    """One raster from overlapping tiles: their mean, holes get 0."""
    mean = tiled.groupBy("row", "col").agg(F.avg(value).alias(value))
    return grid(tiled.sparkSession, height, width).join(mean, ["row", "col"], "left").select("row", "col", F.coalesce(value, F.lit(0.0)).alias(value))


def pad(df: DataFrame, height: int, width: int, to_height: int, to_width: int, value: str = "z", constant: float = 0.0) -> DataFrame:
    """Constant pixels below and to the right."""
    more = grid(df.sparkSession, max(height, to_height), max(width, to_width)).where((F.col("row") >= height) | (F.col("col") >= width))
    return df.select("row", "col", value).unionByName(more.withColumn(value, F.lit(constant)))


def resample(df: DataFrame, height: int, width: int, scale: float, method: str = "bilinear", value: str = "z") -> DataFrame:
    """A corner-aligned zoom: nearest or bilinear.

    Each source pixel is sent to the target pixels that it weighs in, so that
    the join is an equi-join of positions; the output has ``round(n * scale)``
    rows and columns.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"Unknown method: {method}; cubic zoom works on tiles")
    out_h, out_w = round(height * scale), round(width * scale)
    target = grid(df.sparkSession, out_h, out_w)
    at = lambda p, n, m: F.col(p) * float(n - 1) / float(max(m - 1, 1))
    target = target.withColumn("sr", at("row", height, out_h)).withColumn("sc", at("col", width, out_w))
    source = df.select(F.col("row").alias("r"), F.col("col").alias("c"), value)
    if method == "nearest":
        placed = target.select("row", "col", F.floor(F.col("sr") + 0.5).alias("r"), F.floor(F.col("sc") + 0.5).alias("c"))
        return placed.join(source, ["r", "c"]).select("row", "col", value)
    corner = lambda s, limit: F.transform(F.array(F.lit(0), F.lit(1)), lambda o: F.struct(F.least(F.floor(F.col(s)) + o, F.lit(limit - 1)).alias("i"), F.when(o == 0, 1 - (F.col(s) - F.floor(s))).otherwise(F.col(s) - F.floor(s)).alias("w")))
    corners = target.withColumn("a", F.explode(corner("sr", height))).withColumn("b", F.explode(corner("sc", width)))
    corners = corners.select("row", "col", F.col("a.i").alias("r"), F.col("b.i").alias("c"), (F.col("a.w") * F.col("b.w")).alias("w")).where("w > 0")
    return corners.join(source, ["r", "c"]).groupBy("row", "col").agg(F.sum(F.col("w") * F.col(value)).alias(value))


def pad_by(df: DataFrame, height: int, width: int, to_height: int, to_width: int, mode: str = "constant", value: str = "z", constant: float = 0.0) -> DataFrame:
    """Pixels below and to the right: ``constant``, ``edge``, ``reflect`` (without the edge twice), ``symmetric`` (with it) or ``wrap``.

    A padded pixel is a copy of the one that its position folds back to: an
    equi-join of positions.
    """
    if mode == "constant":
        return pad(df, height, width, to_height, to_width, value, constant)
    fold = {
        "edge": lambda p, n: F.least(p, F.lit(n - 1)), "wrap": lambda p, n: p % n,
        "symmetric": lambda p, n: F.least(p % (2 * n), 2 * n - 1 - p % (2 * n)), "reflect": lambda p, n: F.least(p % max(1, 2 * n - 2), max(1, 2 * n - 2) - p % max(1, 2 * n - 2)) if n > 1 else F.lit(0),
    }
    if mode not in fold:
        raise ValueError(f"Unknown mode: {mode}")
    target = grid(df.sparkSession, max(height, to_height), max(width, to_width))
    target = target.withColumn("r", fold[mode](F.col("row"), height).cast("long")).withColumn("c", fold[mode](F.col("col"), width).cast("long"))
    return target.join(df.select(F.col("row").alias("r"), F.col("col").alias("c"), value), ["r", "c"]).select("row", "col", value)


def resize(df: DataFrame, height: int, width: int, to_height: int, to_width: int, value: str = "z") -> DataFrame:
    """Bilinear, with pixel centres aligned, edges mirrored, and a Gaussian before a side shrinks (a deviation of half the excess of its factor).

    The weights of a target pixel are the product of a row's and a column's, so
    each axis is one equi-join and one sum.
    """
    import numpy as np

    spark = df.sparkSession

    def weights(n: int, m: int) -> list[tuple[int, int, float]]:
        factor = n / m
        deviation = max(0.0, (factor - 1) / 2)
        reach = int(4 * deviation + 0.5)
        near = np.exp(-0.5 * (np.arange(-reach, reach + 1) / deviation) ** 2) if reach else np.ones(1)
        near /= near.sum()
        out: dict[tuple[int, int], float] = {}
        for i in range(m):
            at = (i + 0.5) * factor - 0.5
            low = int(np.floor(at))
            for place, share in ((low, 1 - (at - low)), (low + 1, at - low)):
                place = min(max(place, 0), n - 1)
                for k, w in zip(range(-reach, reach + 1), near, strict=True):
                    p = (place + k) % (2 * n)
                    p = min(p, 2 * n - 1 - p)
                    out[i, p] = out.get((i, p), 0.0) + share * float(w)
        return [(i, p, w) for (i, p), w in out.items() if w]

    out = df.select("row", "col", F.col(value).cast("double").alias(value))
    for axis, n, m, other in (("row", height, to_height, "col"), ("col", width, to_width, "row")):
        table = spark.createDataFrame(weights(n, m), "to long, at long, w double")  # a few numbers for each target line
        out = out.join(table, F.col(axis) == F.col("at")).groupBy(F.col("to").alias(axis), other).agg(F.sum(F.col("w") * F.col(value)).alias(value))
    return out.select("row", "col", value)


def to_channels_first(df: DataFrame, shape: tuple[int, ...], data: str = "data") -> DataFrame:
    """Arrays in rows, columns, channels (of 1, 3 or 4) to channels, rows, columns; an array of two dimensions gets a channel. Other layouts stay."""
    if len(shape) == 2:
        return df
    h, w, c = shape
    if c not in (1, 3, 4):
        return df
    source = F.sequence(F.lit(0), F.lit(h * w * c - 1))
    return df.withColumn(data, F.transform(source, lambda i: F.get(F.col(data), ((i % (h * w)) * c + F.floor(i / (h * w))).cast("int"))))


def to_channels_last(df: DataFrame, shape: tuple[int, int, int], data: str = "data") -> DataFrame:
    """Arrays in channels, rows, columns to rows, columns, channels."""
    c, h, w = shape
    source = F.sequence(F.lit(0), F.lit(h * w * c - 1))
    return df.withColumn(data, F.transform(source, lambda i: F.get(F.col(data), ((i % c) * (h * w) + F.floor(i / c)).cast("int"))))


def legend(spark, colours: dict[int, tuple[int, int, int]], bar_height: int = 20, bar_width: int = 100) -> DataFrame:
    """``row, col, cls, r, g, b``: a bar of each class's colour, one below the other, in order of the class."""
    table = spark.createDataFrame([(i, k, *rgb) for i, (k, rgb) in enumerate(sorted(colours.items()))], "bar long, cls int, r int, g int, b int")
    pixels = grid(spark, bar_height * len(colours), bar_width).withColumn("bar", F.expr(f"row div {bar_height}"))
    return pixels.join(F.broadcast(table), "bar").select("row", "col", "cls", "r", "g", "b")  # a row for each class


def reproject(df: DataFrame, transform: Transform, forward, backward, resolution: float | None = None, value: str = "z", nodata: float = 0.0) -> tuple[DataFrame, Transform]:
    """The raster on a grid of another coordinate system, bilinear, and that grid's transform.

    ``forward`` and ``backward`` map coordinate columns to the other system and
    back (``geometry.to_mercator`` and ``from_mercator``). The grid spans the
    projected edge of the raster; each of its pixels asks for four neighbours of
    the place that it comes from, by an equi-join of positions. Neighbours that
    are not there have no weight; a pixel outside gets ``nodata``.
    """
    height, width = shape(df)
    spark = df.sparkSession
    edge = spark.range(height + 1).select(F.col("id").cast("double").alias("r"), F.explode(F.array(F.lit(0.0), F.lit(float(width)))).alias("c"))
    edge = edge.unionByName(spark.range(width + 1).select(F.explode(F.array(F.lit(0.0), F.lit(float(height)))).alias("r"), F.col("id").cast("double").alias("c")))
    x, y = forward(transform.a * F.col("c") + transform.b * F.col("r") + transform.c, transform.d * F.col("c") + transform.e * F.col("r") + transform.f)
    box = edge.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2")).first()
    if resolution is None:  # as many pixels along the diagonal as before
        resolution = math.hypot(box.x2 - box.x1, box.y2 - box.y1) / math.hypot(height, width)
    out_h, out_w = max(1, math.ceil((box.y2 - box.y1) / resolution - 1e-9)), max(1, math.ceil((box.x2 - box.x1) / resolution - 1e-9))
    new = Transform(a=resolution, c=box.x1, e=-resolution, f=box.y2)
    target = grid(spark, out_h, out_w)
    x, y = backward(*new.centre(F.col("row"), F.col("col")))
    x, y, det = x - transform.c, y - transform.f, transform.a * transform.e - transform.b * transform.d
    target = target.select("row", "col", ((transform.a * y - transform.d * x) / det - 0.5).alias("r"), ((transform.e * x - transform.b * y) / det - 0.5).alias("c"))
    sides = lambda p: F.array(F.struct(F.floor(p).alias("i"), (1 - (F.col(p) - F.floor(p))).alias("w")), F.struct((F.floor(p) + 1).alias("i"), (F.col(p) - F.floor(p)).alias("w")))
    asked = target.withColumn("a", F.explode(sides("r"))).withColumn("b", F.explode(sides("c"))).select("row", "col", F.col("a.i").alias("r"), F.col("b.i").alias("c"), (F.col("a.w") * F.col("b.w")).alias("w"))
    found = asked.where("w > 0").join(df.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), F.col(value).alias("v")), ["r", "c"])
    values = found.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))
    return grid(spark, out_h, out_w).join(values, ["row", "col"], "left").select("row", "col", F.coalesce(value, F.lit(nodata)).alias(value)), new
