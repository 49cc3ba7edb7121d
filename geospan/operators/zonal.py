"""Zonal statistics, weighted overlay and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.functions import geometry as G
from geospan.operators.priorities import AHP  # noqa: F401
from geospan.operators.raster import Transform

STATS = ("count", "sum", "mean", "std", "min", "max", "median", "variety")


def zonal_statistics(df: DataFrame, zone: str = "zone", value: str = "value", percentiles: list[int] | None = None, stats: tuple[str, ...] = STATS) -> DataFrame:
    """Statistics of the non-NaN values of each zone; the deviation is that of the population.

    Sums, counts and extremes are combined before the shuffle; exact quantiles
    and distinct counts need the values of a zone together, so leave them out of
    ``stats`` for zones that hold much of a very large raster.
    """
    v = F.col(value)
    known = {
        "count": F.count(v), "sum": F.sum(v), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v),
        "median": F.median(v), "variety": F.count_distinct(v),
    }
    out = [known[s].alias(s) for s in stats] + [F.percentile(v, F.lit(p / 100)).alias(f"p{p}") for p in percentiles or []]
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.col(zone).alias("zone_id")).agg(*out)


def zonal_rollup(df: DataFrame, levels: list[str], value: str = "value", stats: tuple[str, ...] = ("count", "sum", "mean", "min", "max")) -> DataFrame:
    """The same statistics for each zone of nested levels, for each coarser level, and for all: missing levels are null, ``depth`` tells how many are there."""
    v = F.col(value)
    known = {"count": F.count(v), "sum": F.sum(v), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}
    rows = df.where(v.isNotNull() & ~F.isnan(v)).rollup(*levels).agg(*(known[s].alias(s) for s in stats), F.grouping_id().alias("_g"))
    return rows.withColumn("depth", F.lit(len(levels)) - F.bit_count("_g")).drop("_g")


def zonal_join(values: DataFrame, zones: DataFrame, **options) -> DataFrame:
    """Raster by raster: pixels are matched by position."""
    return zonal_statistics(values.join(zones.select("row", "col", "zone"), ["row", "col"]), **options)


def zonal_vector(values: DataFrame, zones: DataFrame, transform: Transform, cell: float, value: str = "value", **options) -> DataFrame:
    """Raster by polygons (``zone, ring``): a pixel belongs to each polygon that holds its centre.

    Pixels and polygon boxes are put into square cells, so that the join is an
    equi-join on cells followed by the exact test.
    """
    x, y = transform.centre(F.col("row"), F.col("col"))
    pixels = values.withColumn("_x", x).withColumn("_y", y).withColumn("_cx", F.floor(F.col("_x") / cell)).withColumn("_cy", F.floor(F.col("_y") / cell))
    low = lambda axis: F.floor(F.array_min(F.transform("ring", lambda p: p[axis])) / cell)
    high = lambda axis: F.floor(F.array_max(F.transform("ring", lambda p: p[axis])) / cell)
    boxes = zones.select("zone", "ring", F.explode(F.sequence(low("x"), high("x"))).alias("_cx"), low("y").alias("_l"), high("y").alias("_h")).withColumn("_cy", F.explode(F.sequence("_l", "_h")))
    met = pixels.join(boxes, ["_cx", "_cy"]).where(G.contains(F.col("ring"), F.col("_x"), F.col("_y")))
    return zonal_statistics(met, value=value, **options)


def weighted_overlay(layers: dict[str, DataFrame], weights: dict[str, float], normalize: bool = True, value: str = "value") -> DataFrame:
    """The weighted sum of aligned layers; weights are scaled to sum 1, layers to 0..1 unless they are constant."""
    total = sum(weights.values())
    joined = None
    for name, layer in layers.items():
        own = layer.select("row", "col", F.col(value).alias(name))
        joined = own if joined is None else joined.join(own, ["row", "col"])
    terms = []
    if normalize:
        ends = joined.agg(*(f(F.when(~F.isnan(n), F.col(n))).alias(f"{k}_{n}") for n in layers for k, f in (("lo", F.min), ("hi", F.max)))).first()
    for name in layers:
        x = F.col(name)
        if normalize and ends[f"hi_{name}"] is not None and ends[f"hi_{name}"] > ends[f"lo_{name}"]:
            x = (x - ends[f"lo_{name}"]) / (ends[f"hi_{name}"] - ends[f"lo_{name}"])
        terms.append(x * (weights[name] / total))
    return joined.select("row", "col", sum(terms[1:], terms[0]).alias("suitability"))


def change_pair(before: DataFrame, after: DataFrame, threshold: float = 0.5, value: str = "value") -> DataFrame:
    """1 where the band means of two epochs differ by more than the threshold."""
    means = [df.groupBy("row", "col").agg(F.avg(value).alias(n)) for df, n in ((before, "a"), (after, "b"))]
    return means[0].join(means[1], ["row", "col"]).select("row", "col", (F.abs(F.col("a") - F.col("b")) > threshold).cast("int").alias("change"))


def stretch(df: DataFrame, value: str = "z", percentile: tuple[int, int] = (2, 98)) -> DataFrame:
    """Between two percentiles to 0..255, truncated."""
    lo, hi = df.agg(F.percentile(value, F.array(*(F.lit(p / 100) for p in percentile))).alias("p")).first()[0]
    x = (F.col(value) - lo) / (hi - lo + 1e-8)
    return df.withColumn(value, F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255 + 1e-9).cast("int"))
