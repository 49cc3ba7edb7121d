"""Pixel-wise preparation and finishing of model inputs and outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class colours of the default map.
COLOURS = {0: (0, 0, 0), 1: (255, 0, 0), 2: (0, 255, 0), 3: (0, 0, 255), 4: (255, 255, 0), 5: (255, 0, 255)}


def normalize(x: Column, mean: float | None = None, std: float | None = None, min_val: float = 0.0, max_val: float = 1.0) -> Column:
    """By mean and deviation if both are given, else to the unit range."""
    if mean is not None and std is not None:
        return (x - mean) / std
    return (x - min_val) / (max_val - min_val + 1e-8)


def normalize_bands(bands: Column, mean: list[float], std: list[float]) -> Column:
    """An array of bands, each by its own mean and deviation."""
    return F.transform(F.arrays_zip(bands.alias("x"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, std)).alias("s")), lambda t: (t["x"] - t["m"]) / t["s"])


def compose(df: DataFrame, *steps) -> DataFrame:
    return reduce(lambda d, step: d.transform(step), steps, df)


def threshold(p: Column, t: float = 0.5, above: bool = True) -> Column:
    """1 where p lies beyond t; NaN gives 0."""
    return F.when(~F.isnan(p) & ((p > t) if above else (p < t)), 1).otherwise(0)


def argmax(values: Column) -> Column:
    """The first position of the largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def class_mask(mask: Column, cls: int) -> Column:
    return (mask == cls).cast("float")


def overlay(value: Column, mask: Column, alpha: float, colour: int) -> Column:
    """Blend a colour into masked pixels; truncated to whole numbers."""
    return F.when(mask > 0, F.floor((1 - alpha) * value + alpha * colour)).otherwise(F.floor(value)).cast("int")


def colour(mask: Column, colours: dict[int, tuple[int, int, int]] | None = None) -> list[Column]:
    """Red, green and blue of a class; black for a class without a colour."""
    known = COLOURS if colours is None else colours
    out = []
    for band in range(3):
        table = F.create_map(*(F.lit(x) for c, rgb in known.items() for x in (c, rgb[band])))
        out.append(F.coalesce(F.try_element_at(table, mask.cast("int")), F.lit(0)))
    return out


def dense_layer(x: Column, weights: list[list[float]], bias: list[float], relu: bool = True) -> Column:
    """A fully connected layer over an array column."""
    rows = []
    for row, b in zip(weights, bias, strict=True):
        total = F.aggregate(F.zip_with(x, F.array(*map(F.lit, row)), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v) + b
        rows.append(F.greatest(total, F.lit(0.0)) if relu else total)
    return F.array(*rows)
