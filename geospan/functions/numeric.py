"""Numeric helpers with the array semantics of map algebra: guarded divisions, clipping, complex numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Round half up by scaling and flooring, which gives the same bits in every engine."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def nonzero(x: Column, instead: float = 1e-10) -> Column:
    """``x``, or ``instead`` where it is exactly zero."""
    return F.when(x == 0, F.lit(instead)).otherwise(x)


def divided(a: Column, b: Column) -> Column:
    """a / b as floating-point arithmetic has it: infinite or NaN where b is zero."""
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def c_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def c_sub(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def c_mul_conj(a: Column, b: Column) -> Column:
    """a times the conjugate of b."""
    return complex_of(a["re"] * b["re"] + a["im"] * b["im"], a["im"] * b["re"] - a["re"] * b["im"])


def c_abs2(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def c_abs(a: Column) -> Column:
    return F.sqrt(c_abs2(a))


def c_phase(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def dot(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def reflect(i: Column, n: Column) -> Column:
    """The index that ``i`` is mirrored to in 0..n-1, edge pixels repeated; also for windows wider than the raster."""
    m = F.pmod(i, 2 * n)
    return F.least(m, 2 * n - 1 - m)


def human_size(size: Column) -> Column:
    """Bytes in steps of 1024, with one decimal."""
    out, units = None, ["B", "KB", "MB", "GB", "TB"]
    value = size.cast("double")
    for i, unit in enumerate(units):
        text = F.concat(F.format_string("%.1f", F.bround(value / float(1024**i), 1)), F.lit(f" {unit}"))
        out = F.when(value < float(1024 ** (i + 1)), text) if out is None else out.when(value < float(1024 ** (i + 1)), text)
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(value / float(1024**5), 1)), F.lit(" PB")))
