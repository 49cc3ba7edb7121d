"""Operators that need a whole array at once: cubic zoom and two-dimensional phase unwrapping, by raster or tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_array(df: DataFrame, function: Callable[[np.ndarray], np.ndarray], value: str = "z", key: str | None = None) -> DataFrame:
    """Apply an array function to each raster or tile of a dense pixel table (``key`` names it; without, there is one).

    One array is one task: cut rasters into tiles first where they are large.
    """
    keyed = df.select((F.col(key) if key else F.lit(0)).cast("long").alias("_key"), F.col("row").cast("long"), F.col("col").cast("long"), F.col(value).cast("double").alias("v"))

    def run(pdf):
        import pandas as pd

        r0, c0 = pdf["row"].min(), pdf["col"].min()
        array = np.full((pdf["row"].max() - r0 + 1, pdf["col"].max() - c0 + 1), np.nan)
        array[pdf["row"] - r0, pdf["col"] - c0] = pdf["v"]
        out = np.asarray(function(array), float)
        r, c = np.indices(out.shape)
        return pd.DataFrame({"_key": pdf["_key"].iloc[0], "row": r.ravel() + r0, "col": c.ravel() + c0, "v": out.ravel()})

    out = keyed.groupBy("_key").applyInPandas(run, "_key long, row long, col long, v double")
    return out.select(*([F.col("_key").alias(key)] if key else []), "row", "col", F.col("v").alias(value))


def spline_coefficients(x: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along the first axis, mirrored at both ends."""
    n = len(x)
    if n < 2:
        return x.astype(float)
    m = np.zeros((n, n))
    at = np.arange(n)
    m[at, at] = 4 / 6
    m[at[1:], at[:-1]] = m[at[:-1], at[1:]] = 1 / 6
    m[0, 1] = m[-1, -2] = 2 / 6
    return np.linalg.solve(m, x.astype(float))


def _along(x: np.ndarray, size: int) -> np.ndarray:
    """The first axis at ``size`` places between its corners."""
    n = len(x)
    if n < 2:
        return np.repeat(x, size, axis=0)
    c = spline_coefficients(x)
    place = np.arange(size) * ((n - 1) / max(size - 1, 1))
    base = np.floor(place).astype(int)
    t = (place - base)[(...,) + (None,) * (x.ndim - 1)]
    weights = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
    turn = 2 * (n - 1)
    out = 0.0
    for k, w in zip(range(-1, 3), weights, strict=True):
        i = np.mod(base + k, turn)
        out = out + w * c[np.minimum(i, turn - i)]
    return out


def cubic_zoom(array: np.ndarray, scale: float) -> np.ndarray:
    """A corner-aligned cubic spline zoom of two dimensions."""
    h, w = (max(1, round(n * scale)) for n in array.shape)
    return _along(_along(array, h).T, w).T


def flood_unwrap(phase: np.ndarray, coherence: np.ndarray | None = None, least: float = 0.3) -> np.ndarray:
    """Unwrap from the centre outwards, each pixel against the neighbour it is reached from.

    Pixels of low coherence are reached but lead no further; what is never
    reached keeps its phase. For phases without residues the way makes no difference.
    """
    h, w = phase.shape
    out, seen = phase.astype(float).copy(), np.zeros((h, w), bool)
    start = (h // 2, w // 2)
    seen[start] = True
    front = [start]
    while front:
        following = []
        for r, c in front:
            if coherence is not None and coherence[r, c] < least and (r, c) != start:
                continue
            for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if 0 <= y < h and 0 <= x < w and not seen[y, x]:
                    seen[y, x] = True
                    step = phase[y, x] - out[r, c]
                    out[y, x] = out[r, c] + step - 2 * np.pi * np.round(step / (2 * np.pi))
                    following.append((y, x))
        front = following
    return out


def augment(array: np.ndarray, seed: int, brightness: tuple[float, float] = (0.9, 1.1)) -> np.ndarray:
    """Flips, quarter turns and brightness, each by chance; the same seed gives the same result."""
    rng = np.random.default_rng(seed)
    if rng.random() < 0.5:
        array = array[..., ::-1]
    if rng.random() < 0.5:
        array = array[..., ::-1, :]
    if rng.random() < 0.5:
        array = np.rot90(array, int(rng.integers(1, 4)), axes=(-2, -1))
    return np.clip(array * rng.uniform(*brightness), 0, None) if rng.random() < 0.5 else np.ascontiguousarray(array)
