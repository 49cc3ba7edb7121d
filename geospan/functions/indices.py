"""Spectral indices as column expressions.

Two families differ in how they treat a zero denominator: the registry's
indices replace it by 1e-10, the plain functions add 1e-8 to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geospan.functions.numeric import divided, nonzero

EPS = 1e-8


def _ratio(a: Column, b: Column) -> Column:
    return (a - b) / nonzero(a + b)


@dataclass(frozen=True)
class SpectralIndex:
    name: str
    category: str
    bands_required: tuple[str, ...]
    formula: str
    build: Callable[..., Column]
    value_range: tuple[float, float] = (-1.0, 1.0)

    def compute(self, df: DataFrame, output: str | None = None, **parameters: float) -> DataFrame:
        """Add the index as a column; the bands are looked up by name when the plan is made."""
        missing = [band for band in self.bands_required if band not in df.columns]
        if missing:
            raise ValueError(f"Missing bands: {missing}")
        return df.withColumn(output or self.name, self.build(*(F.col(b).cast("double") for b in self.bands_required), **parameters))


def _evi(nir: Column, red: Column, blue: Column, g: float = 2.5, c1: float = 6.0, c2: float = 7.5, l: float = 1.0) -> Column:  # noqa: E741
    return g * (nir - red) / nonzero(nir + c1 * red - c2 * blue + l)


def _savi(nir: Column, red: Column, l: float = 0.5) -> Column:  # noqa: E741
    return ((nir - red) / nonzero(nir + red + l)) * (1 + l)


class IndexRegistry:
    """Indices by name; users register their own."""

    _known: dict[str, SpectralIndex] = {}

    @classmethod
    def register(cls, index: SpectralIndex) -> SpectralIndex:
        cls._known[index.name.upper()] = index
        return index

    @classmethod
    def get(cls, name: str) -> SpectralIndex | None:
        return cls._known.get(name.upper())

    @classmethod
    def list_all(cls) -> list[str]:
        return list(cls._known)

    @classmethod
    def by_category(cls, category: str) -> list[SpectralIndex]:
        return [index for index in cls._known.values() if index.category == category]

    @classmethod
    def register_formula(cls, name: str, category: str, bands: tuple[str, ...], formula: str) -> SpectralIndex:
        """An index given as an SQL expression over its bands."""
        return cls.register(SpectralIndex(name, category, bands, formula, lambda *_: F.expr(formula)))


for _index in (
    SpectralIndex("NDVI", "vegetation", ("NIR", "RED"), "(NIR - RED) / (NIR + RED)", _ratio),
    SpectralIndex("NDWI", "water", ("GREEN", "NIR"), "(GREEN - NIR) / (GREEN + NIR)", _ratio),
    SpectralIndex("NBR", "burn", ("NIR", "SWIR2"), "(NIR - SWIR2) / (NIR + SWIR2)", _ratio),
    SpectralIndex("EVI", "vegetation", ("NIR", "RED", "BLUE"), "G * (NIR - RED) / (NIR + C1 * RED - C2 * BLUE + L)", _evi),
    SpectralIndex("SAVI", "vegetation", ("NIR", "RED"), "(NIR - RED) / (NIR + RED + L) * (1 + L)", _savi),
    SpectralIndex("MSI", "moisture", ("SWIR1", "NIR"), "SWIR1 / NIR", lambda swir, nir: swir / nonzero(nir), (0.0, 3.0)),
):
    IndexRegistry.register(_index)


def compute_index(name: str, df: DataFrame, output: str | None = None, **parameters: float) -> DataFrame:
    index = IndexRegistry.get(name)
    if index is None:
        raise ValueError(f"Unknown index: {name}")
    return index.compute(df, output, **parameters)


def ndvi(nir: Column, red: Column) -> Column:
    return (nir - red) / (nir + red + EPS)


def ndwi(green: Column, nir: Column) -> Column:
    return (green - nir) / (green + nir + EPS)


def evi(nir: Column, red: Column, blue: Column, g: float = 2.5, c1: float = 6.0, c2: float = 7.5, l: float = 1.0) -> Column:  # noqa: E741
    """Unguarded: infinite or NaN where the denominator is zero."""
    return divided(g * (nir - red), nir + c1 * red - c2 * blue + l)


def savi(nir: Column, red: Column, l: float = 0.5) -> Column:  # noqa: E741
    return ((nir - red) * (1 + l)) / (nir + red + l + EPS)


def nbr(nir: Column, swir: Column) -> Column:
    return (nir - swir) / (nir + swir + EPS)


def msi(swir: Column, nir: Column) -> Column:
    return swir / (nir + EPS)


def dnbr(pre: Column, post: Column) -> Column:
    return pre - post


def ndvi_class(x: Column) -> Column:
    """Cover classes of a vegetation index."""
    return F.when(x < 0, "water").when(x < 0.2, "bare").when(x < 0.4, "sparse").when(x < 0.6, "moderate").otherwise("dense")
