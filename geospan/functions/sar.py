"""Radar products per pixel: calibration, interferograms and polarimetric decompositions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geospan.functions.numeric import c_abs2, c_add, c_mul_conj, c_phase, c_sub


def calibrate_amplitude(re: Column, im: Column | None = None, factor: float = 1.0) -> Column:
    """The magnitude, or the real value as it is, times the factor."""
    return (re if im is None else F.hypot(re, im)) * factor


def sigma0(amplitude: Column, incidence: Column, lut: Column | float = 1.0) -> Column:
    """Backscatter on the ground; incidence in radians."""
    return amplitude * amplitude * F.sin(incidence) / lut


def gamma0(sigma: Column, incidence: Column) -> Column:
    return sigma / F.greatest(F.cos(incidence), F.lit(1e-10))


def to_db(amplitude: Column, floor: float = -40.0) -> Column:
    return F.greatest(20 * F.log10(F.greatest(amplitude, F.lit(1e-10))), F.lit(floor))


def interferogram(master: Column, slave: Column) -> Column:
    return c_mul_conj(master, slave)


def phase(value: Column) -> Column:
    return c_phase(value)


def displacement(unwrapped: Column, wavelength: float, incidence: float | None = None) -> Column:
    """Along the line of sight; the incidence angle is accepted and not used."""
    return wavelength * unwrapped / (4 * math.pi)


def pauli(hh: Column, hv: Column, vv: Column) -> dict[str, Column]:
    return {"surface": c_abs2(c_add(hh, vv)) / 2, "double_bounce": c_abs2(c_sub(hh, vv)) / 2, "volume": 2 * c_abs2(hv)}


def freeman_durden(hh: Column, hv: Column, vv: Column) -> dict[str, Column]:
    """Three scattering powers, each at least 0; the dominant mechanism follows the sign of the residual correlation."""
    volume = 8 * c_abs2(hv) / 3
    c13 = c_mul_conj(hh, vv)
    c11, c33, real = c_abs2(hh) - volume / 2, c_abs2(vv) - volume / 2, c13["re"] - volume / 6
    cross = real * real + c13["im"] * c13["im"]
    more, less = c33 + cross / (c11 + 1e-10), c11 - cross / (c33 + 1e-10)
    zero = F.lit(0.0)
    return {"surface": F.greatest(F.when(real >= 0, more).otherwise(less), zero), "double_bounce": F.greatest(F.when(real >= 0, less).otherwise(more), zero), "volume": F.greatest(volume, zero)}


def h_alpha(hh: Column, hv: Column, vv: Column) -> dict[str, Column]:
    """Entropy, anisotropy and alpha of the diagonal coherency elements; shares are floored after normalisation."""
    t = [c_abs2(c_add(hh, vv)) / 2, c_abs2(c_sub(hh, vv)) / 2, 2 * c_abs2(hv)]
    trace = F.greatest(t[0] + t[1] + t[2], F.lit(1e-10))
    p1, p2, p3 = (F.greatest(x / trace, F.lit(1e-10)) for x in t)
    entropy = -(p1 * F.ln(p1) + p2 * F.ln(p2) + p3 * F.ln(p3)) / math.log(3)
    return {"p1": p1, "p2": p2, "p3": p3, "entropy": entropy, "anisotropy": (p2 - p3) / (p2 + p3 + 1e-10), "alpha": F.degrees(F.acos(F.sqrt(p1)))}


DECOMPOSITIONS = {"pauli": pauli, "freeman_durden": freeman_durden, "h_alpha": h_alpha}


def polarimetric_decomposition(hh: Column, hv: Column, vv: Column, decomposition: str = "pauli") -> dict[str, Column]:
    if decomposition not in DECOMPOSITIONS:
        raise ValueError(f"Unknown decomposition: {decomposition}")
    return DECOMPOSITIONS[decomposition](hh, hv, vv)
