"""Flat matter-Lambda cosmology on columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299792.458
_NODES, _WEIGHTS = (tuple(float(v) for v in a) for a in np.polynomial.legendre.leggauss(16))


def growth(z: Column, om: float) -> Column:
    """E(z), the expansion rate in units of today's."""
    if not np.isfinite(om):
        raise ValueError("matter density must be finite")
    return F.sqrt(om * F.pow(1 + z, F.lit(3.0)) + (1 - om))


def comoving_distance(z: Column, om: float = 0.3111) -> Column:
    """Comoving distance in Mpc/h, by a 16-point Gauss-Legendre sum; null for null or NaN redshifts."""
    total = F.lit(0.0)
    for x, w in zip(_NODES, _WEIGHTS, strict=True):
        total = total + w / growth(z * ((x + 1) / 2), om)
    return F.when(~F.isnan(z), SPEED_OF_LIGHT / 100.0 * z / 2 * total)


def cz_to_comoving_distance(cz: Column, h: float = 1.0, om: float = 0.3111) -> Column:
    """Distance for a recession velocity in km/s with H0 = 100 h, times h: h cancels."""
    if not h > 0:
        raise ValueError("h must be positive")
    return comoving_distance(cz / SPEED_OF_LIGHT, om)


def redshift_of_distance(d: Column, om: float = 0.3111, steps: int = 5) -> Column:
    """Inverse of the comoving distance by Newton steps from the linear law."""
    start = F.struct((d * 100.0 / SPEED_OF_LIGHT).alias("z"))
    step = lambda acc, _: F.struct((acc["z"] - (comoving_distance(acc["z"], om) - d) * growth(acc["z"], om) * 100.0 / SPEED_OF_LIGHT).alias("z"))
    return F.when(~F.isnan(d), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["z"]))


def angular_diameter_distance(z: Column, om: float = 0.3111) -> Column:
    return comoving_distance(z, om) / (1 + z)
