"""Equal-area pixelisation in RING order as column expressions (Gorski et al. 2005)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586
HALF_PI = 1.5707963267948966


def npix(nside: int) -> int:
    return 12 * nside * nside


def nside_of(n_pixels: int) -> int:
    nside = math.isqrt(n_pixels // 12)
    if npix(nside) != n_pixels:
        raise ValueError(f"{n_pixels} is no number of pixels")
    return nside


def _long(x: Column) -> Column:
    return F.floor(x).cast("long")


def z_phi_to_pix(nside: int, z: Column, phi: Column) -> Column:
    """Pixel that holds the point of height z and azimuth phi (radians)."""
    n = nside
    ncap = 2 * n * (n - 1)
    tt = F.pmod(phi, F.lit(TWO_PI)) / HALF_PI
    tt = F.when(tt >= 4, 0.0).otherwise(tt)
    jp, jm = _long(n * (0.5 + tt) - 0.75 * n * z), _long(n * (0.5 + tt) + 0.75 * n * z)
    ir = n + 1 + jp - jm
    ip = F.pmod(F.floor((jp + jm - n + (1 - F.pmod(ir, F.lit(2))) + 1) / 2).cast("long"), F.lit(4 * n))
    belt = ncap + (ir - 1) * 4 * n + ip
    part = tt - F.floor(tt)
    t = n * F.sqrt(3 * (1 - F.abs(z)))
    cp, cm = _long(part * t), _long((1 - part) * t)
    cr = cp + cm + 1
    ci = F.pmod(_long(tt * cr), 4 * cr)
    cap = F.when(z > 0, 2 * cr * (cr - 1) + ci).otherwise(npix(n) - 2 * cr * (cr + 1) + ci)
    return F.when(F.abs(z) <= 2.0 / 3.0, belt).otherwise(cap).cast("long")


def lonlat_to_pix(nside: int, lon: Column, lat: Column) -> Column:
    return z_phi_to_pix(nside, F.sin(F.radians(lat)), F.radians(lon))


def with_ring(df: DataFrame, nside: int, pix: str = "pix", out: str = "ring") -> DataFrame:
    """Adds the ring (1 .. 4 nside - 1) of a pixel column.

    Each step is a column of its own, so that the plan holds every expression once.
    """
    n, last = nside, npix(nside)
    ncap = 2 * n * (n - 1)
    mirrored = df.withColumn("_h", F.least(F.col(pix), last - 1 - F.col(pix)))
    rooted = mirrored.withColumn("_c", _long((1 + F.sqrt(1.0 + 2.0 * F.col("_h"))) / 2))
    c, h = F.col("_c"), F.col("_h")
    # The integer root is corrected by one either way against rounding.
    exact = rooted.withColumn("_c", c - F.when(2 * c * (c - 1) > h, 1).otherwise(0) + F.when(2 * c * (c + 1) <= h, 1).otherwise(0))
    ring = F.when(h >= ncap, n + _long((F.col(pix) - ncap) / (4 * n))).when(F.col(pix) < ncap, c).otherwise(4 * n - c)
    return exact.withColumn(out, ring.cast("long")).drop("_h", "_c")


def with_centre(df: DataFrame, nside: int, pix: str = "pix", z: str = "pz", phi: str = "pphi") -> DataFrame:
    """Adds height and azimuth of a pixel column's centres."""
    k = F.col("_ring")
    at = (F.col(pix) - ring_start(nside, k) + ring_shift(nside, k)) * TWO_PI / ring_length(nside, k)
    return with_ring(df, nside, pix, "_ring").withColumn(z, ring_z(nside, k)).withColumn(phi, at).drop("_ring")


def ring_length(nside: int, k: Column) -> Column:
    return (4 * F.least(k, F.lit(nside), 4 * nside - k)).cast("long")


def ring_start(nside: int, k: Column) -> Column:
    n = nside
    m = 4 * n - k
    return F.when(k < n, 2 * k * (k - 1)).when(k <= 3 * n, 2 * n * (n - 1) + (k - n) * 4 * n).otherwise(npix(n) - 2 * m * (m + 1)).cast("long")


def ring_z(nside: int, k: Column) -> Column:
    n = nside
    m = 4 * n - k
    return F.when(k < n, 1 - k * k / F.lit(3.0 * n * n)).when(k <= 3 * n, 2 * (2.0 * n - k) / F.lit(3.0 * n)).otherwise(m * m / F.lit(3.0 * n * n) - 1)


def ring_shift(nside: int, k: Column) -> Column:
    """Where the first pixel of a ring has its centre, in pixels."""
    odd = F.pmod(k - nside, F.lit(2)) == 1
    return F.when((k >= nside) & (k <= 3 * nside) & odd, 0.0).otherwise(0.5)


def rings_above(nside: int, z: Column) -> Column:
    """Number of rings whose centres lie at or above height z, give or take one."""
    n = nside
    t = n * F.sqrt(F.greatest(3 * (1 - F.abs(z)), F.lit(0.0)))
    return F.when(z > 2.0 / 3.0, F.floor(t)).when(z < -2.0 / 3.0, 4 * n - F.ceil(t)).otherwise(F.floor(n * (2 - 1.5 * z))).cast("long")


def pixels_of(nside: int, z: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """``z_phi_to_pix`` for arrays, where a task follows points on a map of its own."""
    n = nside
    tt = np.mod(phi, TWO_PI) / HALF_PI
    tt = np.where(tt >= 4, 0.0, tt)
    jp, jm = np.floor(n * (0.5 + tt) - 0.75 * n * z), np.floor(n * (0.5 + tt) + 0.75 * n * z)
    ir = n + 1 + jp - jm
    belt = 2 * n * (n - 1) + (ir - 1) * 4 * n + np.mod(np.floor((jp + jm - n + (1 - np.mod(ir, 2)) + 1) / 2), 4 * n)
    part = tt - np.floor(tt)
    t = n * np.sqrt(np.maximum(3 * (1 - np.abs(z)), 0.0))
    cr = np.floor(part * t) + np.floor((1 - part) * t) + 1
    ci = np.mod(np.floor(tt * cr), 4 * cr)
    cap = np.where(z > 0, 2 * cr * (cr - 1) + ci, npix(n) - 2 * cr * (cr + 1) + ci)
    return np.where(np.abs(z) <= 2.0 / 3.0, belt, cap).astype(np.int64)
