"""Spherical-harmonic transforms of pixel maps: smoothing and cross spectra.

A transform is a sum over rings: each ring's Fourier series, then Legendre functions of its height.
Ring series are made where the rings lie; each order m is then one group of at most 4 nside - 1
rows, so the work splits over m and no task holds the map.  Legendre functions come in blocks of degrees
on the rings of one half of the sphere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import healpix as hp
from ..sources.tables import written


#: Degrees of a block of Legendre functions, steps between two looks at their size, and the power of two of a scale.
DEGREES, STEPS, SCALE = 64, 16, 400


def legendre_blocks(m: int, lmax: int, z: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Normalised associated Legendre functions of order m in blocks of degrees from m up: ``l, rows``.

    Only the last two degrees are carried from block to block.  High orders start far below the least
    double near the poles and still grow to matter at higher degrees, so every column has a scale: its
    numbers stand for multiples of ``2^(SCALE * e)``, and while ``e`` is below zero they count as nothing.
    """
    s = np.sqrt(np.maximum(1 - z * z, 0.0))
    logs = 0.5 * np.sum(np.log((2 * np.arange(1, m + 1) + 1) / (2.0 * np.arange(1, m + 1)))) - 0.5 * np.log(4 * np.pi)
    with np.errstate(divide="ignore"):
        size = np.maximum((logs + m * np.log(s)) / np.log(2), -1e9) if m else np.full(len(z), logs / np.log(2))
    e = np.minimum(np.round(size / SCALE), 0)
    before, now = np.zeros(len(z)), (-1.0) ** m * np.exp2(size - SCALE * e)
    for low in range(m, lmax + 1, DEGREES):
        high = min(lmax + 1, low + DEGREES)
        block = np.empty((high - low, len(z)))
        for ell in range(low, high):
            if ell > m:
                a = np.sqrt((4.0 * ell * ell - 1) / (ell * ell - m * m))
                b = np.sqrt(((ell - 1.0) ** 2 - m * m) / (4 * (ell - 1.0) ** 2 - 1)) if ell > m + 1 else 0.0
                before, now = now, a * (z * now - b * before)
                if (ell - m) % STEPS == 0:
                    large = (np.abs(now) > 2.0 ** (SCALE // 2)) & (e < 0)
                    before[large] *= 2.0**-SCALE
                    now[large] *= 2.0**-SCALE
                    e[large] += 1
            block[ell - low] = np.where(e < 0, 0.0, now)
        yield low, block


def legendre(m: int, lmax: int, z: np.ndarray) -> np.ndarray:
    """Normalised associated Legendre functions of order m for l = m .. lmax, rows l, columns z."""
    return np.concatenate([rows for _, rows in legendre_blocks(m, lmax, z)])


def _north(nside: int) -> np.ndarray:
    """Heights of the rings from the first to the equator's; those of the south mirror them."""
    k = np.arange(1, 2 * nside + 1)
    return np.where(k < nside, 1 - k * k / (3.0 * nside * nside), 2 * (2.0 * nside - k) / (3.0 * nside))


def _folded(k: np.ndarray, value: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    """A ring's value and its mirror's, added and subtracted, by the rings of the north (the equator alone)."""
    rings = np.zeros(4 * nside + 1, value.dtype)
    rings[k] = value
    north, south = rings[1 : 2 * nside + 1], rings[4 * nside - 1 : 2 * nside - 1 : -1].copy()
    south[-1] = 0  # the equator has no mirror
    return north + south, north - south


def coefficients(sky_map: DataFrame, nside: int, lmax: int) -> DataFrame:
    """``l, m, re, im`` of ``sky_map(pix, value)``; missing and null pixels count as zero."""
    good = sky_map.where("value is not null and not isnan(value)").select("pix", "value")
    rows = hp.with_ring(good, nside, "pix", "k")
    k = F.col("k")
    rows = rows.select("k", (F.col("pix") - hp.ring_start(nside, k)).alias("i"), hp.ring_length(nside, k).alias("n"), hp.ring_shift(nside, k).alias("shift"), "value")

    def series(pdf: pd.DataFrame) -> pd.DataFrame:
        # A ring's pixels are evenly spaced: orders beyond their number repeat those of its transform.
        n, m = int(pdf["n"].iloc[0]), np.arange(lmax + 1)
        value = np.zeros(n)
        value[pdf["i"].to_numpy()] = pdf["value"].to_numpy()
        c = np.fft.fft(value)[m % n] * np.exp(-2j * np.pi * m * float(pdf["shift"].iloc[0]) / n)
        return pd.DataFrame({"k": np.full(lmax + 1, pdf["k"].iloc[0]), "m": m, "re": c.real, "im": c.imag})

    ring = rows.groupBy("k").applyInPandas(series, "k long, m long, re double, im double")
    area = 4 * np.pi / hp.npix(nside)

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        # Functions of even l - m are the same on mirrored rings, the others change sign.
        m = int(pdf["m"].iloc[0])
        even, odd = _folded(pdf["k"].to_numpy(), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy(), nside)
        out = np.empty(lmax - m + 1, complex)
        for low, p in legendre_blocks(m, lmax, _north(nside)):
            at = low - m
            first = at % 2
            out[at : at + len(p)][first::2] = p[first::2] @ even
            out[at : at + len(p)][1 - first :: 2] = p[1 - first :: 2] @ odd
        return pd.DataFrame({"l": np.arange(m, lmax + 1), "m": m, "re": area * out.real, "im": area * out.imag})

    return ring.groupBy("m").applyInPandas(project, "l long, m long, re double, im double")


def refined(sky_map: DataFrame, nside: int, lmax: int, iterations: int = 3) -> DataFrame:
    """Coefficients corrected by those of what the map and its synthesis differ by, some times over.

    Pixels that the map lacks count as zero in the differences too.
    """
    target = sky_map.sparkSession.range(hp.npix(nside)).withColumnRenamed("id", "pix").join(sky_map.where("value is not null and not isnan(value)").select("pix", F.col("value").alias("want")), "pix", "left")
    alm = written(coefficients(sky_map, nside, lmax), "alm")
    for _ in range(iterations):
        made = synthesis(alm, nside, lmax)
        rest = target.join(made, "pix").select("pix", (F.coalesce("want", F.lit(0.0)) - F.col("value")).alias("value"))
        more = coefficients(rest, nside, lmax)
        alm = written(alm.unionByName(more).groupBy("l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im")), "alm")
    return alm


def synthesis(alm: DataFrame, nside: int, lmax: int) -> DataFrame:
    """``pix, value`` of a real map with the given coefficients."""

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["m"].iloc[0])
        own = pdf.sort_values("l")
        c = np.zeros(lmax - m + 1, complex)
        c[own["l"].to_numpy() - m] = own["re"].to_numpy() + 1j * own["im"].to_numpy()
        even, odd = np.zeros(2 * nside, complex), np.zeros(2 * nside, complex)
        for low, p in legendre_blocks(m, lmax, _north(nside)):
            first = (low - m) % 2
            own = c[low - m : low - m + len(p)]
            even += p[first::2].T @ own[first::2]
            odd += p[1 - first :: 2].T @ own[1 - first :: 2]
        # The south from the last ring before the equator down.
        f = np.concatenate([even + odd, (even - odd)[-2::-1]])
        return pd.DataFrame({"k": np.arange(1, 4 * nside), "m": m, "re": f.real, "im": f.imag})

    series = alm.groupBy("m").applyInPandas(columns, "k long, m long, re double, im double")
    n = hp.ring_length(nside, F.col("k"))
    packed = series.withColumns({"n": n, "start": hp.ring_start(nside, F.col("k")), "shift": hp.ring_shift(nside, F.col("k"))})

    def pixels(pdf: pd.DataFrame) -> pd.DataFrame:
        size, m = int(pdf["n"].iloc[0]), pdf["m"].to_numpy()
        turn = np.exp(2j * np.pi * m * float(pdf["shift"].iloc[0]) / size)
        c = (pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()) * np.where(m == 0, 1.0, 2.0) * turn
        # Orders that agree on the ring's pixels are added up before the transform.
        folded = np.bincount(m % size, c.real, size) + 1j * np.bincount(m % size, c.imag, size)
        return pd.DataFrame({"pix": int(pdf["start"].iloc[0]) + np.arange(size), "value": (np.fft.ifft(folded) * size).real})

    return packed.groupBy("k").applyInPandas(pixels, "pix long, value double")


def smoothed(sky_map: DataFrame, nside: int, fwhm_arcmin: float, lmax: int | None = None) -> DataFrame:
    """The map convolved with a Gaussian beam."""
    lmax = 3 * nside - 1 if lmax is None else lmax
    sigma = np.deg2rad(fwhm_arcmin / 60) / np.sqrt(8 * np.log(2))
    beam = F.exp(-F.col("l") * (F.col("l") + 1) * float(sigma * sigma / 2))
    alm = refined(sky_map, nside, lmax).select("l", "m", (F.col("re") * beam).alias("re"), (F.col("im") * beam).alias("im"))
    return synthesis(alm, nside, lmax)


def cross_spectrum(map1: DataFrame, map2: DataFrame, nside: int, lmax: int | None = None, window: DataFrame | None = None, shot1: float = 0.0, shot2: float = 0.0) -> DataFrame:
    """``l, cl, c11, c22, sigma`` over the pixels that are good in both maps.

    ``window(l, w)`` is the pixel window to divide out, given as data.  The variance uses the sky
    fraction of the common pixels and is kept at zero or above.
    """
    lmax = 3 * nside - 1 if lmax is None else lmax
    good = lambda m, c: m.where("value is not null and not isnan(value)").select("pix", F.col("value").alias(c))
    both = good(map1, "v1").join(good(map2, "v2"), "pix")
    f_sky = both.count() / hp.npix(nside)
    one, two = both.select("pix", F.col("v1").alias("value")), both.select("pix", F.col("v2").alias("value"))
    twice = F.when(F.col("m") == 0, 1.0).otherwise(2.0)

    def power(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        product = F.col("r1") * F.col("r2") + F.col("i1") * F.col("i2")
        joined = x.select("l", "m", F.col("re").alias("r1"), F.col("im").alias("i1")).join(y.select("l", "m", F.col("re").alias("r2"), F.col("im").alias("i2")), ["l", "m"])
        return joined.groupBy("l").agg((F.sum(twice * product) / (2 * F.first("l") + 1)).alias(name))

    a, b = written(coefficients(one, nside, lmax), "alm"), written(coefficients(two, nside, lmax), "alm")
    # The cross term uses refined coefficients, the auto terms of the variance plain ones.
    c = power(refined(one, nside, lmax), refined(two, nside, lmax), "cl").join(power(a, a, "c11"), "l").join(power(b, b, "c22"), "l")
    if window is not None:
        w2 = F.col("w") * F.col("w")
        c = c.join(window, "l").select("l", *[(F.col(x) / w2).alias(x) for x in ("cl", "c11", "c22")])
    variance = (F.col("cl") * F.col("cl") + (F.col("c11") + shot1) * (F.col("c22") + shot2)) / ((2 * F.col("l") + 1) * f_sky)
    return c.withColumn("sigma", F.sqrt(F.greatest(variance, F.lit(0.0))))


def degraded(sky_map: DataFrame, nside: int, nside_out: int) -> DataFrame:
    """Mean of the good pixels whose centres lie in each coarser pixel."""
    good = hp.with_centre(sky_map.where("value is not null and not isnan(value)"), nside)
    coarse = good.select(hp.z_phi_to_pix(nside_out, F.col("pz"), F.col("pphi")).alias("pix"), "value")
    return coarse.groupBy("pix").agg(F.avg("value").alias("value"))
