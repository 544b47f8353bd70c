"""Enclosed, annular and stacked profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import ARCMIN
from .spatial import aperture_join, fewer_by_rings, ring_sums, shell_sums, with_cos_distance


def aperture_mean(sources: DataFrame, sky_map: DataFrame, nside: int, radius_arcmin: Column, key: str = "source_id", sums: DataFrame | None = None) -> DataFrame:
    """``key, n_pix, signal``: mean of the good pixels inside each source's disc; null without any.

    ``sums`` are the map's ``ring_sums`` where they are known already.
    """
    sums = ring_sums(sky_map, nside) if sums is None else sums
    each = shell_sums(sources.select(key, "lon", "lat", (radius_arcmin * ARCMIN).alias("radius")), sums, nside, F.array("radius"), key)
    rows = sources.select(key).join(each.select(key, F.col("n").alias("n_pix"), F.try_divide("s", "n").alias("signal")), key, "left")
    return rows.select(key, F.coalesce("n_pix", F.lit(0)).alias("n_pix"), "signal")


def annulus_mean(sources: DataFrame, sky_map: DataFrame, nside: int, inner_arcmin: Column, outer_arcmin: Column | None = None, key: str = "source_id", sums: DataFrame | None = None) -> DataFrame:
    """Mean between an inner radius (outside it) and an outer one (twice the inner by default)."""
    sums = ring_sums(sky_map, nside) if sums is None else sums
    outer = 2 * inner_arcmin if outer_arcmin is None else outer_arcmin
    near = sources.select(key, "lon", "lat", (F.least(inner_arcmin, outer) * ARCMIN).alias("r_in"), (outer * ARCMIN).alias("r_out"))
    each = shell_sums(near, sums, nside, F.array("r_in", "r_out"), key).where("r_idx = 1")
    rows = sources.select(key).join(each.select(key, F.col("n").alias("n_pix"), F.try_divide("s", "n").alias("background")), key, "left")
    return rows.select(key, F.coalesce("n_pix", F.lit(0)).alias("n_pix"), "background")


def _pixel_shells(sources: DataFrame, sky_map: DataFrame, nside: int, radii: list[float], key: str) -> DataFrame:
    """``key, r_idx, s, n`` from the pixels of the largest disc: each counts once, at the first radius that holds it."""
    found = aperture_join(sources.select(key, "lon", "lat", "_unit"), sky_map, nside, F.lit(radii[-1] * ARCMIN) * F.col("_unit"))
    edges = [F.cos(F.lit(r * ARCMIN) * F.col("_unit")) for r in radii]
    if len(radii) <= 32:
        first = sum(((e > F.col("cos_dist")).cast("int") for e in edges), F.lit(0))
    else:
        first = F.size(F.filter(F.array(*edges), lambda e: e > F.col("cos_dist")))
    shell = with_cos_distance(found).withColumn("r_idx", F.least(first, F.lit(len(radii) - 1)))
    return shell.groupBy(key, "r_idx").agg(F.sum("value").alias("s"), F.count("*").alias("n"))


def enclosed_profile(sources: DataFrame, sky_map: DataFrame, nside: int, radii_arcmin: list[float], key: str = "source_id", scale: Column | None = None, sums: DataFrame | None = None) -> DataFrame:
    """``key, r_idx, radius, n_pix, signal`` at every radius, from sums over shells and their running sums.

    With a ``scale`` (arcmin, by source) the radii are in units of it.  A source's shells come from ring
    sums where its rings and radii are fewer than the pixels of its largest disc (few radii or a fine
    map), else from those pixels: either way the fewer rows are joined.
    """
    radii = sorted(radii_arcmin)
    unit = F.lit(1.0) if scale is None else scale.cast("double")
    rows = sources.select(key, "lon", "lat", unit.alias("_unit"))
    largest = F.lit(radii[-1] * ARCMIN) * F.col("_unit")
    looked_up = fewer_by_rings(nside, F.lit(sum(radii) * ARCMIN) * F.col("_unit"), largest)
    at = F.transform(F.array(*[F.lit(float(r * ARCMIN)) for r in radii]), lambda r: r * F.col("_unit"))
    by_rings = lambda part: shell_sums(part, ring_sums(sky_map, nside) if sums is None else sums, nside, at, key).select(key, "r_idx", "s", "n")
    by_pixels = lambda part: _pixel_shells(part, sky_map, nside, radii, key)
    if scale is None:
        shells = by_rings(rows) if fewer_by_rings(nside, sum(radii) * ARCMIN, radii[-1] * ARCMIN) else by_pixels(rows)
    else:
        shells = by_rings(rows.where(looked_up)).unionByName(by_pixels(rows.where(~looked_up)))
    # Running sums hold from a shell to the next one that has pixels.
    own = Window.partitionBy(key).orderBy("r_idx")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    run = shells.select(key, F.col("r_idx").alias("at"), F.sum("s").over(upto).alias("s"), F.sum("n").over(upto).alias("n"), F.lead("r_idx").over(own).alias("next"))
    dense = run.withColumn("r_idx", F.explode(F.sequence("at", F.coalesce("next", F.lit(len(radii))) - 1)))
    grid = rows.select(key, "_unit").withColumn("r_idx", F.explode(F.sequence(F.lit(0), F.lit(len(radii) - 1))))
    full = grid.join(dense.select(key, "r_idx", "s", "n"), [key, "r_idx"], "left")
    return full.select(key, "r_idx", (F.element_at(F.array(*[F.lit(r) for r in radii]), F.col("r_idx") + 1) * F.col("_unit")).alias("radius"), F.coalesce("n", F.lit(0)).alias("n_pix"), F.try_divide("s", "n").alias("signal"))


def drop_incomplete(profiles: DataFrame, key: str, n_radii: int) -> DataFrame:
    """Profiles of which every radius has a value."""
    whole = profiles.groupBy(key).agg(F.count("signal").alias("n")).where(F.col("n") == n_radii)
    return profiles.join(whole.select(key), key, "left_semi")


def observed_profiles(fits: DataFrame, sky_map: DataFrame, nside: int, radii_arcmin: list[float], background_arcmin: float, fwhm_arcmin: float, key: str = "source_id", sums: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Profile and background (from the radius to the radius plus the beam) of fitted centres."""
    back = annulus_mean(fits, sky_map, nside, F.lit(background_arcmin), F.lit(background_arcmin + fwhm_arcmin), key, sums)
    return enclosed_profile(fits, sky_map, nside, radii_arcmin, key, sums=sums), back


def interpolated(grid: DataFrame, targets: DataFrame, key: str, outside: str = "clamp") -> DataFrame:
    """Linear interpolation of ``grid(key, radius, signal)`` at ``targets(key, target)``.

    Outside the grid: ``clamp`` takes the edge value, ``extrapolate`` extends the end segments,
    ``null`` gives null and ``error`` raises.  Null signals are left out first.
    """
    at = Window.partitionBy(key).orderBy("radius")
    ends = Window.partitionBy(key)
    segments = (
        grid.where("signal is not null and radius is not null")
        .withColumn("r1", F.lead("radius").over(at))
        .withColumn("s1", F.lead("signal").over(at))
        .withColumn("lo", F.min("radius").over(ends))
        .withColumn("hi", F.max("radius").over(ends))
        .withColumn("last", F.lead("r1").over(at).isNull())
        .where("r1 is not null")
    )
    x, first, last = F.col("target"), F.col("radius") == F.col("lo"), F.col("last")
    inside = ((x >= F.col("radius")) | first) & ((x < F.col("r1")) | last)
    found = targets.join(segments, key).where(inside)
    line = lambda t: F.col("signal") + (t - F.col("radius")) * (F.col("s1") - F.col("signal")) / (F.col("r1") - F.col("radius"))
    bad = (x < F.col("lo")) | (x > F.col("hi"))
    if outside == "clamp":
        value = line(F.greatest(F.col("lo"), F.least(F.col("hi"), x)))
    elif outside == "extrapolate":
        value = line(x)
    elif outside == "null":
        value = F.when(~bad, line(x))
    elif outside == "error":
        value = F.when(bad, F.raise_error(F.lit("target radius outside the profile"))).otherwise(line(x))
    else:
        raise ValueError(f"unknown rule {outside!r}")
    return found.select(*targets.columns, value.alias("value"))
