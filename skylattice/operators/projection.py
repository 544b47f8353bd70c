"""Projections of particles and density grids onto the sky."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import healpix as hp
from .rows import computed


def radial_shell(particles: DataFrame, observer: tuple, r_min: float | None = None, r_max: float | None = None) -> DataFrame:
    """Particles with distance ``r`` between the limits (inclusive), and their direction."""
    d = [F.col(c) - o for c, o in zip("xyz", observer, strict=True)]
    rows = computed(particles, r=F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    rows = computed(rows, zdir=F.try_divide(d[2], F.col("r")), phi=F.pmod(F.atan2(d[1], d[0]), F.lit(hp.TWO_PI)))
    if r_max is not None:
        rows = rows.where(F.col("r") <= r_max)
    return rows if r_min is None else rows.where(F.col("r") >= r_min)


def particle_counts(particles: DataFrame, nside: int, observer: tuple, r_min: float | None = None, r_max: float | None = None) -> DataFrame:
    """``pix, n`` of every pixel, zeros included; a particle at the observer counts in the first ring."""
    shell = radial_shell(particles, observer, r_min, r_max).where("r is not null and not isnan(r)")
    pix = hp.z_phi_to_pix(nside, F.coalesce("zdir", F.lit(1.0)), F.col("phi"))
    counted = computed(shell.select("zdir", "phi"), pix=pix).groupBy("pix").agg(F.count("*").alias("n"))
    return particles.sparkSession.range(hp.npix(nside)).withColumnRenamed("id", "pix").join(counted, "pix", "left").select("pix", F.coalesce("n", F.lit(0)).alias("n"))


def simpson_weights(n: int) -> list[float]:
    """Weights (in steps) of Simpson's rule over n samples.

    An even number of samples takes the usual rule up to the last interval, which is integrated
    under the parabola through the last three samples.
    """
    if n == 1:
        return [0.0]
    if n == 2:
        return [0.5, 0.5]
    odd = n if n % 2 else n - 1
    w = [0.0] * n
    for i in range(0, odd - 2, 2):
        w[i] += 1 / 3
        w[i + 1] += 4 / 3
        w[i + 2] += 1 / 3
    if n % 2 == 0:
        w[n - 1] += 5 / 12
        w[n - 2] += 8 / 12
        w[n - 3] -= 1 / 12
    return w


def grid_projection(grid: DataFrame, shape: tuple[int, int, int], nside: int, box: float, observer: tuple, r_max: float, dr: float, r_min: float = 0.0, power: float = 2.0, periodic: bool = False) -> DataFrame:
    """``pix, value``: mean density along each pixel's ray, weighted by r to a power.

    ``grid(ix, iy, iz, rho)`` has cell centres at (i + 1/2) box / n.  Each sample is the trilinear mean
    of eight cells, met by an equi-join; a sample outside the cell centres is an error unless periodic,
    and so is a cell that the grid lacks (cells of no weight are not needed).
    """
    spark = grid.sparkSession
    n_steps = math.ceil((r_max + dr - r_min) / dr - 1e-9)
    weights = F.array(*[F.lit(w) for w in simpson_weights(n_steps)])
    flat = F.sqrt(1 - F.col("pz") * F.col("pz"))
    pixels = hp.with_centre(spark.range(hp.npix(nside)).withColumnRenamed("id", "pix"), nside)
    rays = pixels.withColumns({"dx": flat * F.cos("pphi"), "dy": flat * F.sin("pphi"), "dz": F.col("pz")})
    steps = rays.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1)))).withColumn("r", r_min + F.col("k") * dr)
    base = steps.select("pix", "r", (F.pow("r", F.lit(float(power))) * F.get(weights, F.col("k"))).alias("w"), *[((o + F.col("r") * F.col(f"d{c}")) * n / box - 0.5).alias(f"g{c}") for c, o, n in zip("xyz", observer, shape, strict=True)])
    inside = F.lit(True)
    for c, n in zip("xyz", shape, strict=True):
        inside = inside & (F.col(f"g{c}") >= 0) & (F.col(f"g{c}") <= n - 1)
    if not periodic:
        base = base.withColumn("w", F.when(inside, F.col("w")).otherwise(F.raise_error(F.lit("a ray leaves the grid"))))
    corner = F.explode(F.array(*[F.array(F.lit(i), F.lit(j), F.lit(k)) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    cells = base.withColumn("c", corner)

    def index(c: str, i: int, n: int) -> Column:
        low = F.floor(f"g{c}") if periodic else F.least(F.floor(f"g{c}"), F.lit(n - 2))
        at = low + F.col("c")[i]
        return (F.pmod(at, F.lit(n)) if periodic else at).cast("int").alias(f"i{c}")

    def share(c: str, i: int, n: int) -> Column:
        low = F.floor(f"g{c}") if periodic else F.least(F.floor(f"g{c}"), F.lit(n - 2))
        part = F.col(f"g{c}") - low
        return F.when(F.col("c")[i] == 1, part).otherwise(1 - part)

    weight = F.lit(1.0)
    for i, (c, n) in enumerate(zip("xyz", shape, strict=True)):
        weight = weight * share(c, i, n)
    rows = cells.select("pix", "w", weight.alias("t"), *[index(c, i, n) for i, (c, n) in enumerate(zip("xyz", shape, strict=True))])
    joined = rows.join(grid, ["ix", "iy", "iz"], "left").withColumn("rho", F.when(F.col("rho").isNotNull() | (F.col("w") * F.col("t") == 0), F.coalesce("rho", F.lit(0.0))).otherwise(F.raise_error(F.lit("the grid lacks a cell"))))
    return joined.groupBy("pix").agg((F.sum(F.col("w") * F.col("t") * F.col("rho")) / F.sum(F.col("w") * F.col("t"))).alias("value"))
