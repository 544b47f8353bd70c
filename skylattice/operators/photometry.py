"""Calibrated photometry, mass scaling and catalogue summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cosmology import angular_diameter_distance, growth
from ..functions.geometry import ARCMIN, solid_angle
from ..functions.stats import normal_isf
from .profiles import interpolated


def calibrated_y(matches: DataFrame, om: float = 0.3111) -> DataFrame:
    """Adds Y of an aperture: solid angle times signal over background, times D_A squared, scaled by E(z).

    ``matches(.., theta, signal, background, z)``; distances in Mpc/h.
    """
    y = solid_angle(F.col("theta")) * (F.col("signal") - F.col("background"))
    d = angular_diameter_distance(F.col("z"), om)
    return matches.withColumns({"y_sky": y, "d_a": d}).withColumn("y_cal", F.col("y_sky") * F.col("d_a") * F.col("d_a")).withColumn("y_scaled", F.col("y_cal") * F.pow(growth(F.col("z"), om), F.lit(-2.0 / 3)))


def mass_matched(matches: DataFrame, profiles: DataFrame, backgrounds: DataFrame, om: float = 0.3111) -> DataFrame:
    """Signal and background interpolated at each match's angular size (an error outside), then calibrated.

    ``matches(key, theta, z)``, ``profiles(key, radius, signal)``, ``backgrounds`` likewise; matches
    without a profile are left out.
    """
    at = matches.select("key", F.col("theta").alias("target"))
    signal = interpolated(profiles, at, "key", "error").select("key", F.col("value").alias("signal"))
    back = interpolated(backgrounds, at, "key", "error").select("key", F.col("value").alias("background"))
    return calibrated_y(matches.join(signal, "key").join(back, "key"), om)


def catalogue_scaling(rows: DataFrame, om: float = 0.3111, h0: float = 70.0) -> DataFrame:
    """Published flux and mass columns in physical units, with errors in dex; unusable rows go.

    ``y5r500`` (1e-3 arcmin^2), ``msz`` (1e14) with upper and lower errors, ``redshift``.
    """
    good = rows
    for c in ("y5r500", "y5r500_err", "msz", "msz_err_up", "msz_err_low", "redshift"):
        good = good.where(F.col(c).isNotNull() & ~F.isnan(c))
    good = good.where("y5r500 > 0 and y5r500_err > 0 and msz > 0 and redshift >= 0 and msz - msz_err_low > 0 and msz + msz_err_up > 0")
    d = angular_diameter_distance(F.col("redshift"), om) * (100.0 / h0)
    y = F.col("y5r500") / 1.81 * 1e-3 * ARCMIN**2 * d * d * F.pow(growth(F.col("redshift"), om), F.lit(-2.0 / 3))
    mass = F.col("msz") * 1e14 * 0.7
    return good.select(
        "*",
        y.alias("y500"),
        mass.alias("mass"),
        F.log10(mass).alias("log_mass"),
        (F.col("y5r500_err") / (F.col("y5r500") * math.log(10))).alias("log_y_err"),
        (F.log10(F.col("msz") + F.col("msz_err_up")) - F.log10("msz")).alias("log_m_up"),
        (F.log10("msz") - F.log10(F.col("msz") - F.col("msz_err_low"))).alias("log_m_low"),
    )


def mass_statistics(members: DataFrame, group: str) -> DataFrame:
    """Mean and population deviation of masses and log masses, and the error in dex."""
    lm = F.log10("mass")
    out = members.where("mass > 0").groupBy(group).agg(F.count("*").alias("n"), F.avg("mass").alias("mean_mass"), F.stddev_pop("mass").alias("std_mass"), F.avg(lm).alias("mean_log"), F.stddev_pop(lm).alias("std_log"))
    return out.withColumn("log_err", F.col("std_mass") / (F.col("mean_mass") * math.log(10)))


def mass_ratio(pairs: DataFrame, n_samples: int = 1000, seed: int | None = None) -> DataFrame:
    """Monte Carlo of the mean log ratio of two masses with log errors: ``mean, error`` over samples.

    Without a seed the deviates come from a low-discrepancy sequence through the normal quantile.
    """
    samples = pairs.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    if seed is None:
        part = lambda a, b: F.pmod(F.col("sample") * a + F.col("key") * b + 0.5 * a, F.lit(1.0))
        g1 = normal_isf(F.greatest(F.least(part(0.6180339887498949, 0.7548776662466927), F.lit(1 - 1e-9)), F.lit(1e-9)))
        g2 = normal_isf(F.greatest(F.least(part(0.5698402909980532, 0.3247179572447460), F.lit(1 - 1e-9)), F.lit(1e-9)))
    else:
        # Deviates by a hash of seed, sample and key are the same in every attempt of a task.
        part = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "sample", "key"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
        g1, g2 = normal_isf(part(1)), normal_isf(part(2))
    e1, e2 = F.greatest("err_a", F.lit(1e-6)), F.greatest("err_b", F.lit(1e-6))
    ratio = F.col("log_a") + e1 * g1 - F.col("log_b") - e2 * g2
    means = samples.groupBy("sample").agg(F.avg(ratio).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("error"))


def simulation_summary(profiles: DataFrame, group: list[str]) -> DataFrame:
    """Over realisations: mean signal and error, root mean square random error, median and percentiles of p."""
    p = F.when(F.col("p") > 0, F.col("p"))
    return profiles.groupBy(*group).agg(
        F.avg("signal").alias("signal"),
        F.avg("error").alias("error"),
        F.sqrt(F.avg(F.col("random_error") * F.col("random_error"))).alias("random_error"),
        F.median(p).alias("p_median"),
        F.percentile(p, F.lit(0.16)).alias("p_16"),
        F.percentile(p, F.lit(0.84)).alias("p_84"),
    )


def map_statistics(sky_map: DataFrame) -> DataFrame:
    good = sky_map.where("value is not null and not isnan(value)")
    return good.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
