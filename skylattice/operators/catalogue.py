"""Catalogue scans, cuts and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import angular_size_arcmin, icrs_to_galactic_spherical
from ..sources.tables import part_types as known_types
from .rows import computed, numbered


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns under standard names; a missing one is an error that lists what there is."""
    missing = sorted(set(mapping.values()) - set(df.columns))
    if missing:
        raise KeyError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df.select(*[F.col(source).alias(name) for name, source in mapping.items()])


def simulations(halos: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct realisations in numeric order."""
    out = halos.select(F.col("sim").cast("int").alias("sim")).distinct().orderBy("sim")
    return out if limit is None else out.limit(limit)


def simulation(halos: DataFrame, sim: str) -> DataFrame:
    """One realisation; with a table partitioned by ``sim`` only its files are read."""
    out = halos.where(F.col("sim") == sim)
    if out.limit(1).count() == 0:
        there = [r["sim"] for r in halos.select("sim").distinct().orderBy("sim").limit(50).collect()]
        raise KeyError(f"no simulation {sim}; there are {', '.join(map(str, there))}")
    return out


def fof_units(groups: DataFrame, flip_xz: bool = False) -> DataFrame:
    """Masses in solar masses, and on demand x and z swapped in positions and velocities only."""
    swap = {"x": "z", "z": "x", "vx": "vz", "vz": "vx"} if flip_xz else {}
    return groups.select(*[(F.col("mass") * 1e10).alias("mass") if c == "mass" else F.col(swap.get(c, c)).alias(c) for c in groups.columns])


def particles(snapshot: DataFrame, part_types: list[str] | None = None, flip_xz: bool = False) -> DataFrame:
    """Positions of the given particle types; unknown types are ignored unless none is left."""
    known = known_types(snapshot)
    chosen = known if part_types is None else [t for t in part_types if t in known]
    if not chosen:
        raise KeyError(f"none of {part_types}; there are {known}")
    x, z = ("z", "x") if flip_xz else ("x", "z")
    return snapshot.where(F.col("part_type").isin(chosen)).select("part_type", F.col(x).alias("x"), "y", F.col(z).alias("z"))


def extent_centre_cut(halos: DataFrame, r_max: float = 400.0, mass_min: float = 5e13) -> DataFrame:
    """Halos within ``r_max`` of the middle of their realisation's extent and of at least ``mass_min``.

    The extent ignores null and NaN coordinates (one such row does not void its realisation).
    """
    good = lambda c: F.when(~F.isnan(c), F.col(c))
    extent = halos.groupBy("sim").agg(*[((F.max(good(c)) + F.min(good(c))) / 2).alias(f"_{c}") for c in "xyz"])
    rows = halos.join(extent, "sim")
    r = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return rows.withColumn("r", r).where(~F.isnan("r") & (F.col("r") <= r_max) & ~F.isnan("mass") & (F.col("mass") >= mass_min)).select(*halos.columns, "r")


def halo_catalogue(halos: DataFrame, box_size: float, aperture_scale: float = 1.0) -> DataFrame:
    """Adds distance, Galactic position, angular size, aperture and log mass, seen from the box's centre."""
    centre = (box_size / 2,) * 3
    r, ell, b = icrs_to_galactic_spherical(F.col("x"), F.col("y"), F.col("z"), centre)
    rows = computed(halos, r=r, ell=ell, b=b)
    theta = angular_size_arcmin(F.col("r500"), F.col("r"))
    rows = computed(rows, theta=theta, log_mass=F.when(F.col("mass") > 0, F.log10("mass")))
    return rows.withColumn("aperture", aperture_scale * F.col("theta")).select(*halos.columns, "r", "ell", "b", "theta", "aperture", "log_mass")


def halo_cuts(rows: DataFrame, r_min: float = 0.0, r_max: float | None = None, b_min: float = 0.0, theta_min: float = 0.0, theta_max: float | None = None, mass_min: float = 0.0, mass_max: float | None = None) -> DataFrame:
    """Selection cuts, all inclusive; rows with null, NaN or non-positive values go."""

    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e300)

    keep = finite("mass") & (F.col("mass") > 0) & finite("r") & (F.col("r") >= r_min) & (F.abs("b") >= b_min) & (F.col("theta") >= theta_min) & (F.col("mass") >= mass_min)
    for name, most in (("r", r_max), ("theta", theta_max), ("mass", mass_max)):
        if most is not None:
            keep = keep & (F.col(name) <= most)
    return rows.where(keep)


def by_mass(halos: DataFrame, key: str) -> DataFrame:
    """Adds the rank by falling mass; equal masses stand in the order of the key."""
    return numbered(halos, F.col("mass").desc_nulls_last(), F.col(key), name="mass_rank").withColumn("mass_rank", F.col("mass_rank") + 1)


def chosen_simulations(halos: DataFrame, requested: str | int | None, limit: int | None = None) -> list[str]:
    """Realisations to run: "all" lists them in numeric order (the first ``limit``), one id stands for itself."""
    if requested is None:
        raise ValueError("a simulation must be named, or all of them")
    if isinstance(requested, str) and requested.lower() == "all":
        return [str(r["sim"]) for r in simulations(halos, limit).collect()]
    return [str(requested)]


def mean_over_simulations(images: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Mean of an image's cells over the realisations that have them (nulls and NaN are left out)."""
    return images.groupBy(*group).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(value), F.countDistinct("sim").alias("n_sims"))
