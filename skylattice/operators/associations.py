"""Associations of halos across realisations by density clustering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angular_size_arcmin, icrs_to_galactic_spherical
from ..sources.tables import written
from .graph import connected_components
from .profiles import aperture_mean
from .rows import computed, numbered
from .significance import signal_pvalue
from .spatial import cell_neighbours, ring_sums


def neighbours(halos: DataFrame, eps: float) -> DataFrame:
    """``id, other, dist`` of all pairs within eps, each row with itself included."""
    return cell_neighbours(halos, halos.withColumnRenamed("id", "other"), eps, "id", "other")


def _linked_cells(core: DataFrame, side: float, eps: float) -> DataFrame:
    """``a, b``: enough pairs of core cells that hold core rows within eps to give all components.

    For every two cells near enough, the row of the first that is nearest to the second's middle is held
    against the second's rows: as many rows as there are core rows, times a constant.  Only cells that
    this leaves in different components compare the rows on the sides they turn to each other.
    """
    cells = written(core.groupBy("node", "cx", "cy", "cz").agg(F.count("*").alias("n")), "core-cells")
    ahead = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    offset = F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in ahead]))
    from_ = cells.select(F.col("node").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("cx", "cy", "cz")], offset.alias("_o"))
    from_ = from_.select("a", *[(F.col(f"a{c}") + F.col("_o")[i]).alias(c) for i, c in enumerate(("cx", "cy", "cz"))])
    middle = [((F.col(f"c{c}") + 0.5) * side).alias(f"m{c}") for c in "xyz"]
    pairs = written(from_.join(cells, ["cx", "cy", "cz"]).select("a", F.col("node").alias("b"), *middle), "cell-pairs")
    apart = lambda one, two: F.sqrt(sum((F.pow(F.col(f"{one}{c}") - F.col(f"{two}{c}"), 2) for c in "xyz"), F.lit(0.0)))
    at = lambda name, prefix: core.select(F.col("node").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in "xyz"])
    toward = pairs.join(at("a", "p"), "a").groupBy("a", "b").agg(F.min_by(F.struct("px", "py", "pz"), apart("p", "m")).alias("p")).select("a", "b", "p.*")
    met = toward.join(at("b", "q"), "b").groupBy("a", "b").agg(F.min(apart("p", "q")).alias("d"))
    quick = written(met.where(F.col("d") <= eps).select("a", "b"), "cell-links")
    roots = connected_components(quick)
    rooted = lambda side_: roots.select(F.col("node").alias(side_), F.col("root").alias(f"r{side_}"))
    open_ = pairs.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "mx", "my", "mz")

    def gap(prefix: str) -> Column:
        beyond = lambda c: F.greatest(F.abs(F.col(f"{prefix}{c}") - F.col(f"m{c}")) - side / 2, F.lit(0.0))
        return F.sqrt(sum((F.pow(beyond(c), 2) for c in "xyz"), F.lit(0.0)))

    edge = open_.join(at("a", "p"), "a").where(gap("p") <= eps)
    rest = edge.join(at("b", "q"), "b").where(apart("p", "q") <= eps).select("a", "b").distinct()
    return quick.unionByName(rest)


def density_clusters(halos: DataFrame, eps: float = 1.75, min_samples: int = 9) -> DataFrame:
    """``id, label`` of clustered rows of ``halos(id, x, y, z)``; noise has no row.

    Core rows have min_samples neighbours, themselves included.  Clusters are components of core
    rows; a border row goes to the neighbouring cluster whose first core row is least.  Labels count
    from 0 in the order of the clusters' first core rows.

    Rows of one cell whose diagonal is eps are all neighbours: a cell of min_samples rows is core without
    a comparison, and the core rows of a cell are one node of the graph.  Only rows of smaller cells are
    compared with those around them, fewer than min_samples of each cell.
    """
    side = eps / math.sqrt(3) * (1 - 1e-9)
    cell = {f"c{c}": F.floor(F.col(c) / side) for c in "xyz"}
    rows = halos.select("id", "x", "y", "z").withColumns(cell)
    node = F.concat_ws(",", *[F.col(c).cast("string") for c in cell])
    rows = written(rows.join(rows.groupBy(*cell).agg(F.count("*").alias("n")), list(cell)).withColumn("node", node), "cells")
    sparse = rows.where(F.col("n") < min_samples)
    near = written(cell_neighbours(rows, sparse.select(F.col("id").alias("other"), "x", "y", "z"), eps, "id", "other").select("id", "other"), "near")
    found = near.groupBy("other").agg(F.count("*").alias("k")).where(F.col("k") >= min_samples).select(F.col("other").alias("id"))
    core = rows.where(F.col("n") >= min_samples).unionByName(sparse.join(found, "id", "left_semi"))
    core = written(core.select("id", "x", "y", "z", *cell, "node"), "core")
    joined = connected_components(_linked_cells(core, side, eps)).select("node", F.col("root").alias("_c"))
    grouped = core.join(joined, "node", "left").select("id", F.coalesce("_c", "node").alias("_c"))
    first = grouped.groupBy("_c").agg(F.min("id").alias("root"))
    rooted = written(grouped.join(first, "_c").select("id", "root"), "core-roots")
    border = near.join(rooted, "id").join(rooted.select(F.col("id").alias("other")), "other", "left_anti").groupBy("other").agg(F.min("root").alias("root")).select(F.col("other").alias("id"), "root")
    labels = numbered(rooted.select("root").distinct(), F.col("root"), name="label").withColumn("label", F.col("label").cast("int"))
    return rooted.unionByName(border).join(labels, "root").select("id", "label")


def associations(halos: DataFrame, eps: float = 1.75, min_samples: int = 9, mass_sigma: float = 0.3) -> DataFrame:
    """Members of the associations of ``halos(id, sim, x, y, z, mass, ...)``.

    After clustering: the member nearest to the centroid for each realisation (ties: the least id),
    one clip of log-mass outliers, and groups that keep min_samples members.  Rows with null or NaN
    position or mass are left out.
    """
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    good = halos
    for c in ("x", "y", "z", "mass"):
        good = good.where(F.col(c).isNotNull() & ~F.isnan(c))
    rows = good.join(density_clusters(good.select("id", "x", "y", "z"), eps, min_samples), "id")
    centre = rows.groupBy("label").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    dist = F.sqrt(sum((F.pow(F.col(c) - F.col(f"c{c}"), 2) for c in "xyz"), F.lit(0.0)))
    ranked = rows.join(centre, "label").withColumn("_d", dist).withColumn("_k", F.row_number().over(Window.partitionBy("label", "sim").orderBy("_d", "id")))
    single = ranked.where("_k = 1").drop("_k", "_d", "cx", "cy", "cz")
    mean = single.groupBy("label").agg(F.avg(F.log10("mass")).alias("_m"))
    clipped = single.join(mean, "label").where(F.abs(F.log10("mass") - F.col("_m")) <= mass_sigma).drop("_m")
    kept = clipped.groupBy("label").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_samples).select("label")
    return clipped.join(kept, "label", "left_semi")


def association_summary(members: DataFrame, n_realisations: int) -> DataFrame:
    return members.groupBy("label").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"], F.count("*").alias("n_members"), (F.count("*") / F.lit(n_realisations)).alias("fraction_present"))


def with_optional(members: DataFrame, optional: DataFrame, key: str = "id") -> DataFrame:
    """Members with optional data; a column of the same name takes the place of the member's own, for all rows."""
    own = [c for c in members.columns if c == key or c not in optional.columns]
    return members.select(*own).join(optional, key, "left")


def as_maps(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys.., entries``: each row as a map from column to its value as JSON, for access by name."""
    others = [c for c in rows.columns if c not in keys]
    pairs = [x for c in others for x in (F.lit(c), F.to_json(F.struct(F.col(c).alias("value"))))]
    return rows.select(*keys, F.create_map(*pairs).alias("entries"))


def member_sky(members: DataFrame, centre: tuple, radius_col: str = "r500") -> DataFrame:
    """Distance, Galactic position and angular size of each member."""
    if radius_col not in members.columns:
        raise KeyError(f"no column {radius_col}; there are {', '.join(members.columns)}")
    r, ell, b = icrs_to_galactic_spherical(F.col("x"), F.col("y"), F.col("z"), centre)
    rows = computed(members, r=r, ell=ell, b=b)
    return computed(rows, theta500=angular_size_arcmin(F.col(radius_col), F.col("r")))


def median_position(members: DataFrame) -> DataFrame:
    """Medians of position, distance and size, each on its own."""
    return members.groupBy("label").agg(*[F.median(c).alias(f"median_{c}") for c in ("r", "ell", "b", "theta500")])


def centroid_sky(summary: DataFrame, centre: tuple) -> DataFrame:
    """Adds distance and Galactic position of each centroid ``(cx, cy, cz)`` seen from the centre."""
    r, ell, b = icrs_to_galactic_spherical(F.col("cx"), F.col("cy"), F.col("cz"), centre)
    return computed(summary, centroid_r=r, centroid_ell=ell, centroid_b=b)


def association_signals(members: DataFrame, sky_map: DataFrame, nside: int, pool: DataFrame, centre: tuple, radius_col: str = "r500", sums: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Signals and p-values of associations: of all members, and at the median positions.

    The members ``(id, label, x, y, z, radius)`` gain distance, Galactic position, angular size, the mean
    of the map inside it and the pool's upper tail; each label gets the medians, and signal and p-value
    there.  Every step is one plan over all members and labels.
    """
    placed = written(member_sky(members, centre, radius_col), "member-sky")
    sums = written(ring_sums(sky_map, nside), "ring-sums") if sums is None else sums

    def measured(rows: DataFrame, key: str, ell: str, b: str, theta: str) -> DataFrame:
        at = rows.select(key, F.col(ell).alias("lon"), F.col(b).alias("lat"), F.col(theta).alias("theta"))
        signal = aperture_mean(at, sky_map, nside, F.col("theta"), key, sums).select(key, "signal")
        return signal_pvalue(at.select(key, "theta").join(signal, key), pool, key).select(key, "signal", F.col("p").alias("pval"))

    each = placed.join(measured(placed, "id", "ell", "b", "theta500"), "id")
    medians = written(median_position(placed), "medians")
    found = measured(medians, "label", "median_ell", "median_b", "median_theta500")
    return each, medians.join(found.select("label", F.col("signal").alias("median_signal"), F.col("pval").alias("median_pval")), "label")
