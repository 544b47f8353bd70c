"""Composite runs: the random pool, the mass-bin suite, cluster matching and the catalogue comparison."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import associations as assoc
from ..operators import bins as mass_bins
from ..operators import catalogue, cutouts, harmonics, matching, photometry, profiles, significance
from ..operators.rows import numbered_within
from ..operators.significance import SEED
from ..operators.spatial import BoundMap, bound_map, ring_sums
from ..sources.tables import written


def prepared_map(sky_map: DataFrame, nside: int, mask: DataFrame | None = None, mask_nside: int | None = None, smooth_arcmin: float | None = None, **settings: float) -> tuple[BoundMap, DataFrame]:
    """The map bound to its mask, smoothed on demand, with its running sums (each written once), and its statistics."""
    rows = sky_map if smooth_arcmin is None else harmonics.smoothed(sky_map, nside, smooth_arcmin)
    bound = bound_map(written(rows, "map"), nside, mask, mask_nside, **settings)
    return replace(bound, sums=written(ring_sums(bound.pixels, nside), "ring-sums")), photometry.map_statistics(bound.pixels)


def random_pool(sky_map: DataFrame, nside: int, radii_arcmin: list[float], n_points: int, abs_b_min: float = 10.0, seed: int | None = SEED) -> DataFrame:
    """``row, r_idx, radius, signal`` of random pointings with a value at every radius."""
    where = significance.random_positions(sky_map.sparkSession, n_points, abs_b_min, seed)
    found = profiles.enclosed_profile(where.withColumnRenamed("id", "source_id"), sky_map, nside, radii_arcmin)
    return profiles.drop_incomplete(found, "source_id", len(radii_arcmin)).withColumnRenamed("source_id", "row")


def stacked_profiles(sources: DataFrame, sky_map: BoundMap, pool: DataFrame, norms: list[float], n_boot: int, n_stack: int, seed: int | None = SEED, group: str = "bin_idx", key: str = "halo_idx", order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stacks of profiles in units of each source's size, for all groups in one plan.

    ``sources(group, key, lon, lat, theta)`` and ``pool(row, radius, signal)``.  The first result is
    ``group, r_idx, norm, stack, error, random_mean, random_error``: plain mean, deviation of the
    bootstrap means, mean and deviation of the random stacks; then the random stacks ``(group, r_idx,
    means)`` and the sources' own profiles ``(group, key, r_idx, signal)``.  A column ``reps`` of the
    sources, constant in a group, overrides the number of random stacks.  Sources are numbered by
    ``order`` (the key).
    """
    more = [c for c in (order, "reps") if c is not None and c in sources.columns and c != key]
    ranked = written(numbered_within(sources.select(group, key, "lon", "lat", "theta", *more), group, F.col(order or key)), "stack-sources")
    found = profiles.enclosed_profile(ranked.select(key, "lon", "lat", "theta"), sky_map.pixels, sky_map.nside, norms, key, F.col("theta"), sky_map.sums)
    own = written(found.join(ranked.select(key, group, "number"), key).select(group, key, "number", "r_idx", "signal"), "own-profiles")
    data = significance.group_bootstrap(own, ranked, n_boot, seed, group)
    reps = F.col("reps") if "reps" in ranked.columns else n_stack
    stacks = written(significance.scaled_stacks(ranked, pool, norms, reps, seed, group), "random-stacks")
    means = F.col("means")
    random = stacks.select(group, "r_idx", significance.array_mean(means).alias("random_mean"), significance.array_deviation(means).alias("random_error"))
    norm = F.element_at(F.array(*[F.lit(float(x)) for x in norms]), F.col("r_idx") + 1)
    return data.withColumn("norm", norm).join(random, [group, "r_idx"], "left"), stacks, own.drop("number")


@dataclass(frozen=True)
class Suite:
    """Settings of the run over mass bins, as far as they aren't those of the map."""

    box: float
    norms: tuple[float, ...]
    step: float = 0.2
    top_counts: tuple[int, ...] = (10, 50, 100)
    aperture_scale: float = 1.0
    n_boot: int = 10_000
    #: Random stacks of a bin, and of the first bins.
    n_stack: int = 1_000
    n_stack_high: int = 10_000
    high_bins: int = 3
    t_fit_every: int = 10
    cutout_bins: int = 3
    size_factor: float = 5.0
    random_cutouts: int = 0
    abs_b_min: float = 10.0
    seed: int | None = SEED


def suite_catalogue(halos: DataFrame, sky_map: BoundMap, pool: DataFrame, suite: Suite, **cuts: float) -> tuple[DataFrame, DataFrame]:
    """Cut halos of all realisations with signal, pool p-value at their own aperture and bin; and all bins.

    Realisations are a grouping key of every step (``sim``; the empty string where halos have none): edges
    of all of them come from one plan, signals and p-values from one pass over all halos.
    """
    named = halos.withColumn("sim", F.col("sim").cast("string") if "sim" in halos.columns else F.lit(""))
    rows = catalogue.halo_cuts(catalogue.halo_catalogue(named, suite.box, suite.aperture_scale), **cuts)
    rows = written(rows.withColumns({"lon": F.col("ell"), "lat": F.col("b"), "_id": F.concat_ws("/", "sim", F.col("halo_idx").cast("string"))}), "suite-halos")
    masses = rows.select("sim", "halo_idx", "mass")
    edges = written(mass_bins.grouped_edges(masses, "sim", suite.step, suite.top_counts, "halo_idx"), "suite-edges")
    signal = profiles.aperture_mean(rows, sky_map.pixels, sky_map.nside, F.col("aperture"), "_id", sky_map.sums).select("_id", "signal")
    at = written(rows.select("_id", F.col("aperture").alias("theta")).join(signal, "_id"), "suite-signals")
    tails = significance.signal_pvalue(at, pool, "_id").select("_id", "signal", "p")
    binned = mass_bins.assign_grouped(rows.join(tails, "_id"), edges, "sim").withColumn("_bin", F.concat_ws("/", "sim", F.col("bin_idx").cast("string")))
    binned = written(binned, "suite-binned")
    return binned, mass_bins.grouped_summary(binned, edges, masses, "sim", suite.top_counts, "halo_idx")


def mass_bin_suite(halos: DataFrame, sky_map: BoundMap, pool: DataFrame, suite: Suite, **cuts: float) -> dict[str, DataFrame]:
    """The run over mass bins of all realisations; realisation and bin are grouping keys of one plan.

    * ``halos``: cut catalogue with signal, pool p-value at the halo's own aperture, and bin;
    * ``bins``: edges, count and median of every bin, empty ones too;
    * ``profiles``: stacks and random stacks with errors, empirical p-value and sigma at each radius;
    * ``individual`` and ``random``: the halos' own profiles and the random stacks (arrays) behind them;
    * ``t_fits``: tails of Student laws fitted to the random stacks, one grouped pass for all;
    * ``cutouts`` and ``random_cutouts``: mean normalised cutouts of the first bins, by the angular size (not
      the aperture), around the halos and at random positions with sizes drawn from the bin.
    """
    binned, bins = suite_catalogue(halos, sky_map, pool, suite, **cuts)
    reps = F.when(F.col("bin_idx") < suite.high_bins, suite.n_stack_high).otherwise(suite.n_stack)
    sources = binned.select("_bin", "_id", "halo_idx", "lon", "lat", F.col("aperture").alias("theta"), reps.alias("reps"))
    stacked, stacks, own = stacked_profiles(sources, sky_map, pool, list(suite.norms), suite.n_boot, suite.n_stack, suite.seed, "_bin", "_id", "halo_idx")
    stacked = written(stacked, "suite-stacks")
    names = written(binned.select("_bin", "sim", "bin_idx").distinct(), "suite-names")
    by_name = lambda df: names.join(df, "_bin").drop("_bin")
    tail = significance.tail_of_stacks(stacked, stacks, ["_bin", "r_idx"])
    out = {"halos": binned.drop("_id", "_bin"), "bins": bins, "profiles": by_name(stacked.join(tail, ["_bin", "r_idx"], "left")), "random": by_name(stacks)}
    out["individual"] = by_name(own.join(binned.select("_id", "halo_idx"), "_id").drop("_id"))
    if suite.t_fit_every:
        out["t_fits"] = by_name(significance.student_fits(stacked, stacks, ["_bin"], suite.t_fit_every))
    first = binned.where(F.col("bin_idx") < suite.cutout_bins).select("_bin", "_id", "lon", "lat", "theta")
    cut = cutouts.cutout(first, sky_map.pixels, sky_map.nside, suite.size_factor * F.col("theta"), sky_map.npix, "_id").join(first.select("_id", "theta"), "_id")
    normal = cutouts.normalised(cut, F.col("theta"), sky_map.nbins, sky_map.half, "_id").join(first.select("_id", "_bin"), "_id")
    out["cutouts"] = by_name(normal.groupBy("_bin", "iu", "iv").agg(F.avg("value").alias("value"), F.count("*").alias("n_sources")))
    if suite.random_cutouts:
        seeds = None
        if suite.seed is not None:
            # Realisations count in numeric order where their names are numbers.
            at = F.row_number().over(Window.orderBy(F.expr("try_cast(sim AS bigint)"), "sim")) - 1
            place = names.select("sim").distinct().withColumn("_at", at)
            seeds = names.join(place, "sim").select("_bin", (cutout_seed(suite.seed, F.col("_at"), F.col("bin_idx"))).alias("seed"))
        random = cutouts.grouped_random_stack(first, "_bin", sky_map.pixels, sky_map.nside, suite.random_cutouts, sky_map.nbins, sky_map.half, sky_map.npix, suite.size_factor, suite.abs_b_min, seeds)
        out["random_cutouts"] = by_name(random)
    return out


def suite_tables(out: dict[str, DataFrame], suite: Suite, nbins: int, half: float) -> tuple[DataFrame, DataFrame]:
    """The run's results in the stored layout (``save_results``): one row for each halo and for each bin that holds one.

    Profiles are arrays by radius (p-values of halos by their number), images arrays of arrays.
    """
    keys = ["sim", "bin_idx"]

    def arrays(df: DataFrame, by: list[str], **columns: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(*by, *[F.col(c).alias(f"_{n}") for n, c in columns.items()])))
        return df.groupBy(*keys).agg(listed.alias("_l")).select(*keys, *[F.col(f"_l._{n}").alias(n) for n in columns])

    def images(df: DataFrame, name: str) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            image = np.full((nbins, nbins), np.nan)
            image[pdf["iu"], pdf["iv"]] = pdf["value"]
            return pd.DataFrame({"sim": [pdf["sim"].iloc[0]], "bin_idx": [pdf["bin_idx"].iloc[0]], name: [image.tolist()]})

        return df.groupBy(*keys).applyInPandas(run, f"sim string, bin_idx int, {name} array<array<double>>")

    halos = out["halos"]
    bins = out["bins"].where("count > 0").join(arrays(halos, ["halo_idx"], pval_data="p"), keys)
    # Every bin has all radii: one at which no source has a good pixel is null.
    norms = F.array(*[F.lit(float(x)) for x in suite.norms])
    grid = bins.select(*keys, F.posexplode(norms).alias("r_idx", "radius")).join(out["profiles"], [*keys, "r_idx"], "left")
    names = {"radii_norm": "radius", "stacked_profile": "stack", "stacked_error": "error", "random_profile": "random_mean", "random_error": "random_error", "p_value_profile": "p", "sigma_profile": "sigma"}
    if "t_fits" in out:
        grid = grid.join(out["t_fits"], [*keys, "r_idx"], "left")
        names |= {"t_fit_p_value": "p_t", "t_fit_sigma": "sigma_t"}
    bins = bins.join(arrays(grid, ["r_idx"], **names), keys)
    for source, name in (("cutouts", "cutout_mean"), ("random_cutouts", "cutout_random_mean")):
        if source in out:
            bins = bins.join(images(out[source], name), keys, "left")
    bounds = F.array(*[F.lit(float(x)) for x in (-half, half, -half, half)])
    return halos, bins.withColumn("cutout_extent", F.when(F.col("bin_idx") < suite.cutout_bins, bounds))


def cutout_seed(base: int, sim_index: int | Column, bin_idx: int | Column) -> int | Column:
    """Seed of the random cutouts of a realisation's bin."""
    return base + sim_index + bin_idx


def cluster_matching(halos: DataFrame, clusters: DataFrame, mass_function: DataFrame, sky_map: BoundMap, pool: DataFrame, centre: tuple, eps: float = 1.75, min_samples: int = 9, r_max: float = 50.0, threshold: float | None = 0.05, mass_sigma: float = 0.3, radius_col: str = "r500", extent: tuple[float, float] | None = None) -> dict[str, DataFrame]:
    """Associations with signals and p-values, matched one to one to observed clusters ``(obs_id, x, y, z)``.

    ``matches`` has the pairs, ``members`` and ``summary`` the signals, ``combined`` the members' p-values of
    each association joined into one, ``clusters`` that of every observed cluster (0.5 without a match)
    and ``overall`` one row over all of them.  With an ``extent`` (distance, mass) halos beyond the distance
    from the middle of their realisation or below the mass are left out first.
    """
    halos = halos if extent is None else catalogue.extent_centre_cut(halos, *extent)
    members = written(assoc.associations(halos, eps, min_samples, mass_sigma), "members")
    each, summary = assoc.association_signals(members, sky_map.pixels, sky_map.nside, pool, centre, radius_col, sky_map.sums)
    dense = matching.density_of(members.withColumn("log_mass", F.log10("mass")), mass_function)
    matches = written(matching.greedy_match(matching.matching_pairs(clusters, dense, r_max), threshold), "matches")
    combined = significance.stouffer(each, "label", "pval")
    whole, overall = significance.overall_significance(clusters, matches, combined)
    return {"members": each, "summary": summary, "matches": matches, "combined": combined, "clusters": whole, "overall": overall}


def catalogue_comparison(first: DataFrame, second: DataFrame, n_samples: int = 1000, seed: int | None = SEED) -> tuple[DataFrame, DataFrame]:
    """Masses of clusters matched in two lists ``(obs_id, cat_id, log_mass, log_mass_err)``, and their mean ratio."""
    both = matching.matched_in_both(first, second)
    pairs = both.select(F.col("obs_id").alias("key"), F.col("log_mass_a").alias("log_a"), F.col("log_mass_err_a").alias("err_a"), F.col("log_mass_b").alias("log_b"), F.col("log_mass_err_b").alias("err_b"))
    return both, photometry.mass_ratio(pairs, n_samples, seed)
