"""The registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cosmology, geometry
from ..operators import associations as assoc
from ..operators import bins as mass_bins_ops
from ..operators import catalogue, cutouts, harmonics, matching, photometry, profiles, projection, significance
from ..operators.significance import golden_fraction
from ..operators.spatial import bound_map
from ..sources.tables import load_bins, save_results, shared_folder, table
from . import fixtures as fx
from . import oracle, suite

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def aperture_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.aperture_mean(fx.sources(spark, sf), fx.sky_map(spark, sf), fx.NSIDE, F.lit(300.0)), 6, "signal")


def annulus_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.annulus_mean(fx.sources(spark, sf), fx.sky_map(spark, sf), fx.NSIDE, F.lit(300.0)), 6, "background")


def enclosed_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.enclosed_profile(fx.sources(spark, sf), fx.sky_map(spark, sf), fx.NSIDE, list(oracle.RADII)), 6, "signal")


def halo_cuts(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalogue.halo_catalogue(fx.halos(spark, sf), fx.BOX)
    cut = catalogue.halo_cuts(rows, r_max=250.0, b_min=10.0, theta_min=5.0, theta_max=6000.0, mass_min=1e14, mass_max=4e15)
    return rounded(cut.select("halo_idx", "r", "ell", "b", "theta", "log_mass"), 6, "r", "ell", "b", "theta", "log_mass")


def halo_sorted(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("halo_idx"), (F.col("o_totalprice") * 1e10).alias("mass"))
    return catalogue.by_mass(rows, "halo_idx").select("halo_idx", "mass", "mass_rank")


def extent_centre_cut(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.points(spark, sf).withColumn("mass", 1e13 * (1 + F.col("id") % 17))
    return rounded(catalogue.extent_centre_cut(rows, 0.3, 5e13).select("id", "sim", "r"), 9, "r")


def mass_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") * 1e10).alias("mass"))
    edges = mass_bins_ops.mass_bin_edges(rows, 0.2, (10, 50, 100))
    binned = mass_bins_ops.assign_bins(rows.withColumn("log_mass", F.log10("mass")), edges)
    return rounded(mass_bins_ops.bin_summary(binned, edges, rows), 6, "lo", "hi", "median_log_mass")


def pool_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    pool = fx.pool(spark, sf)
    signals = pool.select("r_idx", "user_id", (F.col("signal") * 1.02).alias("signal"))
    p = significance.upper_tail(signals, pool.select("r_idx", F.col("signal").alias("value")), "r_idx", "user_id")
    return rounded(p.select(F.col("r_idx").cast("long").alias("r_idx"), "user_id", "p"), 9, "p")


def _n_rows(pool: DataFrame) -> int:
    return pool.select("row").distinct().count()


def bootstrap_stack(spark: SparkSession, sf: str) -> DataFrame:
    pool = fx.pool(spark, sf)
    return rounded(significance.bootstrap(pool, _n_rows(pool), oracle.N_BOOT, None), 6, "mean", "error")


def _stacks(pool: DataFrame) -> DataFrame:
    return significance.random_stacks(pool, _n_rows(pool), oracle.N_STACK, oracle.N_SRC, None)


def random_stack(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_stacks(fx.pool(spark, sf)).select("r_idx", "rep", "mean"), 6, "mean")


def empirical_sigma_profile(spark: SparkSession, sf: str) -> DataFrame:
    pool = fx.pool(spark, sf)
    data = pool.groupBy("r_idx").agg(F.avg("signal").alias("mean"))
    out = significance.significance_profile(data, _stacks(pool))
    out = out.withColumn("sigma", F.when(F.abs("sigma") < 1e300, F.col("sigma")))
    return rounded(out, 9, "p").withColumn("sigma", F.round("sigma", 6))


def student_profile(spark: SparkSession, sf: str) -> DataFrame:
    pool = fx.pool(spark, sf)
    data = pool.groupBy("r_idx").agg(F.avg("signal").alias("mean"))
    return rounded(significance.student_profile(data, _stacks(pool), 10, 1), 6, "p_t", "sigma_t")


def crossmatch_best(spark: SparkSession, sf: str) -> DataFrame:
    observed = table(spark, sf, "customer").select(F.col("c_custkey").alias("obs_id"), (F.col("c_custkey") + 0.31).alias("_k"), (F.col("c_acctbal") / 1e6).alias("z"))
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cat_id"), (F.col("s_acctbal") / 1e6).alias("z"))
    out = matching.crossmatch(fx.on_sky(observed, "_k"), fx.on_sky(known, "cat_id"), 240.0, 0.005)
    return rounded(rounded(out, 6, "separation_arcmin"), 9, "delta_z")


def _mass_function(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, n) for m, n in oracle.MASS_FUNCTION], "log_mass double, nd double")


def _halos(spark: SparkSession, sf: str) -> DataFrame:
    return matching.density_of(fx.points(spark, sf), _mass_function(spark)).withColumn("n", 1000 * F.col("n"))


def _references(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = lambda step: 0.4 * (golden_fraction(k, step) - 0.5)
    return table(spark, sf, "supplier").select(k.alias("ref_id"), at(fx.GOLDEN).alias("x"), at(fx.PLASTIC).alias("y"), at(0.5698402909980532).alias("z"), F.lit(13.5).alias("log_mass"))


def radius_cdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matching.halo_cdf(_halos(spark, sf), _references(spark, sf), 0.1), 9, "dist", "cdf", "dlogm")


def match_halo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matching.match_halo(_halos(spark, sf), _references(spark, sf), 0.1, 0.5, 0.5), 9, "cdf", "dist")


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matching.matching_matrix(_references(spark, sf).withColumnRenamed("ref_id", "obs_id"), _halos(spark, sf).withColumnRenamed("sim", "label"), 0.1)


def pval_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_matrix(spark, sf), 9, "pval", "dist")


def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matching.greedy_match(_matrix(spark, sf), None), 9, "pval", "dist")


def greedy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one matches among the near pairs only."""
    pairs = matching.matching_pairs(_references(spark, sf).withColumnRenamed("ref_id", "obs_id"), _halos(spark, sf).withColumnRenamed("sim", "label"), 0.1)
    return rounded(matching.greedy_match(pairs, 0.9999), 9, "pval", "dist")


def halo_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    near = assoc.neighbours(fx.points(spark, sf), 0.1)
    return rounded(near.groupBy("id").agg(F.count("*").alias("n_near"), F.sum("dist").alias("total_dist")), 6, "total_dist")


def halo_associations(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.points(spark, sf).withColumn("mass", F.pow(F.lit(10.0), F.col("log_mass")))
    found = assoc.associations(rows, 0.08, 5, 0.6)
    return found.select("label", "id", "sim")


def particle_projection(spark: SparkSession, sf: str) -> DataFrame:
    return projection.particle_counts(fx.points(spark, sf), 4, (0.0, 0.0, 0.0), r_max=0.4)


def grid_projection(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    cell = lambda q: F.pmod(F.floor(k / q), F.lit(6)).cast("int")
    grid = table(spark, sf, "orders").select(cell(1).alias("ix"), cell(6).alias("iy"), cell(36).alias("iz"), F.sqrt("o_totalprice").alias("rho")).groupBy("ix", "iy", "iz").agg(F.avg("rho").alias("rho"))
    return rounded(projection.grid_projection(grid, (6, 6, 6), 2, 6.0, (3.0, 3.0, 3.0), 2.0, 0.4), 6, "value")


def cutout_stack(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.suppliers(spark, sf)
    cut = cutouts.cutout(rows, fx.sky_map(spark, sf), fx.NSIDE, F.lit(1200.0), 11)
    theta: Column = 300 + F.col("source_id") % 5 * 60
    return rounded(cutouts.stacked(cutouts.normalised(cut, theta, 6, 2.0)), 6, "value")


def find_center(spark: SparkSession, sf: str) -> DataFrame:
    out = cutouts.find_centers(fx.suppliers(spark, sf), fx.sky_map(spark, sf), fx.NSIDE, 1800.0, 15, 240.0)
    return rounded(out, 6, "lon", "lat", "final_radius")


def mass_matched_y(spark: SparkSession, sf: str) -> DataFrame:
    pool = fx.pool(spark, sf).withColumnRenamed("user_id", "key")
    users = table(spark, sf, "events").select(F.col("user_id").alias("key")).distinct()
    matches = users.select("key", (1 + F.col("key") % 39 + 0.37).alias("theta"), (0.01 + 0.0001 * (F.col("key") % 1000)).alias("z"))
    signal = pool.select("key", "radius", "signal")
    out = photometry.mass_matched(matches, signal, signal.withColumn("signal", F.col("signal") / 2))
    return rounded(out.select("key", "signal", "d_a", "y_scaled"), 6, "signal", "d_a", "y_scaled")


def catalogue_scaling(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        k.alias("key"), (F.col("c_acctbal") / 1e3).alias("y5r500"), (0.1 + k % 7 / 10.0).alias("y5r500_err"), (1 + k % 11 / 2.0).alias("msz"),
        F.lit(0.3).alias("msz_err_up"), F.lit(0.25).alias("msz_err_low"), (0.01 + k % 13 / 200.0).alias("redshift"),
    )
    out = photometry.catalogue_scaling(rows).withColumn("y500", F.col("y500") * 1e6)
    names = ("y500", "log_mass", "log_y_err", "log_m_up", "log_m_low")
    return rounded(out.select("key", *names), 6, *names)


def sim_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("bin_idx"), e(0).alias("signal"), F.abs(e(1)).alias("error"), e(2).alias("random_error"), e(3).alias("p"))
    return rounded(photometry.simulation_summary(rows, ["bin_idx"]), 9, "signal", "error", "random_error", "p_median", "p_16", "p_84")


def mass_ratio(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.alias("key"), (14 + golden_fraction(k, fx.GOLDEN)).alias("log_a"), F.lit(0.1).alias("err_a"), (14 + golden_fraction(k, fx.PLASTIC)).alias("log_b"), F.lit(0.05).alias("err_b"))
    return rounded(photometry.mass_ratio(rows, 200), 6, "mean", "error")


def stouffer(spark: SparkSession, sf: str) -> DataFrame:
    p = golden_fraction(F.col("l_orderkey") * 7 + F.col("l_linenumber"), fx.GOLDEN)
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), p.alias("p"))
    return rounded(significance.stouffer(rows, "supp").select("supp", "n", "z"), 6, "z")


def galactic_frame(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.on_sky(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), "key")
    ell, b = geometry.radec_to_galactic(F.col("lon"), F.col("lat"))
    return rounded(rows.select("key", ell.alias("ell"), b.alias("b")), 6, "ell", "b")


def distances(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), ((F.col("s_acctbal") + 1000) / 1e5).alias("z")).withColumn("d_c", cosmology.comoving_distance(F.col("z")))
    out = rows.select("key", "d_c", cosmology.angular_diameter_distance(F.col("z")).alias("d_a"), cosmology.redshift_of_distance(F.col("d_c")).alias("z_back"))
    return rounded(rounded(out, 6, "d_c", "d_a"), 9, "z_back")


def map_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(photometry.map_statistics(fx.sky_map(spark, sf)), 6, "mean", "std")


def degraded_map(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(harmonics.degraded(fx.sky_map(spark, sf), fx.NSIDE, 4), 6, "value")


def smooth_map(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(harmonics.smoothed(fx.sky_map(spark, sf, 8), 8, 600.0), 6, "value")


def cross_cl(spark: SparkSession, sf: str) -> DataFrame:
    one = fx.sky_map(spark, sf, 8)
    two = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 768).alias("pix")).agg(F.avg("l_quantity").alias("value"))
    return rounded(harmonics.cross_spectrum(one, two, 8), 6, "cl", "c11", "c22", "sigma")


def signal_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    at = table(spark, sf, "customer").select(k.alias("key"), (44 * golden_fraction(k, fx.GOLDEN) - 1).alias("theta"), (14 + F.col("c_acctbal") / 5000).alias("signal"))
    return rounded(significance.signal_pvalue(at, fx.pool(spark, sf), "key").select("key", "p"), 9, "p")


def _wide_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The pool with radii from 20 to 800 arcmin."""
    return fx.pool(spark, sf).withColumn("radius", 20 * F.col("radius"))


_STACK = ("stack", "error", "random_mean", "random_error")


def stacked_profile(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("source_id")
    rows = fx.suppliers(spark, sf).select((k % 4).alias("bin_idx"), k, "lon", "lat", (200 + 40 * (k % 7)).cast("double").alias("theta"))
    sky_map, _ = suite.prepared_map(fx.sky_map(spark, sf), fx.NSIDE)
    out, _, _ = suite.stacked_profiles(rows, sky_map, _wide_pool(spark, sf), list(oracle.STACK_NORMS), oracle.STACK_BOOT, oracle.STACK_REPS, None, key="source_id")
    return rounded(out.select("bin_idx", "r_idx", *_STACK), 6, *_STACK)


CUTS = {"r_max": 250.0, "b_min": 10.0, "theta_min": 5.0, "theta_max": 6000.0, "mass_min": 1e14, "mass_max": 4e15}


def mass_bin_suite(spark: SparkSession, sf: str) -> DataFrame:
    sky_map, _ = suite.prepared_map(fx.sky_map(spark, sf), fx.NSIDE)
    settings = suite.Suite(fx.BOX, oracle.STACK_NORMS, n_boot=oracle.SUITE_BOOT, n_stack=oracle.SUITE_REPS, high_bins=0, t_fit_every=0, seed=None)
    out = suite.mass_bin_suite(fx.halos(spark, sf), sky_map, _wide_pool(spark, sf), settings, **CUTS)
    rows = out["profiles"].withColumn("sigma", F.when(F.abs("sigma") < 1e300, F.col("sigma")))
    return rounded(rounded(rows.select("bin_idx", "r_idx", *_STACK, "p", "sigma"), 6, *_STACK, "sigma"), 9, "p")


#: Settings of the run over several realisations: few heads, since each has a share of the halos.
_SIMS = suite.Suite(fx.BOX, oracle.STACK_NORMS, top_counts=oracle.SIM_HEADS, n_boot=oracle.SIM_BOOT, n_stack=oracle.SIM_REPS, n_stack_high=oracle.SIM_REPS_HIGH, high_bins=2, t_fit_every=1, cutout_bins=2, random_cutouts=oracle.RANDOM_CUTOUTS, size_factor=4.0, seed=None)


def _sim_halos(spark: SparkSession, sf: str) -> DataFrame:
    return fx.halos(spark, sf).withColumn("sim", (F.col("halo_idx") % oracle.SIMS).cast("string"))


def _sim_suite(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    sky_map, _ = suite.prepared_map(fx.sky_map(spark, sf), fx.NSIDE, npix=11, nbins=6, half=2.0)
    return suite.mass_bin_suite(_sim_halos(spark, sf), sky_map, _wide_pool(spark, sf), _SIMS, **CUTS)


def sim_suite_halos(spark: SparkSession, sf: str) -> DataFrame:
    sky_map, _ = suite.prepared_map(fx.sky_map(spark, sf), fx.NSIDE)
    halos, _ = suite.suite_catalogue(_sim_halos(spark, sf), sky_map, _wide_pool(spark, sf), _SIMS, **CUTS)
    return rounded(rounded(halos.select("sim", "halo_idx", "bin_idx", "signal", "p"), 6, "signal"), 9, "p")


def sim_suite_bins(spark: SparkSession, sf: str) -> DataFrame:
    sky_map, _ = suite.prepared_map(fx.sky_map(spark, sf), fx.NSIDE)
    _, bins = suite.suite_catalogue(_sim_halos(spark, sf), sky_map, _wide_pool(spark, sf), _SIMS, **CUTS)
    return rounded(bins.select("sim", "bin_idx", "lo", "hi", "count", "median_log_mass"), 6, "lo", "hi", "median_log_mass")


def sim_suite_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Stacks of all realisations' bins, by way of the stored tables."""
    halos, bins = suite.suite_tables(_sim_suite(spark, sf), _SIMS, 6, 2.0)
    folder = f"{shared_folder(spark)}/written/suite-{uuid.uuid4().hex}"
    save_results(halos, bins, folder)
    arrays = {"stack": "stacked_profile", "error": "stacked_error", "random_mean": "random_profile", "random_error": "random_error", "p": "p_value_profile"}
    stored = load_bins(spark, folder).select("sim", "bin_idx", "result_ord", F.posexplode(F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])).alias("r_idx", "v"))
    rows = stored.select("sim", "bin_idx", "result_ord", "r_idx", *[F.col("v")[n].alias(n) for n in arrays]).where("stack is not null")
    return rounded(rounded(rows, 6, *_STACK), 9, "p")


def sim_suite_cutouts(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cutouts of the first bins of all realisations, around halos and at random positions."""
    out = _sim_suite(spark, sf)
    random = out["random_cutouts"].select("sim", "bin_idx", "iu", "iv", F.col("value").alias("random_value"), F.col("n_sources").alias("n_random"))
    return rounded(out["cutouts"].join(random, ["sim", "bin_idx", "iu", "iv"], "full"), 6, "value", "random_value")


def sim_suite_t_fits(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_sim_suite(spark, sf)["t_fits"], 6, "p_t", "sigma_t")


def wide_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Discs of many rings of a finer map."""
    found = profiles.enclosed_profile(fx.suppliers(spark, sf), fx.sky_map(spark, sf, oracle.FINE), oracle.FINE, list(oracle.WIDE_RADII))
    return rounded(found, 6, "signal")


def association_signals(spark: SparkSession, sf: str) -> DataFrame:
    members = fx.points(spark, sf).select("id", F.col("sim").alias("label"), "x", "y", "z", (0.03 + 0.001 * (F.col("id") % 10)).alias("r500"))
    each, medians = assoc.association_signals(members, fx.sky_map(spark, sf), fx.NSIDE, _wide_pool(spark, sf), (0.0, 0.0, 0.0))
    means = each.groupBy("label").agg(F.count("*").alias("n_members"), F.avg("signal").alias("mean_signal"), F.avg("pval").alias("mean_pval"))
    out = rounded(medians.join(means, "label"), 9, "mean_pval", "median_pval")
    return rounded(out, 6, "mean_signal", "median_r", "median_ell", "median_b", "median_theta500", "median_signal")


def masked_aperture(spark: SparkSession, sf: str) -> DataFrame:
    mask = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % (12 * fx.NSIDE**2)).alias("pix")).agg((F.avg("l_discount") - 0.03).alias("weight"))
    sky_map = bound_map(fx.sky_map(spark, sf), fx.NSIDE, mask, fx.NSIDE)
    return rounded(profiles.aperture_mean(fx.sources(spark, sf), sky_map.pixels, fx.NSIDE, F.lit(300.0)), 6, "signal")


def random_cutout_stack(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "supplier").select((300 + F.col("s_suppkey") % 5 * 60).cast("double").alias("theta"))
    normal = cutouts.random_stack(sizes, fx.sky_map(spark, sf), fx.NSIDE, oracle.RANDOM_CUTOUTS, 6, 2.0, 11, 4.0, seed=None)
    return rounded(cutouts.stacked(normal), 6, "value")


def matched_in_both(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("double").alias("z")
    observed = fx.on_sky(table(spark, sf, "customer").select(F.col("c_custkey").alias("obs_id"), (F.col("c_custkey") + 0.31).alias("_k"), none), "_k")
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cat_id"), (F.col("s_suppkey") + 0.5).alias("_k"), none)
    one, two = (matching.crossmatch(observed, fx.on_sky(known, k), 1200.0, None).select("obs_id", "cat_id", F.col("separation_arcmin").alias("sep")) for k in ("cat_id", "_k"))
    return rounded(matching.matched_in_both(one, two), 6, "sep_a", "sep_b")


def _cluster_matching(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    rows = fx.points(spark, sf).withColumn("mass", F.pow(F.lit(10.0), F.col("log_mass"))).withColumn("r500", F.lit(0.03)).drop("log_mass")
    clusters = _references(spark, sf).withColumnRenamed("ref_id", "obs_id")
    sky_map, _ = suite.prepared_map(fx.sky_map(spark, sf), fx.NSIDE)
    return suite.cluster_matching(rows, clusters, _mass_function(spark), sky_map, _wide_pool(spark, sf), (0.0, 0.0, 0.0), 0.08, 5, 0.1, None, 0.6)


def cluster_matching(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_cluster_matching(spark, sf)["matches"], 9, "pval", "dist")


def overall_significance(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier as a cluster: matched to the label of its number where there is one, else 0.5."""
    members = fx.points(spark, sf).select("id", F.col("sim").alias("label"), golden_fraction(F.col("id"), fx.GOLDEN).alias("pval"))
    clusters = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("obs_id"))
    matches = clusters.where("obs_id < 7").select("obs_id", F.col("obs_id").cast("int").alias("label"))
    _, whole = significance.overall_significance(clusters, matches, significance.stouffer(members, "label", "pval"))
    return rounded(whole, 6, "z", "p_combined")


def random_pool(spark: SparkSession, sf: str) -> DataFrame:
    """As many pointings as there are orders."""
    n = table(spark, sf, "orders").count()
    found = suite.random_pool(fx.sky_map(spark, sf), fx.NSIDE, list(oracle.RADII), n, 10.0)
    return rounded(found.groupBy("r_idx", "radius").agg(F.count("*").alias("n"), F.avg("signal").alias("mean")), 6, "mean")


def spherical_frame(spark: SparkSession, sf: str) -> DataFrame:
    r, theta, phi = geometry.cartesian_to_r_theta_phi(F.col("x"), F.col("y"), F.col("z"), oracle.PIVOT)
    return rounded(fx.points(spark, sf).select("id", r.alias("r"), theta.alias("theta"), phi.alias("phi")), 9, "r", "theta", "phi")


def turned_positions(spark: SparkSession, sf: str) -> DataFrame:
    turned = geometry.icrs_to_galactic_cartesian(F.col("x"), F.col("y"), F.col("z"), oracle.PIVOT)
    return rounded(fx.points(spark, sf).select("id", *[v.alias(f"g{c}") for c, v in zip("xyz", turned, strict=True)]), 9, "gx", "gy", "gz")


def cluster_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Cartesian places of suppliers as clusters on the sky with a redshift."""
    rows = fx.suppliers(spark, sf).withColumn("d", cosmology.comoving_distance((F.col("s_acctbal") + 1000) / 1e5))
    x = geometry.spherical_to_cartesian(F.col("d"), F.col("lon"), F.col("lat"))
    return rounded(rows.select("source_id", *[v.alias(c) for c, v in zip("xyz", x, strict=True)]), 6, "x", "y", "z")


def sky_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.on_sky(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), "key")
    dx, dy = geometry.offsets_arcmin(F.col("lon"), F.col("lat"), F.lit(oracle.TOWARDS[0]), F.lit(oracle.TOWARDS[1]))
    return rounded(rows.select("key", dx.alias("dx"), dy.alias("dy")), 6, "dx", "dy")


def centroid_frame(spark: SparkSession, sf: str) -> DataFrame:
    members = fx.points(spark, sf).withColumnRenamed("sim", "label")
    out = assoc.centroid_sky(assoc.association_summary(members, 20), oracle.PIVOT)
    names = ("cx", "cy", "cz", "fraction_present", "centroid_r", "centroid_ell", "centroid_b")
    return rounded(out.select("label", "n_members", *names), 6, *names)


def observed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles and backgrounds of fitted centres, the background from its radius to that and the beam."""
    sky_map, _ = suite.prepared_map(fx.sky_map(spark, sf), fx.NSIDE)
    each, back = profiles.observed_profiles(fx.suppliers(spark, sf), sky_map.pixels, fx.NSIDE, list(oracle.RADII), 480.0, 240.0, "source_id", sky_map.sums)
    return rounded(each.join(back.select("source_id", "background"), "source_id").select("source_id", "r_idx", "signal", "background"), 6, "signal", "background")


def poorly_matched(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matching.poorly_matched(_matrix(spark, sf), 0.9), 9, "p_best")


def mean_images(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of images averaged over realisations, and the scale they are shown at."""
    e = lambda i: F.col("embedding")[i].cast("double")
    cells = table(spark, sf, "embeddings").select(F.col("label").alias("sim"), (F.col("vec_id") % 6).cast("int").alias("iu"), (F.col("vec_id") % 5).cast("int").alias("iv"), F.when(e(0) > 0.2, float("nan")).otherwise(e(1)).alias("value"))
    image = catalogue.mean_over_simulations(cells, ["iu", "iv"])
    return rounded(image.withColumn("scale", F.lit(cutouts.display_scale(image))), 9, "value", "scale")


def association_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Members of associations by name, with optional data that replaces a field of the same name."""
    members = fx.points(spark, sf).select("id", F.col("sim").alias("label"), "log_mass")
    optional = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).cast("double").alias("log_mass"), F.lit("x").alias("tag"))
    entries = assoc.as_maps(assoc.with_optional(members, optional), "id").select("id", F.explode("entries").alias("name", "value"))
    return entries.where("name <> 'log_mass' or id % 2 = 0")


def cluster_overall(spark: SparkSession, sf: str) -> DataFrame:
    """The whole matching flow as one row: cut, clustering, signals, matches, both levels of combination."""
    return rounded(_cluster_matching(spark, sf)["overall"], 6, "z", "p_combined")


#: Queries with a SQL counterpart, and those that SQL can't express (tested against brute force).
CHECKED: tuple[Query, ...] = (
    aperture_mean, annulus_mean, enclosed_profile, halo_cuts, halo_sorted, extent_centre_cut, mass_bins, pool_pvalue, bootstrap_stack,
    random_stack, empirical_sigma_profile, crossmatch_best, radius_cdf, match_halo, pval_matrix, halo_neighbours, particle_projection,
    grid_projection, cutout_stack, wide_profile, greedy_pairs, spherical_frame, turned_positions, cluster_positions, sky_offsets, centroid_frame, observed_profiles, poorly_matched, mean_images, association_maps, sim_suite_halos, sim_suite_bins, sim_suite_profiles, sim_suite_cutouts, overall_significance, mass_matched_y, catalogue_scaling, sim_summary, stouffer, galactic_frame, distances, map_statistics, degraded_map, mass_ratio,
    signal_pvalue, stacked_profile, mass_bin_suite, association_signals, masked_aperture, random_cutout_stack, matched_in_both,
)
UNCHECKED: tuple[Query, ...] = (student_profile, sim_suite_t_fits, greedy_match, halo_associations, find_center, smooth_map, cross_cl, cluster_matching, cluster_overall, random_pool)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in CHECKED + UNCHECKED}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: getattr(oracle, f.__name__) for f in CHECKED}
