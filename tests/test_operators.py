import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import cosmology, geometry, massfunction, stats
from skylattice.functions import healpix as hp
from skylattice.operators import associations as assoc
from skylattice.sources.tables import written
from skylattice.operators import bins, catalogue, cutouts, harmonics, matching, photometry, projection, significance


def test_normal_tails(spark):
    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("z", stats.normal_isf(F.col("p"))).withColumn("q", stats.normal_sf(F.col("z"))).collect()
    for r in rows:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(1 - r["p"]), abs=2e-6)
        assert r["q"] == pytest.approx(1 - NormalDist().cdf(r["z"]), rel=1e-6, abs=1e-13)
    ends = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(stats.normal_isf(F.col("p"))).collect()
    assert [r[0] for r in ends] == [math.inf, -math.inf]


def test_frames_and_cosmology(spark):
    df = spark.createDataFrame([(10.0, 20.0), (266.405, -28.936), (192.859, 27.128)], "a double, d double")
    ell, b = geometry.radec_to_galactic(F.col("a"), F.col("d"))
    rows = df.select("a", "d", ell.alias("l"), b.alias("b"))
    back = geometry.galactic_to_radec(F.col("l"), F.col("b"))
    out = rows.select("a", "d", "l", "b", back[0].alias("a2"), back[1].alias("d2")).collect()
    for r in out:
        assert (r["a2"], r["d2"]) == pytest.approx((r["a"], r["d"]), abs=1e-6)
    assert min(out[1]["l"], 360 - out[1]["l"]) < 0.01 and abs(out[1]["b"]) < 0.01
    assert out[2]["b"] > 89.99
    z = spark.createDataFrame([(0.05,), (0.5,), (float("nan"),)], "z double").withColumn("d", cosmology.comoving_distance(F.col("z")))
    got = z.withColumn("z2", cosmology.redshift_of_distance(F.col("d"))).collect()
    grid = np.linspace(0, 0.5, 200001)
    e = 1 / np.sqrt(0.3111 * (1 + grid) ** 3 + 0.6889)
    assert got[1]["d"] == pytest.approx(2997.92458 * np.trapezoid(e, grid), rel=1e-8)
    assert got[0]["z2"] == pytest.approx(0.05, abs=1e-12) and got[2]["d"] is None
    with pytest.raises(ValueError):
        cosmology.growth(F.lit(0.1), float("nan"))


def test_mass_function_is_plausible():
    m = np.array([12.0, 13.0, 14.0, 15.0])
    n = massfunction.table(m)
    assert (np.diff(n) < 0).all()
    assert 1e-5 < n[2] < 1e-4 and 1e-9 < n[3] < 1e-6
    assert massfunction.table(m, sigma8=0.9)[3] > n[3]


def test_mass_definitions():
    from skylattice.functions import massfunction

    assert massfunction.critical_overdensity("200c") == 200 and massfunction.critical_overdensity("200m", 0.3) == pytest.approx(60)
    for bad in ("200x", "c", "", "-1c"):
        with pytest.raises(ValueError):
            massfunction.critical_overdensity(bad)


def test_mass_bins(spark):
    rng = np.random.default_rng(3)
    mass = 10 ** rng.uniform(13, 15, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(mass)], "key long, mass double")
    edges = bins.mass_bin_edges(df, 0.25, (10, 50))
    lm = np.sort(np.log10(mass))[::-1]
    assert edges[0]["hi"] is None and edges[0]["lo"] == pytest.approx(lm[9]) and edges[1]["lo"] == pytest.approx(lm[59])
    assert edges[-1]["lo"] == pytest.approx(lm[-1]) and [b["label"] for b in edges[:3]] == ["top10", "next50", None]
    counts = {r["bin_idx"]: r["count"] for r in bins.bin_summary(bins.assign_bins(df.withColumn("log_mass", F.log10("mass")), edges), edges).collect()}
    assert counts[0] == 10 and counts[1] == 50 and sum(counts.values()) == 300
    few = bins.mass_bin_edges(df.limit(5), 0.2, (10, 100))
    assert few[0]["label"] == "top5" and few[-1]["lo"] == few[-1]["hi"]
    # A gap in the masses leaves bins empty; they keep their edges, and the last one has its upper edge.
    gap = spark.createDataFrame([(1, 10**13.0), (2, 10**13.1), (3, 10**14.0), (4, 10**14.0)], "key long, mass double")
    edges = bins.mass_bin_edges(gap, 0.25, (0, 1))
    assert edges[0]["label"] == "next1" and edges[0]["hi"] is None
    rows = bins.bin_summary(bins.assign_bins(gap.withColumn("log_mass", F.log10("mass")), edges), edges, gap).orderBy("bin_idx").collect()
    assert [r["bin_idx"] for r in rows] == [b["bin_idx"] for b in edges] and any(r["count"] == 0 and r["median_log_mass"] is None for r in rows)
    assert rows[0]["count"] == 2 and rows[0]["median_log_mass"] == pytest.approx(14.0)
    assert bins.mass_bin_edges(df.limit(0)) == []
    for bad in (0.0, -1.0):
        with pytest.raises(ValueError):
            bins.mass_bin_edges(df, bad)
    with pytest.raises(ValueError):
        bins.mass_bin_edges(spark.createDataFrame([(1, -5.0)], "key long, mass double"))


def test_upper_tail_and_ties(spark):
    pool = spark.createDataFrame([(0, v) for v in (1.0, 2.0, 2.0, 5.0)], "g int, value double")
    sig = spark.createDataFrame([(0, 1, 2.0), (0, 2, 0.0), (0, 3, 9.0), (0, 4, None)], "g int, k long, signal double")
    got = {r["k"]: r["p"] for r in significance.upper_tail(sig, pool, "g", "k").collect()}
    assert got == {1: 0.75, 2: 1.0, 3: 0.0, 4: None}
    zero = {r["k"]: r["p"] for r in significance.upper_tail(sig, pool, "g", "k", nan_as_zero=True).collect()}
    assert zero[4] == 0.0
    rng = np.random.default_rng(4)
    values = [(g, float(v)) for g in range(3) for v in rng.integers(0, 9, 200)] + [(1, 4.0)] * 1000
    asked = [(g, i, float(rng.integers(0, 10))) for g in range(3) for i in range(40)]
    got = significance.upper_tail(spark.createDataFrame(asked, "g int, k long, signal double"), spark.createDataFrame(values, "g int, value double"), "g", "k").collect()
    for r in got:
        own = [v for g, v in values if g == r["g"]]
        assert r["p"] == pytest.approx(sum(v >= r["signal"] for v in own) / len(own))


def test_signal_pvalue_outside_the_pool_and_nulls(spark):
    pool = spark.createDataFrame([(i, r, float(i * r)) for i in range(5) for r in (1.0, 2.0, 4.0)], "row long, radius double, signal double")
    sig = spark.createDataFrame([(1, 3.0, 6.0), (2, 8.0, 16.0), (3, 0.5, 1.1), (4, 2.0, None), (5, 2.0, 99.0)], "key long, theta double, signal double")
    assert {r["key"]: r["p"] for r in significance.signal_pvalue(sig, pool, "key").collect()} == {1: 0.6, 2: 0.6, 3: 0.4, 4: None, 5: 0.0}
    assert {r["key"]: r["p"] for r in significance.signal_pvalue(sig, pool, "key", True).collect()}[4] == 0.0


def test_student_profile_between_fitted_radii(spark):
    rng = np.random.default_rng(2)
    stacks = spark.createDataFrame([(k, float(v)) for k in range(5) for v in rng.normal(k, 1, 300)], "r_idx int, mean double")
    data = spark.createDataFrame([(k, k + 1.0) for k in range(5)], "r_idx int, mean double")
    got = {r["r_idx"]: r for r in significance.student_profile(data, stacks, 2).collect()}
    assert got[0]["p_t"] == pytest.approx(0.16, abs=0.04) and got[0]["sigma_t"] == pytest.approx(1, abs=0.2)
    for c in ("p_t", "sigma_t"):
        assert got[1][c] == pytest.approx((got[0][c] + got[2][c]) / 2) and got[3][c] == pytest.approx((got[2][c] + got[4][c]) / 2)


def test_seeded_draws_repeat_and_fill(spark):
    got = significance.draws(4, 1000, 50, spark).collect()
    assert sorted(got) == sorted(significance.draws(4, 1000, 50, spark).collect())
    counts = np.bincount([r["row"] for r in got], minlength=50)
    assert counts.min() > 40 and counts.max() < 130
    rows = spark.createDataFrame([(i, 0, float(i)) for i in range(400)], "row long, r_idx int, signal double")
    error = significance.bootstrap(rows, 400, 200).first()["error"]
    assert error == pytest.approx(np.std(range(400)) / 20, rel=0.2)


def test_student_tail():
    assert significance._student_sf(2.0, 5.0) == pytest.approx(0.05096974, rel=1e-6)
    assert significance._student_sf(-2.0, 5.0) == pytest.approx(1 - 0.05096974, rel=1e-6)
    x = np.random.default_rng(0).standard_t(4, 4000) * 2 + 1
    nu, mu, sigma = significance._student_fit(x)
    assert 2.8 < nu < 6 and abs(mu - 1) < 0.15 and abs(sigma - 2) < 0.2


def _dbscan(p, eps, least):
    d = np.linalg.norm(p[:, None] - p[None], axis=2) <= eps
    core = d.sum(1) >= least
    label, now = np.full(len(p), -1), 0
    for i in range(len(p)):
        if not core[i] or label[i] >= 0:
            continue
        label[i], stack = now, [i]
        while stack:
            for j in np.flatnonzero(d[stack.pop()]):
                if label[j] < 0:
                    label[j] = now
                    if core[j]:
                        stack.append(j)
        now += 1
    return label


def test_density_clusters(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(c, 0.3, (25, 3)) for c in (0, 2, 4)] + [rng.uniform(-2, 6, (40, 3))])
    p = p[rng.permutation(len(p))]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    got = {r["id"]: r["label"] for r in assoc.density_clusters(df, 0.5, 5).collect()}
    want = _dbscan(p, 0.5, 5)
    assert got == {i: int(v) for i, v in enumerate(want) if v >= 0}


def test_associations_one_member_each(spark):
    rows = [(i, i % 6, 0.1 * (i // 6), 0.0, 0.0, 1e14) for i in range(12)] + [(12, 7, 0.0, 0.05, 0.0, 1e16), (13, 8, None, 0.0, 0.0, 1e14), (14, 9, 50.0, 0.0, 0.0, 1e14)]
    df = spark.createDataFrame(rows, "id long, sim int, x double, y double, z double, mass double")
    out = assoc.associations(df, 1.0, 5, 0.5).toPandas()
    assert sorted(out["sim"]) == list(range(6)) and set(out["label"]) == {0}
    summary = assoc.association_summary(spark.createDataFrame(out), 12).first()
    assert summary["n_members"] == 6 and summary["fraction_present"] == 0.5
    assert assoc.associations(df.limit(0), 1.0, 5).count() == 0
    with pytest.raises(KeyError):
        assoc.member_sky(df, (0, 0, 0), "radius")


def test_greedy_equals_sequential(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.uniform(0, 0.2, (7, 5)), 2)
    df = spark.createDataFrame([(i, j, float(p[i, j]), 1.0) for i in range(7) for j in range(5)], "obs_id long, label long, pval double, dist double")
    left, want = p.copy(), {}
    while True:
        i, j = np.unravel_index(int(np.argmin(left)), left.shape)
        if not left[i, j] <= 0.1:
            break
        want[int(i)] = int(j)
        left[i], left[:, j] = np.inf, np.inf
    got = {r["obs_id"]: r["label"] for r in matching.greedy_match(df, 0.1).collect()}
    assert got == want
    assert len({r["label"] for r in matching.greedy_match(df, None).collect()}) == 5
    nan = df.unionByName(spark.createDataFrame([(9, 9, float("nan"), 1.0)], df.schema))
    assert matching.greedy_match(nan, 0.1).count() == 0


def test_crossmatch_edges(spark):
    o = spark.createDataFrame([(1, 10.0, 0.0, 0.1), (2, 50.0, 80.0, 0.2), (3, 0.01, 0.0, None)], "obs_id long, lon double, lat double, z double")
    c = spark.createDataFrame([(5, 10.0, 0.04, 0.1), (4, 10.0, -0.04, 0.1), (6, 359.99, 0.0, 0.3)], "cat_id long, lon double, lat double, z double")
    strict = {r["obs_id"]: r["cat_id"] for r in matching.crossmatch(o, c, 3.0).collect()}
    assert strict == {1: 4, 2: None, 3: None}
    free = {r["obs_id"]: r["cat_id"] for r in matching.crossmatch(o, c, 3.0, None).collect()}
    assert free == {1: 4, 2: None, 3: 6}


def test_match_probability_inverse(spark):
    df = spark.createDataFrame([(1.0, 0.01), (5.0, 1e-4)], "r double, n double")
    out = df.withColumn("c", matching.match_cdf(F.col("r"), F.col("n"))).withColumn("r2", matching.match_inverse_cdf(F.col("c"), F.col("n"))).collect()
    for r in out:
        assert r["r2"] == pytest.approx(r["r"], rel=1e-9)
    grid = np.linspace(12, 16, 81)
    table = spark.createDataFrame([(float(m), float(10 ** (-0.9 * (m - 12)))) for m in grid], "log_mass double, nd double")
    got = matching.density_of(spark.createDataFrame([(12.01,), (13.033,), (15.98,), (16.0,)], "log_mass double"), table).collect()
    for r in got:
        assert r["n"] == pytest.approx(10 ** (-0.9 * (r["log_mass"] - 12)), rel=1e-5)
    with pytest.raises(Exception, match="outside"):
        matching.density_of(spark.createDataFrame([(20.0,)], "log_mass double"), table).collect()


def test_find_center_recovers_a_peak(spark):
    nside = 64
    pixels = hp.with_centre(spark.range(hp.npix(nside)).withColumnRenamed("id", "pix"), nside).toPandas()
    lon, lat = np.rad2deg(pixels["pphi"]), np.rad2deg(np.arcsin(pixels["pz"]))
    value = np.exp(-((lon - 100.8) ** 2 * np.cos(np.deg2rad(lat)) ** 2 + (lat - 20.9) ** 2) / (2 * 0.8**2))
    sky = spark.createDataFrame(list(zip(pixels["pix"].tolist(), value.tolist(), strict=True)), "pix long, value double")
    src = spark.createDataFrame([(1, 100.0, 20.0), (2, 250.0, -40.0)], "source_id long, lon double, lat double")
    out = {r["source_id"]: r for r in cutouts.find_centers(src, sky.withColumn("value", F.when(F.col("value") > 1e-9, F.col("value")).otherwise(-1.0)), nside, 240.0, 31, 30.0).collect()}
    assert out[1]["converged"] and abs(out[1]["lon"] - 100.8) < 0.7 and abs(out[1]["lat"] - 20.9) < 0.7
    assert not out[2]["converged"]


def test_find_center_step_by_step(spark):
    """Against the same steps taken one by one, with a cutout of its own for each."""
    nside, size, npix, final = 32, 600.0, 21, 120.0
    pixels = spark.range(hp.npix(nside)).withColumnRenamed("id", "pix").withColumn("value", F.sin(F.col("pix") * 0.37) + F.cos(F.col("pix") * 0.011))
    sky = written(pixels, "sky")
    src = [(1, 100.0, 55.0), (2, 359.5, -20.0)]
    out = {r["source_id"]: r for r in cutouts.find_centers(spark.createDataFrame(src, "source_id long, lon double, lat double"), sky, nside, size, npix, final, shrink=0.7).collect()}
    for i, lon, lat in src:
        radius, steps = size / np.sqrt(2), 0
        while True:
            one = spark.createDataFrame([(i, float(lon), float(lat))], "source_id long, lon double, lat double")
            cut = cutouts.cutout(one, sky, nside, F.lit(size), npix).toPandas()
            near = cut[np.hypot(cut["x"], cut["y"]) <= (final if radius < final else radius)]
            if radius < final:
                best = near.sort_values(["value", "iy", "ix"], ascending=[False, True, True]).iloc[0]
                dx, dy = best["x"], best["y"]
            else:
                w = np.maximum(near["value"], 0)
                dx, dy = (near["x"] * w).sum() / w.sum(), (near["y"] * w).sum() / w.sum()
            lon, lat = lon + dx / 60 / np.cos(np.deg2rad(lat)), lat + dy / 60
            if radius < final:
                break
            radius, steps = radius * 0.7, steps + 1
        assert out[i]["converged"] and out[i]["n_iterations"] == steps
        assert (out[i]["lon"], out[i]["lat"]) == pytest.approx((lon, lat), abs=1e-9)


def test_plans_compute_once(spark):
    """No expression is copied into filters: the plans stay short enough to be compiled."""
    from skylattice.plans import fixtures as fx
    from skylattice.plans import queries

    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(queries.halo_cuts(spark, sf)).upper().count("CBRT") <= 6
    assert len(plan(cutouts.cutout(fx.suppliers(spark, sf), fx.sky_map(spark, sf), fx.NSIDE, F.lit(1200.0), 11))) < 40_000


def test_masks(spark):
    from skylattice.operators import spatial

    sky = spark.createDataFrame([(p, float(p)) for p in range(12)] , "pix long, value double")
    mask = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, -1.6375e30), (3, float("nan")), (4, None), (5, 0.5)], "pix long, weight double")
    assert sorted(r["pix"] for r in spatial.bound_map(sky, 1, mask, 1).pixels.collect()) == [0, 5]
    with pytest.raises(ValueError):
        spatial.bound_map(sky, 1, mask, 2)


def test_matched_in_both(spark):
    a = spark.createDataFrame([(1, 5, 0.1), (2, None, None), (3, 6, 0.2)], "obs_id long, cat_id long, sep double")
    b = spark.createDataFrame([(1, 7, 0.3), (3, None, None)], "obs_id long, cat_id long, sep double")
    assert [tuple(r) for r in matching.matched_in_both(a, b).collect()] == [(1, 5, 0.1, 7, 0.3)]


def test_normalised_last_edge(spark):
    cut = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (1, -1.0, 0.0, 4.0), (1, 1.1, 0.0, 9.0), (1, 0.5, 0.5, None)], "source_id long, x double, y double, value double")
    got = {(r["iu"], r["iv"]): r["value"] for r in cutouts.normalised(cut, F.lit(1.0), 4, 1.0).collect()}
    assert got == {(3, 3): 2.0, (0, 2): 4.0}


def test_harmonics_against_direct_sums(spark):
    nside, lmax = 4, 6
    rng = np.random.default_rng(4)
    alm = {(ell, m): complex(rng.normal(), rng.normal() if m else 0) for ell in range(lmax + 1) for m in range(ell + 1)}
    coeff = spark.createDataFrame([(ell, m, c.real, c.imag) for (ell, m), c in alm.items()], "l long, m long, re double, im double")
    sky = harmonics.synthesis(coeff, nside, lmax)
    pixels = hp.with_centre(sky, nside).orderBy("pix").toPandas()
    want = np.zeros(len(pixels))
    for m in range(lmax + 1):
        p = harmonics.legendre(m, lmax, pixels["pz"].to_numpy())
        for ell in range(m, lmax + 1):
            want += (1 if m == 0 else 2) * (alm[ell, m] * np.exp(1j * m * pixels["pphi"].to_numpy())).real * p[ell - m]
    np.testing.assert_allclose(pixels["value"], want, atol=1e-10)
    np.testing.assert_allclose(harmonics.legendre(1, 1, np.array([0.3]))[0], -np.sqrt(3 / (8 * np.pi)) * np.sqrt(1 - 0.09))
    back = {(r["l"], r["m"]): complex(r["re"], r["im"]) for r in harmonics.coefficients(sky, nside, lmax).collect()}
    assert max(abs(back[k] - alm[k]) for k in alm) < 0.5
    flat = spark.range(hp.npix(nside)).select(F.col("id").alias("pix"), F.lit(3.0).alias("value"))
    smooth = harmonics.smoothed(flat, nside, 1200.0).agg(F.min("value"), F.max("value")).first()
    assert smooth[0] == pytest.approx(3.0, abs=0.15) and smooth[1] == pytest.approx(3.0, abs=0.15)
    spec = harmonics.cross_spectrum(sky, sky, nside, lmax).toPandas().set_index("l")
    np.testing.assert_allclose(spec["c11"], spec["c22"])
    direct = [sum((1 if m == 0 else 2) * abs(alm[ell, m]) ** 2 for m in range(ell + 1)) / (2 * ell + 1) for ell in range(lmax + 1)]
    np.testing.assert_allclose(spec.loc[range(lmax + 1), "cl"], direct, rtol=0.05)


def test_simpson_and_uniform_grid(spark):
    for n in (3, 5, 6, 9, 10):
        x = np.linspace(0, 1, n)
        assert (np.array(projection.simpson_weights(n)) @ (x**2)) * (x[1] - x[0]) == pytest.approx(1 / 3)
    grid = spark.range(216).select((F.col("id") % 6).cast("int").alias("ix"), (F.floor(F.col("id") / 6) % 6).cast("int").alias("iy"), F.floor(F.col("id") / 36).cast("int").alias("iz"), F.lit(7.0).alias("rho"))
    out = projection.grid_projection(grid, (6, 6, 6), 1, 6.0, (3.0, 3.0, 3.0), 2.0, 0.5).toPandas()
    np.testing.assert_allclose(out["value"], 7.0)
    with pytest.raises(Exception, match="leaves"):
        projection.grid_projection(grid, (6, 6, 6), 1, 6.0, (3.0, 3.0, 3.0), 4.0, 0.5).collect()
    around = projection.grid_projection(grid, (6, 6, 6), 1, 6.0, (3.0, 3.0, 3.0), 4.0, 0.5, periodic=True).toPandas()
    np.testing.assert_allclose(around["value"], 7.0)


def test_particle_counts_keep_all(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([tuple(map(float, v)) for v in rng.normal(size=(200, 3))] + [(0.0, 0.0, 0.0)], "x double, y double, z double")
    out = projection.particle_counts(df, 2, (0.0, 0.0, 0.0), r_max=2.0)
    want = df.where("sqrt(x*x+y*y+z*z) <= 2").count()
    assert out.count() == 48 and out.agg(F.sum("n")).first()[0] == want


def test_catalogue(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 5.0), (4, None)], "key long, mass double")
    assert [(r["key"], r["mass_rank"]) for r in catalogue.by_mass(df, "key").orderBy("mass_rank").collect()] == [(2, 1), (1, 2), (3, 3), (4, 4)]
    with pytest.raises(KeyError, match="there are"):
        catalogue.renamed(df, {"m": "weight"})
    snap = spark.createDataFrame([("PartType0", 1.0, 2.0, 3.0), ("PartType1", 4.0, 5.0, 6.0), ("Header", 0.0, 0.0, 0.0)], "part_type string, x double, y double, z double")
    assert catalogue.particles(snap, ["PartType1", "PartType9"], flip_xz=True).first()["x"] == 6.0
    with pytest.raises(KeyError):
        catalogue.particles(snap, ["PartType9"])
    assert catalogue.fof_units(snap.withColumn("mass", F.lit(2.0)), True).first()["z"] == 1.0
    halos = spark.createDataFrame([("10", 1), ("9", 2)], "sim string, halo_idx long")
    assert [r["sim"] for r in catalogue.simulations(halos).collect()] == [9, 10]
    with pytest.raises(KeyError):
        catalogue.simulation(halos, "3")


def test_photometry_helpers(spark):
    df = spark.createDataFrame([("a", 1e14), ("a", 3e14), ("a", -1.0)], "g string, mass double")
    out = photometry.mass_statistics(df, "g").first()
    assert out["n"] == 2 and out["mean_mass"] == 2e14 and out["std_mass"] == 1e14
    assert cutouts.display_scale(spark.createDataFrame([(0.0,)], "value double")) == 1.0
