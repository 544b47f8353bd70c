"""Ring sums, ranks by strips, resampling by weights, grouped bins and files in ranges, against plain rules."""

import math
from math import erfc, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import healpix as hp
from skylattice.operators import bins, cutouts, matching, profiles, significance, spatial
from skylattice.plans import suite
from skylattice.sources import fits

SOURCES = [(0, 0.0, 90.0, 20.0), (1, 10.0, -90.0, 35.0), (2, 359.9, 3.0, 12.0), (3, 0.0, 85.0, 25.0), (4, 200.0, -40.0, 0.5), (5, 120.0, 20.0, 180.0), (6, 45.0, 66.4, 9.0), (7, 0.2, 0.0, 100.0)]


def masked_map(spark, nside):
    rng = np.random.default_rng(1)
    values = rng.normal(size=hp.npix(nside))
    rows = [(i, float(v)) if i % 7 else (i, None if i % 2 else float("nan")) for i, v in enumerate(values) if i % 13]
    good = np.array([i % 7 != 0 and i % 13 != 0 for i in range(hp.npix(nside))])
    return spark.createDataFrame(rows, "pix long, value double"), values, good


def inside(spark, nside, lon, lat, degrees):
    at = hp.with_centre(spark.range(hp.npix(nside)).withColumnRenamed("id", "pix"), nside).orderBy("pix").toPandas()
    z, phi, t = at["pz"].to_numpy(), at["pphi"].to_numpy(), np.deg2rad(lat)
    cos = z * np.sin(t) + np.sqrt(1 - z * z) * np.cos(t) * np.cos(phi - np.deg2rad(lon))
    return cos >= np.cos(np.deg2rad(degrees))


def test_aperture_and_annulus_from_ring_sums(spark):
    nside = 8
    sky, values, good = masked_map(spark, nside)
    df = spark.createDataFrame(SOURCES + [(8, None, 1.0, 5.0)], "source_id long, lon double, lat double, radius double")
    disc = {r["source_id"]: r for r in profiles.aperture_mean(df, sky, nside, 60 * F.col("radius")).collect()}
    ring = {r["source_id"]: r for r in profiles.annulus_mean(df, sky, nside, 30 * F.col("radius"), 60 * F.col("radius")).collect()}
    for key, lon, lat, radius in SOURCES:
        outer, inner = (good & inside(spark, nside, lon, lat, r) for r in (radius, radius / 2))
        for found, want, name in ((disc[key], outer, "signal"), (ring[key], outer & ~inner, "background")):
            assert found["n_pix"] == want.sum(), (key, name)
            assert (found[name] is None) if not want.any() else found[name] == pytest.approx(values[want].mean(), abs=1e-9)
    assert disc[8]["n_pix"] == 0 and disc[8]["signal"] is None
    assert all(r["n_pix"] == 0 for r in profiles.annulus_mean(df, sky, nside, F.lit(60.0), F.lit(30.0)).collect())


def test_profiles_by_rings_and_by_pixels_agree(spark, monkeypatch):
    nside = 8
    sky, _, _ = masked_map(spark, nside)
    df = spark.createDataFrame([s[:3] for s in SOURCES], "source_id long, lon double, lat double").withColumn("size", F.lit(100.0) + 40 * F.col("source_id"))
    found = []
    for answer in (True, False):
        monkeypatch.setattr(profiles, "fewer_by_rings", lambda *_, answer=answer: answer)
        found.append(profiles.enclosed_profile(df, sky, nside, [400.0, 900.0, 950.0, 1500.0, 1501.0]).orderBy("source_id", "r_idx").collect())
        monkeypatch.setattr(profiles, "fewer_by_rings", lambda *_, answer=answer: F.lit(answer))
        found.append(profiles.enclosed_profile(df, sky, nside, [1.0, 4.0, 9.0], scale=F.col("size")).orderBy("source_id", "r_idx").collect())
    for a, b in ((found[0], found[2]), (found[1], found[3])):
        assert [(r["source_id"], r["r_idx"], r["n_pix"]) for r in a] == [(r["source_id"], r["r_idx"], r["n_pix"]) for r in b]
        assert [r["signal"] or 0.0 for r in a] == pytest.approx([r["signal"] or 0.0 for r in b], abs=1e-9)


def test_lookups_follow_rings_not_pixels(spark):
    nside = 128
    df = spark.createDataFrame([(1, 30.0, 10.0)], "source_id long, lon double, lat double")
    n = spatial.shell_lookups(df, nside, F.array(F.lit(math.radians(10.0))), "source_id").count()
    rings = 8 * nside * math.radians(10.0) / math.pi
    pixels = spatial.disc_pixels(df, nside, F.lit(math.radians(10.0))).count()
    assert n <= 2.4 * rings + 10 and pixels > 10 * n
    assert spatial.fewer_by_rings(nside, math.radians(10.0), math.radians(10.0)) and not spatial.fewer_by_rings(16, 5 * math.radians(2.0), math.radians(2.0))


def test_count_above_equals_all_comparisons(monkeypatch):
    monkeypatch.setattr(significance, "STRIP_SOURCES", 16)
    rng = np.random.default_rng(2)
    n, q = 700, 400
    x0, x1 = np.zeros(n), np.ones(n)
    y0 = np.round(rng.normal(size=n), 2)
    y1 = y0 + np.where(rng.random(n) < 0.05, 50, 0.1) * rng.normal(size=n)
    theta = np.where(rng.random(q) < 0.3, 0.5, rng.uniform(-1, 3, q))
    value = np.round(rng.normal(size=q), 2)
    value[:40] = y0[:40]
    theta[:40] = 0.0
    value[40:60] = [1e9, -1e9] * 10
    got = significance.count_above(x0, y0, x1, y1, theta, value)
    want = ((y0 + (theta[:, None] - x0) * (y1 - y0) / (x1 - x0)) >= value[:, None]).sum(axis=1)
    assert (got == want).all()


def test_signals_all_in_one_segment(spark, monkeypatch):
    monkeypatch.setattr(significance, "POOL_ROWS", 40)
    rng = np.random.default_rng(3)
    pool = [(i, float(r), float(v)) for i in range(90) for r, v in zip(range(6), np.cumsum(rng.normal(size=6)))] + [(90, 0.0, None), (90, 1.0, 1.0)]
    asked = [(k, float(t), float(v)) for k, (t, v) in enumerate(zip(2 + rng.random(3000) / 10, rng.normal(size=3000)))] + [(9000, None, 1.0), (9001, 2.0, None), (9002, 17.0, 0.5), (9003, -3.0, 0.5)]
    pool_df, asked_df = spark.createDataFrame(pool, "row long, radius double, signal double"), spark.createDataFrame(asked, "key long, theta double, signal double")
    got = {r["key"]: r["p"] for r in significance.signal_pvalue(asked_df, pool_df, "key").collect()}
    lines = np.array([[v for _, _, v in pool[6 * i : 6 * i + 6]] for i in range(90)])
    for k, t, v in asked:
        if t is None or v is None:
            assert got[k] is None
            continue
        j = min(max(int(math.floor(t)), 0), 4)
        y = lines[:, j] + (t - j) * (lines[:, j + 1] - lines[:, j])
        assert got[k] == pytest.approx((y >= v).mean(), abs=1e-12), k


@pytest.mark.parametrize("n", [1, 2, 7, 12, 2500])
def test_draws_by_rule_equal_listed_draws(n):
    reps = np.arange(20)
    counts = np.concatenate([significance.draw_counts(reps, n, n, b, None, 0) for b in range(-(-n // significance.DRAWN_ROWS))], axis=1)
    for r in reps.tolist():
        rows = [(d * 7919 + r * 104729 + d * r + 17) % n for d in range(n)]
        assert counts[r].tolist() == np.bincount(rows, minlength=n).tolist()
    some = significance.draw_counts(reps, n, 5, 0, None, 0)
    assert some.sum() <= 5 * len(reps)


def test_seeded_counts_are_multinomial():
    reps = np.arange(400)
    blocks = [significance.draw_counts(reps, 2500, 2500, b, 42, 7) for b in range(3)]
    counts = np.concatenate(blocks, axis=1)
    assert (counts.sum(axis=1) == 2500).all() and abs(counts.var() - (1 - 1 / 2500)) < 0.01
    assert (blocks[1] == significance.draw_counts(reps, 2500, 2500, 1, 42, 7)).all()
    assert (blocks[1] != significance.draw_counts(reps, 2500, 2500, 1, 43, 7)).any()


def test_bootstrap_error_of_a_mean(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 2, 3000)
    rows = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(x)] + [(i, 1, None if i % 2 else float(v)) for i, v in enumerate(x)], "row long, r_idx int, signal double")
    got = {r["r_idx"]: r for r in significance.bootstrap(rows, 3000, 10_000).collect()}
    assert got[0]["mean"] == pytest.approx(x.mean()) and got[0]["error"] == pytest.approx(x.std() / sqrt(3000), rel=0.02)
    assert got[1]["error"] == pytest.approx(x[::2].std() / sqrt(1500), rel=0.03)


def test_scaled_stacks_equal_step_by_step(spark, monkeypatch):
    monkeypatch.setattr(significance, "STACK_ROWS", 4)
    monkeypatch.setattr(significance, "TURNED_REPS", 3)
    rng = np.random.default_rng(5)
    radii, n_pool = [1.0, 2.0, 4.0, 8.0], 11
    pool = rng.normal(size=(n_pool, 4))
    rows = spark.createDataFrame([(10 * i, r, float(v)) for i in range(n_pool) for r, v in zip(radii, pool[i])], "row long, radius double, signal double")
    sizes = {"a": [0.7, 1.5, 3.0, 20.0], "b": [2.0, 5.0]}
    src = spark.createDataFrame([(g, i, len(t), x, 7 if g == "a" else 4) for g, t in sizes.items() for i, x in enumerate(t)], "g string, number long, size long, theta double, reps int")
    norms = [0.5, 1.0, 3.0]
    got = {(r["g"], r["r_idx"]): r["means"] for r in significance.scaled_stacks(src, rows, norms, F.col("reps"), None, "g").collect()}
    for g, t in sizes.items():
        n_reps = 7 if g == "a" else 4
        for j, norm in enumerate(norms):
            want = []
            for rep in range(n_reps):
                each = []
                for k in range(len(t)):
                    row, member = (k * 7919 + rep * 104729 + k * rep + 17) % n_pool, (k * 6271 + rep * 92821 + k * rep + 29) % len(t)
                    each.append(np.interp(t[member] * norm, radii, pool[row]))
                want.append(np.mean(each))
            assert got[g, j] == pytest.approx(want)


def test_grouped_edges_are_those_of_each_group(spark):
    rng = np.random.default_rng(6)
    sizes = {"x": 300, "y": 60, "z": 7}
    rows = [(g, i, float(10 ** rng.uniform(13, 15))) for g, n in sizes.items() for i in range(n)] + [("y", 100, 1e14), ("y", 101, 1e14)]
    masses = spark.createDataFrame(rows, "sim string, key long, mass double")
    edges = bins.grouped_edges(masses, "sim", 0.2, (10, 50, 100))
    for g in sizes:
        own = masses.where(F.col("sim") == g)
        want = bins.mass_bin_edges(own, 0.2, (10, 50, 100))
        got = edges.where(F.col("sim") == g).orderBy("bin_idx").collect()
        assert [(r["bin_idx"], r["lo"], r["hi"], r["label"]) for r in got] == [(b["bin_idx"], b["lo"], b["hi"], b["label"]) for b in want]
        binned = bins.assign_bins(own.withColumn("log_mass", F.log10("mass")), want)
        one = {r["bin_idx"]: (r["count"], r["median_log_mass"]) for r in bins.bin_summary(binned, want, own).collect()}
        many = bins.grouped_summary(bins.assign_grouped(own.withColumn("log_mass", F.log10("mass")), edges, "sim"), edges, own, "sim", (10, 50, 100)).where(F.col("sim") == g).collect()
        assert {r["bin_idx"]: (r["count"], r["median_log_mass"]) for r in many} == one
    assert bins.grouped_edges(masses.limit(0), "sim").count() == 0
    with pytest.raises(Exception, match="positive"):
        bins.grouped_edges(spark.createDataFrame([("x", 1, -1.0)], "sim string, key long, mass double"), "sim").collect()
    with pytest.raises(ValueError):
        bins.grouped_edges(masses, "sim", 0.0)


def test_overall_significance_of_unmatched_clusters(spark):
    clusters = spark.createDataFrame([(1,), (2,), (3,)], "obs_id long")
    none = spark.createDataFrame([], "obs_id long, label int")
    combined = spark.createDataFrame([(5, 0.01), (6, None)], "label int, p_combined double")
    each, whole = significance.overall_significance(clusters, none, combined)
    assert [r["p"] for r in each.collect()] == [0.5] * 3 and whole.first()["p_combined"] == pytest.approx(0.5, abs=1e-7)
    pairs = spark.createDataFrame([(1, 5), (2, 6)], "obs_id long, label int")
    each, whole = significance.overall_significance(clusters, pairs, combined)
    assert {r["obs_id"]: r["p"] for r in each.collect()} == {1: 0.01, 2: 0.5, 3: 0.5}
    z = 2.3263478740 / sqrt(3)
    row = whole.first()
    assert (row["n"], row["n_matched"]) == (3, 2) and row["z"] == pytest.approx(z, abs=1e-6) and row["p_combined"] == pytest.approx(erfc(z / sqrt(2)) / 2, abs=1e-6)


def test_a_long_chain_of_pairs_is_few_rounds(spark, monkeypatch):
    from skylattice.operators import matching

    tables = []
    monkeypatch.setattr(matching, "written", lambda df, name, keep=matching.written: tables.append(name) or keep(df, name))
    n = 2500
    rows = [(i, i, (2 * i) / (2 * n), 0.0) for i in range(n)] + [(i + 1, i, (2 * i + 1) / (2 * n), 0.0) for i in range(n)]
    got = matching.greedy_match(spark.createDataFrame(rows, "obs_id long, label long, pval double, dist double"), None).select("obs_id", "label").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(n)]
    assert tables.count("taken") == 1 and tables.count("chains") <= 15


def test_random_cutouts_of_groups_and_their_seeds(spark):
    from skylattice.operators import cutouts

    sky, _, _ = masked_map(spark, 8)
    rows = spark.createDataFrame([("a", 100.0), ("a", 200.0), ("b", 150.0), ("b", -1.0)], "g string, theta double")
    seeds = spark.createDataFrame([("a", 42), ("b", 43)], "g string, seed int")
    first, again = (cutouts.grouped_random_stack(rows, "g", sky, 8, 30, 4, 2.0, 9, 4.0, 10.0, seeds).orderBy("g", "iu", "iv").collect() for _ in range(2))
    assert first == again and len(first) == 32 and max(r["n_sources"] for r in first) <= 30
    assert suite.cutout_seed(42, 3, 2) == 47


def fits_file(path, values):
    card = lambda *lines: "".join(x.ljust(80) for x in [*lines, "END"]).ljust(2880).encode()
    with open(path, "wb") as f:
        f.write(card("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"))
        f.write(card("XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", f"NAXIS1  = {12:>20}", f"NAXIS2  = {len(values):>20}", "TFIELDS =                    2", "TTYPE1  = 'A'", "TFORM1  = 'D'", "TTYPE2  = 'B'", "TFORM2  = 'J'"))
        f.write(np.array([(v, i) for i, v in enumerate(values)], [("A", ">f8"), ("B", ">i4")]).tobytes())


def test_fits_is_read_in_ranges_of_rows(spark, tmp_path):
    values = np.random.default_rng(7).normal(size=10_000)
    for name in ("one.fits", "two.fits"):
        fits_file(tmp_path / name, values)
    rows = fits.read_fits(spark, str(tmp_path / "one.fits"), columns=["B"], task_bytes=12 * 700)
    assert rows.rdd.getNumPartitions() == 15 and rows.columns == ["row", "B"]
    assert rows.where("row <> B").count() == 0 and rows.count() == 10_000
    both = fits.read_fits(spark, str(tmp_path), columns=["A"], task_bytes=12 * 3000)
    assert both.count() == 20_000 and both.agg(F.sum("A")).first()[0] == pytest.approx(2 * values.sum())
    with pytest.raises(FileNotFoundError):
        fits.read_fits(spark, str(tmp_path / "none.fits"))


def test_a_large_fits_file_is_many_tasks(tmp_path):
    path = tmp_path / "large.fits"
    fits_file(path, np.zeros(1))
    n = 3 * 10**9 // 12
    with open(path, "r+b") as f:  # a sparse file of 3 GB
        head = f.read(5760).replace(f"NAXIS2  = {1:>20}".encode(), f"NAXIS2  = {n:>20}".encode())
        f.seek(0)
        f.write(head)
        f.seek(5760 + 12 * (n - 1))
        f.write(np.array([(2.5, 7)], [("A", ">f8"), ("B", ">i4")]).tobytes())
    reader = fits.FitsReader({"path": str(path)})
    parts = reader.partitions()
    assert len(parts) > 80 and sum(p.count for p in parts) == n
    last = list(reader.read(fits.Rows(0, n - 3, 3)))
    assert last[0].column("A").to_pylist() == [0.0, 0.0, 2.5] and last[0].column("row").to_pylist()[-1] == n - 1


def test_legendre_blocks_of_high_order():
    """A start far below the least double, against the recursion in long decimals."""
    from decimal import Decimal, getcontext

    from skylattice.operators import harmonics

    getcontext().prec = 40
    m, lmax, z = 2500, 5000, 0.8
    zd, s2 = Decimal(z), 1 - Decimal(z) * Decimal(z)
    seed = (1 / (4 * Decimal(math.pi))).sqrt()
    for k in range(1, m + 1):
        seed *= (Decimal(2 * k + 1) / Decimal(2 * k) * s2).sqrt()
    before, now = Decimal(0), seed
    want = {m: float(now)}
    for ell in range(m + 1, lmax + 1):
        a = (Decimal(4 * ell * ell - 1) / Decimal(ell * ell - m * m)).sqrt()
        b = (Decimal((ell - 1) ** 2 - m * m) / Decimal(4 * (ell - 1) ** 2 - 1)).sqrt()
        before, now = now, a * (zd * now - b * before)
        want[ell] = float(now)
    got = np.concatenate([rows[:, 0] for _, rows in harmonics.legendre_blocks(m, lmax, np.array([z]))])
    assert seed < Decimal("1e-320") and max(abs(v) for v in want.values()) > 0.1
    assert got == pytest.approx(np.array([want[ell] for ell in range(m, lmax + 1)]), abs=1e-9)


def test_legendre_blocks_stay_small():
    import tracemalloc

    from skylattice.operators import harmonics

    nside = 512
    tracemalloc.start()
    for _, rows in harmonics.legendre_blocks(200, 3 * nside - 1, harmonics._north(nside)):
        assert rows.shape[0] <= harmonics.DEGREES
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_centres_are_one_join_and_follow_sources_that_wander(spark):
    from skylattice.operators import cutouts

    nside = 16
    at = hp.with_centre(spark.range(hp.npix(nside)).withColumnRenamed("id", "pix"), nside)
    # A slope that draws every centre far away from its start.
    sky = at.select("pix", (10 + 9 * F.cos("pphi") * F.sqrt(1 - F.col("pz") * F.col("pz"))).alias("value"))
    df = spark.createDataFrame([(1, 120.0, 10.0), (2, 5.0, -5.0), (3, None, 1.0)], "source_id long, lon double, lat double")
    joins = []
    original = cutouts.aperture_join
    cutouts.aperture_join = lambda *a, **k: joins.append(1) or original(*a, **k)
    try:
        got = {r["source_id"]: r for r in cutouts.find_centers(df, sky, nside, 2400.0, 21, 400.0, shrink=0.97).collect()}
    finally:
        cutouts.aperture_join = original
    assert len(joins) >= 2 and got[1]["converged"] and abs(got[1]["lon"]) < 100 and (got[3]["converged"], got[3]["n_iterations"]) == (False, 1)
    joins.clear()
    cutouts.aperture_join = lambda *a, **k: joins.append(1) or original(*a, **k)
    try:
        cutouts.find_centers(df.where("source_id = 2"), sky, nside, 1800.0, 15, 600.0).collect()
    finally:
        cutouts.aperture_join = original
    assert len(joins) == 1


def test_pixels_of_arrays_are_those_of_columns(spark):
    rng = np.random.default_rng(9)
    z, phi = np.concatenate([rng.uniform(-1, 1, 3000), [1.0, -1.0, 2 / 3, -2 / 3, 0.0]]), np.concatenate([rng.uniform(-7, 7, 3000), [0.0, 1.0, 2.0, 3.0, 0.0]])
    for nside in (1, 4, 64):
        rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(z, phi))], "i long, z double, phi double").select("i", hp.z_phi_to_pix(nside, F.col("z"), F.col("phi")).alias("pix")).orderBy("i").collect()
        assert [r["pix"] for r in rows] == hp.pixels_of(nside, z, phi).tolist()


def brute_clusters(points, eps, min_samples):
    """Labels by plain breadth-first search; a border point goes to the cluster whose first core point is least."""
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)) <= eps
    core = d.sum(axis=1) >= min_samples
    root = np.full(len(points), -1)
    for i in range(len(points)):
        if core[i] and root[i] < 0:
            todo = [i]
            root[i] = i
            while todo:
                for j in np.flatnonzero(d[todo.pop()] & core & (root < 0)).tolist():
                    root[j] = i
                    todo.append(j)
    for i in np.flatnonzero(~core).tolist():
        near = root[np.flatnonzero(d[i] & core)]
        root[i] = near.min() if len(near) else -1
    names = {r: k for k, r in enumerate(sorted({r for r in root.tolist() if r >= 0}))}
    return {i: names[r] for i, r in enumerate(root.tolist()) if r >= 0}


@pytest.mark.parametrize("seed,eps,least", [(0, 0.3, 4), (1, 0.12, 3), (2, 0.8, 9)])
def test_clusters_by_cells_equal_brute_force(spark, seed, eps, least):
    from skylattice.operators import associations

    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(size=(120, 3)) * 0.4, rng.normal(size=(60, 3)) * 0.05 + 1, rng.normal(size=(60, 3)) * 0.05 + [1.2, 1, 1], rng.uniform(-2, 2, (60, 3))])
    points = rng.permutation(points)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")
    got = {r["id"]: r["label"] for r in associations.density_clusters(rows, eps, least).collect()}
    assert got == brute_clusters(points, eps, least)


def test_a_cell_of_many_points_is_core_without_pairs(spark):
    from skylattice.operators import associations

    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    dense = spark.range(100_000).select("id", (h * 0.1).alias("x"), (F.pmod(F.col("id"), F.lit(97)) / 970.0).alias("y"), F.lit(0.05).alias("z"))
    others = spark.createDataFrame([(200_000, 0.9, 0.05, 0.05), (200_001, 3.0, 3.0, 3.0)], "id long, x double, y double, z double")
    got = associations.density_clusters(dense.unionByName(others), 1.0, 9)
    assert got.count() == 100_001 and got.select("label").distinct().count() == 1 and got.where("id = 200001").count() == 0


def test_nearest_matches_by_rising_separation_equal_brute_force(spark, monkeypatch):
    """Most sources lie far from a crowded catalogue: they meet few of its rows, whatever the limit."""
    rng = np.random.default_rng(5)
    o = [(i, float(rng.uniform(0, 360)), float(rng.uniform(50, 90) if i % 3 else rng.uniform(-90, 90)), float(rng.uniform(0, 0.02)) if i % 7 else None) for i in range(150)]
    c = [(i, float(rng.uniform(0, 360)), float(90 - rng.exponential(4.0)), float(rng.uniform(0, 0.02))) for i in range(200)]
    c += [(1000 + i, lon, lat, z) for i, (_, lon, lat, z) in enumerate(c[:20])] + [(None, o[1][1], o[1][2], 0.01)]
    left = spark.createDataFrame(o + [(None, 1.0, 89.0, 0.01), (900, None, 5.0, 0.01)], "obs_id long, lon double, lat double, z double")
    right = spark.createDataFrame(c, "cat_id long, lon double, lat double, z double")
    met, of = [], matching._met_in_pixels
    monkeypatch.setattr(matching, "FEW_PAIRS", 100)
    monkeypatch.setattr(matching, "_met_in_pixels", lambda *a, **k: met.append((a[2], of(*a, **k))) or met[-1][1])
    unit = lambda lon, lat: np.array([math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat))])
    for limit, dz in ((1200.0, None), (600.0, 0.005)):
        met.clear()
        got = {r["obs_id"]: (r["cat_id"], r["separation_arcmin"]) for r in matching.crossmatch(left, right, limit, dz).collect()}
        assert got[900] == got[None] == (None, None) and len(met) >= 4
        n_met = met[0][1].count()
        for i, lon, lat, z in o:
            near = [(60 * math.degrees(2 * math.asin(min(1.0, np.linalg.norm(unit(lon, lat) - unit(b, t)) / 2))), k) for k, b, t, w in c if k is not None and (dz is None or (z is not None and abs(z - w) <= dz))]
            near = [x for x in sorted(near, key=lambda x: (round(x[0], 7), x[1])) if x[0] <= limit]
            assert got[i][0] == (near[0][1] if near else None)
            assert got[i][1] == (pytest.approx(near[0][0], abs=1e-6) if near else None)
        whole = sum(1 for _, lon, lat, _ in o for k, b, t, _ in c if k is not None and 60 * math.degrees(2 * math.asin(np.linalg.norm(unit(lon, lat) - unit(b, t)) / 2)) <= limit)
        assert met[0][0] < limit and n_met < whole / 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_rings_and_discs_are_never_broadcast(spark):
    """Sources from a small file make many rows: the optimizer takes them for the smaller side."""
    sky, _, _ = masked_map(spark, 8)
    df = spark.range(40).select(F.col("id").alias("source_id"), (F.col("id") * 9.0).alias("lon"), (F.col("id") - 20.0).alias("lat"))
    for nside in (8, 256):
        sums = sky.select("pix", F.col("value").alias("s"), F.lit(1).alias("c"), F.col("value").alias("ring_s"), F.lit(1).alias("ring_c"))
        for found in (spatial.shell_sums(df, sums, nside, F.array(F.lit(0.1)), "source_id"), spatial.aperture_join(df, sky, nside, F.lit(0.1))):
            plan = plan_of(found)
            build = "BuildRight" if nside == 8 else None
            assert ("BroadcastHashJoin" in plan) == (nside == 8) and (build is None or build in plan), plan
            assert "BuildLeft" not in plan


def test_centres_list_their_discs_where_they_are_followed(spark):
    """The pixels of a source's patch aren't shuffled: the sources are dealt before, by key."""
    sky, _, _ = masked_map(spark, 8)
    df = spark.range(6).select(F.col("id").alias("source_id"), (F.col("id") * 50.0).alias("lon"), (F.col("id") * 9.0 - 20).alias("lat"))
    near = spatial.aperture_join(spatial.spread(df, "source_id"), sky, 8, F.lit(0.5)).groupBy("source_id").agg(F.count("*"))
    plan = plan_of(near)
    assert plan.count("Exchange hashpartitioning(source_id") == 1, plan
    assert {r["source_id"] for r in cutouts.find_centers(df, sky, 8, 2400.0, 15, 600.0).collect()} == set(range(6))


def test_pairs_in_space_are_made_in_one_pass(spark):
    """Pairs carry what is asked of them, so they aren't shuffled to meet it; equal probabilities go to the least id."""
    rng = np.random.default_rng(6)
    halos = [(i, i % 4, *map(float, rng.uniform(-1, 1, 3)), float(rng.uniform(13, 14)), float(rng.uniform(0.5, 2))) for i in range(90)]
    halos += [(1000 - i, *h[1:]) for i, h in enumerate(halos)]  # copies under other numbers
    h = spark.createDataFrame(halos, "id long, label int, x double, y double, z double, log_mass double, n double")
    refs = [(i, *map(float, rng.uniform(-1, 1, 3)), 13.5) for i in range(25)]
    r = spark.createDataFrame(refs, "ref_id long, x double, y double, z double, log_mass double")
    assert plan_of(matching.halo_cdf(h, r, 0.5)).count("Exchange") == 2
    pairs = matching.matching_pairs(r.withColumnRenamed("ref_id", "obs_id"), h, 0.5)
    assert plan_of(pairs).count("Exchange hashpartitioning(cx") == 2 and "Exchange hashpartitioning(id" not in plan_of(pairs)
    found = {x["ref_id"]: x for x in matching.match_halo(h, r, 0.5, 0.5, 0.4).collect()}
    listed = {(x["ref_id"], x["id"]): x for x in matching.halo_cdf(h, r, 0.5).collect()}
    assert len(found) == len(refs)
    for ref in refs:
        near = []
        for i, _, x, y, z, mass, n in halos:
            d = math.dist(ref[1:4], (x, y, z))
            cdf = 1 - math.exp(-4.0 / 3 * math.pi * d**3 * n)
            if d <= 0.5:
                assert listed[ref[0], i]["cdf"] == pytest.approx(cdf, abs=1e-12) and listed[ref[0], i]["dlogm"] == pytest.approx(abs(mass - ref[4]), abs=1e-12)
                if cdf < 0.5 and abs(mass - ref[4]) < 0.4:
                    near.append((round(cdf, 12), i, d))
        assert found[ref[0]]["id"] == (min(near)[1] if near else None)
        assert found[ref[0]]["dist"] == (pytest.approx(min(near)[2]) if near else None)


def test_only_pairs_that_a_round_follows_are_stored(spark):
    """Of a full matrix a round keeps pairs with one better one at most."""
    rows = [(i, k, ((i * 37 + k * 11) % 101) / 101, 1.0) for i in range(60) for k in range(4)]
    pairs = spark.createDataFrame(rows, "obs_id long, label int, pval double, dist double")
    assert matching._dominated(pairs).count() <= 2 * (4 + 60)
    want, used = [], set()
    for i, k, p, _ in sorted(rows, key=lambda x: (x[2], x[0], x[1])):
        if ("o", i) not in used and ("l", k) not in used:
            want.append((i, k))
            used |= {("o", i), ("l", k)}
    assert sorted((x["obs_id"], x["label"]) for x in matching.greedy_match(pairs, None).collect()) == sorted(want)


def test_random_stacks_in_batches_equal_whole_ones(spark, monkeypatch):
    """Draws of one batch of repetitions are on disk at a time, whatever the number of all."""
    rows = spark.range(11).crossJoin(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "radius double")).select(F.col("id").alias("row"), "radius", (F.col("id") * F.col("radius") % 7).alias("signal"))
    src = spark.createDataFrame([(g, i, n, 0.5 + i, reps) for g, n, reps in (("a", 4, 7), ("b", 2, 4), ("c", 1, 0)) for i in range(n)], "g string, number long, size long, theta double, reps int")
    stored, of = [], significance.written
    monkeypatch.setattr(significance, "written", lambda df, name: stored.append(name) or of(df, name))
    found = []
    for most in (1 << 40, 1):
        monkeypatch.setattr(significance, "BATCH_DRAWS", most)
        stored.clear()
        found.append({(r["g"], r["r_idx"]): r["means"] for r in significance.scaled_stacks(src, rows, [0.5, 1.0], F.col("reps"), 3, "g").collect()})
    assert stored.count("stack-sums") == 3
    assert found[0].keys() == found[1].keys() and len(found[0]) == 4
    for k, means in found[0].items():
        assert len(means) == (7 if k[0] == "a" else 4) and found[1][k] == pytest.approx(means)


def test_written_tables_leave_no_shuffle_files(spark):
    import glob
    import time

    from skylattice.sources.tables import written

    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    assert written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test").count() == 7
    own = spark.sparkContext.statusTracker().getActiveStageIds()
    for _ in range(50):
        left = files() - before
        if len(left) <= 1:  # that of the count itself
            break
        time.sleep(0.1)
    assert len(left) <= 1 and not own
