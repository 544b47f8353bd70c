import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import healpix as hp
from skylattice.operators import profiles, spatial


def centres(spark, nside):
    rows = hp.with_centre(spark.range(hp.npix(nside)).withColumnRenamed("id", "pix"), nside).orderBy("pix").toPandas()
    return rows["pz"].to_numpy(), rows["pphi"].to_numpy()


@pytest.mark.parametrize("nside", [1, 2, 4, 8])
def test_pixel_round_trip(spark, nside):
    rows = hp.with_centre(spark.range(hp.npix(nside)).withColumnRenamed("id", "pix"), nside)
    out = rows.select("pix", hp.z_phi_to_pix(nside, F.col("pz"), F.col("pphi")).alias("again")).toPandas()
    assert len(out) == hp.npix(nside) and (out["pix"] == out["again"]).all()


def test_nside_of():
    assert hp.nside_of(768) == 8
    with pytest.raises(ValueError):
        hp.nside_of(100)


SOURCES = [(0, 0.0, 90.0, 20.0), (1, 10.0, -90.0, 35.0), (2, 359.9, 3.0, 12.0), (3, 0.0, 85.0, 25.0), (4, 200.0, -40.0, 0.5), (5, 120.0, 20.0, 180.0), (6, 45.0, 66.4, 9.0)]


def test_disc_equals_brute_force(spark):
    nside = 8
    z, phi = centres(spark, nside)
    df = spark.createDataFrame(SOURCES, "source_id long, lon double, lat double, radius double")
    got = spatial.disc_pixels(df, nside, F.radians("radius")).toPandas()
    for key, lon, lat, radius in SOURCES:
        t, p = np.deg2rad(lat), np.deg2rad(lon)
        cos = z * np.sin(t) + np.sqrt(1 - z * z) * np.cos(t) * np.cos(phi - p)
        want = set(np.flatnonzero(cos >= np.cos(np.deg2rad(radius))).tolist())
        own = got[got.source_id == key]["pix"].tolist()
        assert len(own) == len(set(own))
        assert set(own) == want, key


def test_null_source_has_no_pixels(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, 5.0, 0.0)], "source_id long, lon double, lat double")
    got = spatial.disc_pixels(df, 4, F.radians(F.lit(20.0))).select("source_id").distinct().collect()
    assert [r[0] for r in got] == [2]


def test_profiles_agree_with_single_radii(spark):
    nside = 8
    rng = np.random.default_rng(0)
    values = rng.normal(size=hp.npix(nside)).tolist()
    rows = [(i, v if i % 11 else (None if i % 2 else float("nan"))) for i, v in enumerate(values)]
    sky = spark.createDataFrame(rows, "pix long, value double")
    df = spark.createDataFrame([(k, a, b) for k, a, b, _ in SOURCES], "source_id long, lon double, lat double")
    radii = [300.0, 900.0, 1500.0]
    many = profiles.enclosed_profile(df, sky, nside, radii).toPandas().set_index(["source_id", "radius"])
    for r in radii:
        one = profiles.aperture_mean(df, sky, nside, F.lit(r)).toPandas().set_index("source_id")
        for key in one.index:
            assert many.loc[(key, r), "n_pix"] == one.loc[key, "n_pix"]
            np.testing.assert_allclose(many.loc[(key, r), "signal"], one.loc[key, "signal"], equal_nan=True)
    ring = profiles.annulus_mean(df, sky, nside, F.lit(900.0), F.lit(1500.0)).toPandas().set_index("source_id")
    for key in ring.index:
        assert ring.loc[key, "n_pix"] == many.loc[(key, 1500.0), "n_pix"] - many.loc[(key, 900.0), "n_pix"]


def test_interpolation_rules(spark):
    grid = spark.createDataFrame([(1, 1.0, 10.0), (1, 3.0, 30.0), (1, 2.0, None), (1, 4.0, 20.0)], "key long, radius double, signal double")
    at = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 0.5), (1, 5.0)], "key long, target double")
    pick = lambda rule: {r["target"]: r["value"] for r in profiles.interpolated(grid, at, "key", rule).collect()}
    assert pick("clamp") == {1.0: 10.0, 2.0: 20.0, 4.0: 20.0, 0.5: 10.0, 5.0: 20.0}
    assert pick("extrapolate") == {1.0: 10.0, 2.0: 20.0, 4.0: 20.0, 0.5: 5.0, 5.0: 10.0}
    assert pick("null")[0.5] is None
    with pytest.raises(Exception, match="outside"):
        profiles.interpolated(grid, at, "key", "error").collect()


def test_cell_neighbours(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-1, 1, (120, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    got = {(r["id"], r["other"]) for r in spatial.cell_neighbours(df, df.withColumnRenamed("id", "other"), 0.4, "id", "other").collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.4), strict=True)}
