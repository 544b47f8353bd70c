import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.plans import suite
from skylattice.sources import clusters, fits, tables
from skylattice.streaming import counts


def _block(cards):
    text = "".join(c.ljust(80) for c in [*cards, "END"])
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def _fits(rows, columns, name):
    layout = np.dtype([(n, t) for n, t, _ in columns])
    data = np.array(rows, layout).tobytes()
    head = ["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", f"NAXIS1  = {layout.itemsize:>20}", f"NAXIS2  = {len(rows):>20}", "PCOUNT  =                    0", "GCOUNT  =                    1", f"TFIELDS = {len(columns):>20}", f"EXTNAME = '{name}'"]
    for i, (n, _, form) in enumerate(columns, 1):
        head += [f"TTYPE{i:<3}= '{n}'", f"TFORM{i:<3}= '{form}'"]
    return _block(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"]) + _block(head) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def test_fits_table_and_map(spark, tmp_path):
    path = str(tmp_path / "cat.fits")
    with open(path, "wb") as f:
        f.write(_fits([(1, 2.5, b"ab ", b"T"), (2, -1.0, b"c", b"F")], [("IDX", ">i4", "1J"), ("SNR", ">f4", "E"), ("NAME", "S4", "4A"), ("FLAG", "S1", "L")], "CAT"))
    rows = fits.read_fits(spark, path, "CAT").orderBy("row").collect()
    assert [(r["IDX"], r["SNR"], r["NAME"], r["FLAG"]) for r in rows] == [(1, 2.5, "ab", True), (2, -1.0, "c", False)]
    with pytest.raises(KeyError):
        fits.read_fits(spark, path, "OTHER").collect()
    with pytest.raises(KeyError):
        fits.read_fits(spark, path, 1, ["NONE"])
    path = str(tmp_path / "map.fits")
    with open(path, "wb") as f:
        f.write(_fits([([1.0, 2.0],), ([3.0, 4.0],)], [("FULL", (">f4", (2,)), "2E")], "MAP"))
    assert [(r["pix"], r["value"]) for r in fits.read_map(spark, path).orderBy("pix").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]


def test_clusters(spark, tmp_path):
    text = "[A.details]\nra = 1.e1\ndec = 2.0\ncz_cmb = 1000\n[B.details]\nname = 'b'\nra = 3.0\n[C]\nx = 1\n"
    rows = clusters.observed_clusters(spark, text).collect()
    assert [(r["identifier"], r["name"], r["ra_deg"], r["cz_cmb"], r["cz_cmb_err"]) for r in rows] == [("A", "A", 10.0, 1000.0, None)]
    with pytest.raises(ValueError):
        clusters.observed_clusters(spark, "[C]\nx = 1\n")
    path = tmp_path / "conf" / "s.toml"
    path.parent.mkdir()
    path.write_text("[paths]\nroot = '../data'\nmap = 'm.fits'\ntag = 'x'\n")
    got = clusters.load_settings(str(path))["paths"]
    assert got["map"] == str(tmp_path / "data" / "m.fits") and got["tag"] == "x"
    assert clusters.output_path("/o", "s", "t") == "/o/s_t"


def test_results_round_trip(spark, tmp_path):
    halos = spark.createDataFrame([(x, i, *[1.0] * 9, 0) for i, x in enumerate("ba")], tables.HALO_RESULT)
    columns = tables.BIN_RESULT.replace(" result_ord int,", "") + ", stacked array<double>, stacked_low array<double>, stacked_high array<double>, stacked_profile array<double>"
    bins = spark.createDataFrame([("b", k, 1.0, None, 1.0, n, [1.0], [2.0], [4.0], [1.0]) for k, n in ((0, 2), (1, 0), (2, 3))] + [("a10", 0, 1.0, 2.0, 1.5, 1, [1.0], [2.0], [4.0], None)], columns)
    folder = str(tmp_path / "r")
    tables.save_results(halos, bins, folder)
    got = tables.load_bins(spark, folder)
    assert got.first()["stacked_error"] == [1.0] and tables.default_simulation(got) == "a10" and tables.result_simulations(spark, folder) == ["a10", "b"]
    # An empty bin has no result, so places and bin numbers differ behind it.
    assert sorted((r["bin_idx"], r["result_ord"]) for r in got.where("sim = 'b'").collect()) == [(0, 0), (2, 1)]
    assert got.where(tables.has_profiles(got)).count() == 2 and tables.load_halos(spark, folder, "a").count() == 1
    entry = tables.bins_as_maps(got.where("sim = 'a10'")).first()["entries"]
    assert entry["count"] == '{"value":1}'
    assert "stacked" not in tables.load_bins(spark, folder, profiles=False).columns
    tables.dump(halos, str(tmp_path / "d"))
    assert tables.select_columns(spark, str(tmp_path / "d"), "sim").columns == ["sim"]
    with pytest.raises(KeyError):
        tables.select_columns(spark, str(tmp_path / "d"), "none")
    with pytest.raises(KeyError):
        tables.shaped(halos.drop("mass"), tables.HALO_RESULT)


def test_snapshot_and_catalogue_schemas(spark):
    head = tables.snapshot_header(spark.createDataFrame([(681.0, 0.5)], "BoxSize float, Redshift double")).first()
    assert head["BoxSize"] == 681.0 and head["Redshift"] == 0.5 and head["Time"] != head["Time"]
    snap = spark.createDataFrame([("PartType1",), ("PartType0",), ("Header",), ("PartType1",)], "part_type string")
    assert tables.part_types(snap) == ["PartType0", "PartType1"]
    names = [n for group in fits.CLUSTER_COLUMNS.values() for n in group]
    upper = {n: n.removesuffix("_deg").removesuffix("_arcmin").upper() for n in names}
    row = spark.range(1).select(*[(F.lit(" a ") if n in fits.CLUSTER_COLUMNS["string"] else F.lit(-1)).alias(u) for n, u in upper.items()])
    got = fits.cluster_catalogue(row)
    assert len(got.columns) == 29 and got.first()["name"] == "a" and got.first()["z"] is None and dict(got.dtypes)["snr"] == "float"
    with pytest.raises(KeyError):
        fits.cluster_catalogue(row.drop("SNR"))
    seen = clusters.cluster_positions(spark.createDataFrame([("a", 10.0, 20.0, 2997.92458), ("b", 1.0, 2.0, None)], "identifier string, ra_deg double, dec_deg double, cz_cmb double")).collect()
    assert seen[0]["z"] == pytest.approx(0.01) and seen[1]["z"] is None and 0 <= seen[0]["ell"] < 360


def test_simulation_choice(spark):
    from skylattice.operators import catalogue

    rows = spark.createDataFrame([("10",), ("9",), ("9",)], "sim string")
    assert catalogue.chosen_simulations(rows, "All") == ["9", "10"] and catalogue.chosen_simulations(rows, "all", 1) == ["9"]
    assert catalogue.chosen_simulations(rows, 7) == ["7"]
    with pytest.raises(ValueError):
        catalogue.chosen_simulations(rows, None)


def test_pixel_count_stream(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", 10.0, 20.0) for h in (0, 0, 1, 5)]
    df = spark.createDataFrame(rows, "ts string, lon double, lat double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = counts.pixel_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 4)
    q = stream.writeStream.outputMode("append").format("memory").queryName("px").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select n from px order by start").collect()
    assert [r["n"] for r in got] == [2, 1]


def test_suite(spark):
    from skylattice.operators import significance
    from skylattice.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    sky = tables.written(fx.sky_map(spark, sf, 4), "map")
    pool = suite.random_pool(sky, 4, [600.0, 1200.0, 2400.0], 20, 10.0, None)
    assert pool.count() % 3 == 0
    bound, facts = suite.prepared_map(sky, 4, npix=7, nbins=4)
    assert facts.first()["n"] == bound.pixels.count()
    settings = suite.Suite(fx.BOX, (0.5, 1.0), top_counts=(10, 20), aperture_scale=20.0, n_boot=5, n_stack=8, n_stack_high=8, t_fit_every=1)
    out = suite.mass_bin_suite(fx.halos(spark, sf), bound, pool, settings, b_min=10.0)
    halos = out["halos"].collect()
    assert out["bins"].agg(F.sum("count")).first()[0] == len(halos) > 0
    assert all((h["p"] is None) == (h["signal"] is None) and (h["p"] is None or 0 <= h["p"] <= 1) for h in halos)
    profile = out["profiles"].collect()
    assert {r["bin_idx"] for r in profile} == {h["bin_idx"] for h in halos if h["signal"] is not None} and all(0 <= r["p"] <= 1 for r in profile if r["p"] is not None)
    assert {r["bin_idx"] for r in out["t_fits"].collect()} <= {h["bin_idx"] for h in halos} and out["cutouts"].count() > 0
    compared, ratio = suite.catalogue_comparison(*[spark.createDataFrame([(1, 5, 14.0, 0.1), (2, 6, 14.5, 0.1)], "obs_id long, cat_id long, log_mass double, log_mass_err double")] * 2, n_samples=50)
    assert compared.count() == 2 and abs(ratio.first()["mean"]) < 0.2
    one = significance.numpy_positions(spark, 5, 10.0, 42).collect()
    assert all(abs(r["lat"]) >= 10 for r in one)
