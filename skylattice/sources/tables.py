"""Parquet tables: inputs, results, and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, a temporary one under a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    The shuffle files behind it aren't needed afterwards and go at once, so that steps don't add up on disk.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def select_columns(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Some columns of a stored table; an unknown name is an error that lists what there is."""
    df = spark.read.parquet(path)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df.select(*names)


def dump(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


# Columns of stored results (fixed values of the format); the last group may be absent.
HALO_RESULT = "sim string, halo_idx long, r double, ell double, b double, mass double, theta double, aperture double, log_mass double, signal double, p double, bin_idx int"
BIN_RESULT = "sim string, bin_idx int, result_ord int, lo double, hi double, median_log_mass double, count long"
BIN_PROFILES = "radii_norm array<double>, stacked_profile array<double>, stacked_error array<double>, random_profile array<double>, random_error array<double>, p_value_profile array<double>, sigma_profile array<double>, t_fit_p_value array<double>, t_fit_sigma array<double>, cutout_mean array<array<double>>, cutout_random_mean array<array<double>>, cutout_extent array<double>"
POINTING_PROFILE = "row long, r_idx int, radius double, signal double"


def shaped(df: DataFrame, schema: str, optional: str = "") -> DataFrame:
    """The columns of a schema, cast; a missing one is an error unless it is optional, further ones go last."""
    need, may = (StructType.fromDDL(x).fields if x else [] for x in (schema, optional))
    missing = [f.name for f in need if f.name not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    known = [f for f in [*need, *may] if f.name in df.columns]
    names = {f.name for f in known}
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known], *[c for c in df.columns if c not in names])


def save_results(halos: DataFrame, bins: DataFrame, folder: str) -> None:
    """Two datasets partitioned by realisation.

    Halos keep the number of their bin; bins get ``result_ord``, their place among the bins of the
    realisation that hold a halo, which differs after an empty bin.  An open upper edge is null.
    """
    if "result_ord" not in bins.columns:
        # A realisation has as many bins as mass steps: a small window.
        at = F.row_number().over(Window.partitionBy("sim").orderBy("bin_idx")) - 1
        bins = bins.where(F.col("count") > 0).withColumn("result_ord", at.cast("int"))
    shaped(halos, HALO_RESULT).write.mode("overwrite").partitionBy("sim").parquet(f"{folder}/halos")
    shaped(bins, BIN_RESULT, BIN_PROFILES).write.mode("overwrite").partitionBy("sim").parquet(f"{folder}/bins")


def load_halos(spark: SparkSession, folder: str, sim: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/halos").withColumn("sim", F.col("sim").cast("string"))
    return df if sim is None else df.where(F.col("sim") == sim)


def load_bins(spark: SparkSession, folder: str, profiles: bool = True, sim: str | None = None) -> DataFrame:
    """Stored bins; older tables that have low and high percentiles in place of an error get half their distance."""
    df = spark.read.parquet(f"{folder}/bins").withColumn("sim", F.col("sim").cast("string"))
    for name in ("stacked", "random"):
        low, high, error = f"{name}_low", f"{name}_high", f"{name}_error"
        if low in df.columns and high in df.columns:
            half = F.zip_with(high, low, lambda h, x: (h - x) / 2)
            df = df.withColumn(error, F.coalesce(F.col(error), half) if error in df.columns else half)
    if not profiles:
        df = df.drop(*[f.name for f in df.schema if f.dataType.typeName() == "array"])
    return df if sim is None else df.where(F.col("sim") == sim)


def result_simulations(spark: SparkSession, folder: str) -> list[str]:
    """Names of the stored realisations in string order, from the table's partitions."""
    rows = spark.read.parquet(f"{folder}/bins").select(F.col("sim").cast("string").alias("sim")).distinct()
    return [r["sim"] for r in rows.orderBy("sim").collect()]


def default_simulation(bins: DataFrame) -> str | None:
    """The first realisation in string order."""
    row = bins.agg(F.min(F.col("sim").cast("string"))).first()
    return row[0]


def has_profiles(bins: DataFrame) -> Column:
    """Whether a bin has a stacked profile."""
    return F.col("stacked_profile").isNotNull() if "stacked_profile" in bins.columns else F.lit(False)


def bins_as_maps(bins: DataFrame) -> DataFrame:
    """``sim, bin_idx, entries``: each bin as a map from column to its value as JSON, for access by name."""
    others = [c for c in bins.columns if c not in ("sim", "bin_idx")]
    pairs = [x for c in others for x in (F.lit(c), F.to_json(F.struct(F.col(c).alias("value"))))]
    return bins.select("sim", "bin_idx", F.create_map(*pairs).alias("entries"))


def snapshot_header(header: DataFrame) -> DataFrame:
    """One row with ``BoxSize``, ``Time`` and ``Redshift``; a missing one is NaN."""
    names = ("BoxSize", "Time", "Redshift")
    return header.limit(1).select(*[(F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) if n in header.columns else F.lit(float("nan"))).alias(n) for n in names])


def part_types(snapshot: DataFrame) -> list[str]:
    """Particle types of a snapshot in string order."""
    rows = snapshot.select("part_type").where(F.col("part_type").startswith("PartType")).distinct()
    return [r["part_type"] for r in rows.orderBy("part_type").collect()]
