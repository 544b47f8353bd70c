"""Maps, sources and catalogues derived from the given tables, whole and without random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import unit_vector
from ..operators.rows import numbered
from ..operators.significance import golden_fraction
from ..sources.tables import table, written

GOLDEN_ANGLE = 137.50776405 / 360
GOLDEN = 0.6180339887498949
PLASTIC = 0.7548776662466927
NSIDE = 16
BOX = 681.0


def on_sky(df: DataFrame, key: str) -> DataFrame:
    """Adds lon and lat of a point for each key on the golden-angle spiral."""
    k = F.col(key)
    return df.withColumn("lon", 360 * golden_fraction(k, GOLDEN_ANGLE)).withColumn("lat", F.degrees(F.asin(2 * golden_fraction(k, GOLDEN) - 1)))


def sky_map(spark: SparkSession, sf: str, nside: int = NSIDE) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % (12 * nside * nside)).alias("pix"), F.sqrt("l_extendedprice").alias("v"))
    return rows.groupBy("pix").agg(F.avg("v").alias("value"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return on_sky(table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id")), "source_id")


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return on_sky(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_acctbal"), "source_id")


def halos(spark: SparkSession, sf: str) -> DataFrame:
    """One halo for each order in a box, by mass from its price."""
    rows = on_sky(table(spark, sf, "orders").select(F.col("o_orderkey").alias("halo_idx"), (F.col("o_totalprice") * 1e10).alias("mass")), "halo_idx")
    r = 300 * F.cbrt(golden_fraction(F.col("halo_idx"), PLASTIC))
    x, y, z = unit_vector(F.col("lon"), F.col("lat"))
    size = 0.5 + 1.5 * golden_fraction(F.col("halo_idx"), 0.5698402909980532)
    return rows.select("halo_idx", "mass", (BOX / 2 + r * x).alias("x"), (BOX / 2 + r * y).alias("y"), (BOX / 2 + r * z).alias("z"), size.alias("r500"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Positions from the first components of the embeddings; the label is the realisation."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("sim"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), (13 + 4 * F.abs(e(3))).alias("log_mass"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """``row, user_id, r_idx, radius, signal``: running means of the square roots of each user's events.

    A user's events, from the first to the last id, fall into BINS equal ranges of ids; a bin's signal is
    the mean over all events up to it.  Sums for each user and bin are taken before any shuffle.
    """
    events = table(spark, sf, "events").select("user_id", "event_id", F.sqrt("value").alias("v"))
    ends = events.groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    place = F.floor((F.col("event_id") - F.col("lo")) * BINS / (F.col("hi") - F.col("lo") + 1)).cast("int") + 1
    sums = events.join(ends, "user_id").groupBy("user_id", place.alias("r_idx")).agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    users = numbered(ends.select("user_id"), F.col("user_id"), name="row")
    grid = users.withColumn("r_idx", F.explode(F.sequence(F.lit(1), F.lit(BINS)))).join(sums, ["user_id", "r_idx"], "left")
    # A user has BINS rows here, whatever the number of events.
    upto = Window.partitionBy("user_id").orderBy("r_idx").rowsBetween(Window.unboundedPreceding, 0)
    signal = F.sum("s").over(upto) / F.sum("n").over(upto)
    return written(grid.select("row", "user_id", "r_idx", F.col("r_idx").cast("double").alias("radius"), signal.alias("signal")), "pool")


#: Radii of a pool's profile.
BINS = 40
