"""Counts for each pixel over a stream of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import healpix as hp


def pixel_counts(stream: DataFrame, nside: int, time: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events for each pixel and time window of ``stream(ts, lon, lat)``; later events than ``late`` go."""
    pix = hp.lonlat_to_pix(nside, F.col("lon"), F.col("lat")).alias("pix")
    counted = stream.withWatermark(time, late).groupBy(F.window(time, every), pix).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "pix", "n")
