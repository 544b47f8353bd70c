"""Observed clusters and settings from TOML."""

from __future__ import annotations

import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import radec_to_galactic
from ..operators.rows import computed

SCHEMA = "identifier string, name string, ra_deg double, dec_deg double, cz_cmb double, cz_cmb_err double"


def parse_toml(text: str) -> dict:
    """TOML, with numbers like ``1.e5`` repaired when the text doesn't parse."""
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return tomllib.loads(re.sub(r"(\d)\.([eE])", r"\1.0\2", text))


def observed_clusters(spark: SparkSession, text: str) -> DataFrame:
    """One row for each entry with a position; the name defaults to the identifier."""
    rows = []
    for identifier, entry in parse_toml(text).items():
        details = entry.get("details") if isinstance(entry, dict) else None
        if not isinstance(details, dict) or details.get("ra") is None or details.get("dec") is None:
            continue
        number = lambda k, d=details: None if d.get(k) is None else float(d[k])
        rows.append((identifier, str(details.get("name", identifier)), number("ra"), number("dec"), number("cz_cmb"), number("cz_cmb_err")))
    if not rows:
        raise ValueError("no cluster with a position")
    return spark.createDataFrame(rows, SCHEMA)


def cluster_positions(clusters: DataFrame) -> DataFrame:
    """Adds Galactic position and redshift of observed clusters; an unknown velocity gives a null redshift."""
    ell, b = radec_to_galactic(F.col("ra_deg"), F.col("dec_deg"))
    return computed(clusters, ell=ell, b=b, z=F.when(~F.isnan("cz_cmb"), F.col("cz_cmb") / SPEED_OF_LIGHT))


#: km/s.
SPEED_OF_LIGHT = 299792.458


def load_settings(path: str, keys: tuple[str, ...] = ("map", "pool", "output", "catalogue")) -> dict:
    """Settings with the paths of ``[paths]`` resolved against its root (relative to the file's folder)."""
    with open(path, encoding="utf-8") as f:
        settings = tomllib.loads(f.read())
    paths = settings.get("paths", {})
    here = os.path.dirname(os.path.abspath(path))
    root = os.path.join(here, paths.get("root", ".."))
    settings["paths"] = {k: os.path.normpath(os.path.join(root, v)) if k in keys and isinstance(v, str) else v for k, v in paths.items()}
    return settings


def output_path(folder: str, sim_key: str, tag: str | None = None) -> str:
    return f"{folder}/{sim_key}{f'_{tag}' if tag else ''}"
