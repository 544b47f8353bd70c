"""Square cutouts, their normalised stacks, and the shrinking-aperture centre."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.geometry import ARCMIN, sky_of_offset
from ..functions.healpix import pixels_of
from ..sources.tables import written
from .rows import computed, numbered, numbered_within
from .significance import SEED, drawn, random_position, random_positions
from .spatial import aperture_join, nearest_pixel, spread


def cutout_grid(sources: DataFrame, size_arcmin: Column, npix: int) -> DataFrame:
    """``iy, ix, x, y`` (arcmin) and the sky position of each cell's centre; an even npix gains one."""
    n = npix + 1 - npix % 2
    cells = sources.withColumn("_size", size_arcmin).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = lambda i: (F.col(i) - (n - 1) / 2.0) * F.col("_size") / n
    cells = computed(cells, x=at("ix"), y=at("iy")).drop("_size")
    lon, lat = sky_of_offset(F.col("x") * ARCMIN, F.col("y") * ARCMIN, F.col("lon"), F.col("lat"))
    return computed(cells, sky_lon=lon, sky_lat=lat)


def extent(size_arcmin: Column) -> Column:
    """Bounds of a square cutout: x from, x to, y from, y to (arcmin)."""
    half = size_arcmin / 2.0
    return F.array(-half, half, -half, half)


def cutout(sources: DataFrame, sky_map: DataFrame, nside: int, size_arcmin: Column, npix: int = 301, key: str = "source_id") -> DataFrame:
    """``key, iy, ix, x, y, pix, value`` with null values where the map isn't good or is masked (``bound_map``)."""
    grid = cutout_grid(sources.select(key, "lon", "lat", size_arcmin.alias("_s")), F.col("_s"), npix)
    return nearest_pixel(grid, sky_map, nside, "sky_lon", "sky_lat").select(key, "iy", "ix", "x", "y", "pix", "value")


def normalised(cut: DataFrame, theta: Column, nbins: int, half: float, key: str = "source_id") -> DataFrame:
    """Mean value and count in cells (iu, iv) of offsets in units of theta; the last edge is inside."""

    def place(x: str) -> Column:
        u = (F.col(x) / theta + half) / (2 * half / nbins)
        return F.when(u == nbins, nbins - 1).otherwise(F.floor(u)).cast("int")

    rows = cut.where("value is not null").withColumn("iu", place("x")).withColumn("iv", place("y"))
    rows = rows.where(f"iu >= 0 and iu < {nbins} and iv >= 0 and iv < {nbins}")
    return rows.groupBy(key, "iu", "iv").agg(F.avg("value").alias("value"), F.count("*").alias("count"))


def stacked(normal: DataFrame) -> DataFrame:
    """Mean over sources of their means (not weighted by pixels)."""
    return normal.groupBy("iu", "iv").agg(F.avg("value").alias("value"), F.count("*").alias("n_sources"))


def random_stack(sizes: DataFrame, sky_map: DataFrame, nside: int, n_stack: int, nbins: int, half: float, npix: int = 301, size_factor: float = 5.0, abs_b_min: float = 10.0, seed: int | None = SEED) -> DataFrame:
    """``source_id, iu, iv, value, count`` of cutouts at random positions, each with a size drawn with
    replacement from ``sizes(theta)`` and normalised by it; ``stacked`` gives their mean."""
    ranked = written(numbered(sizes.where("theta > 0").select("theta"), F.col("theta"), name="_k"), "sizes")
    n = ranked.count()
    if not n:
        raise ValueError("no sizes to draw from")
    where = random_positions(sizes.sparkSession, n_stack, abs_b_min, seed).withColumnRenamed("id", "source_id")
    drawn_sizes = where.withColumn("_k", drawn(F.lit(0), F.col("source_id"), F.lit(n), seed, 3)).join(ranked, "_k").drop("_k")
    cut = cutout(drawn_sizes, sky_map, nside, size_factor * F.col("theta"), npix)
    return normalised(cut.join(drawn_sizes.select("source_id", "theta"), "source_id"), F.col("theta"), nbins, half)


def grouped_random_stack(sources: DataFrame, group: str, sky_map: DataFrame, nside: int, n_stack: int, nbins: int, half: float, npix: int = 301, size_factor: float = 5.0, abs_b_min: float = 10.0, seeds: DataFrame | None = None) -> DataFrame:
    """``group, iu, iv, value, n_sources``: for each group the mean of cutouts at ``n_stack`` random positions, each
    with a size drawn with replacement from the group's ``sources(group, theta)``.

    ``seeds(group, seed)`` makes positions and draws hashes of the group's seed; without it both follow the
    linear rule and the spiral, the same for every group.
    """
    ranked = written(numbered_within(sources.where("theta > 0").select(group, "theta"), group, F.col("theta"), name="_k", size="_n"), "sizes")
    each = ranked.groupBy(group).agg(F.max("_n").alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_stack - 1).cast("long"))))
    if seeds is None:
        lon, lat = random_position(F.col("_i"), abs_b_min)
        draw = drawn(F.lit(0), F.col("_i"), F.col("_n"), None)
    else:
        each = each.join(F.broadcast(seeds), group)  # one row for each bin that is cut out
        lon, lat = random_position(F.col("_i"), abs_b_min, F.col("seed"))
        draw = F.pmod(F.xxhash64(F.col("seed"), F.lit(3), F.lit(0), F.col("_i")), F.col("_n"))
    where = computed(each, lon=lon, lat=lat, _k=draw.cast("long")).join(ranked.select(group, "_k", "theta"), [group, "_k"])
    where = where.select(F.concat_ws("/", group, F.col("_i").cast("string")).alias("_id"), group, "lon", "lat", "theta")
    cut = cutout(where, sky_map, nside, size_factor * F.col("theta"), npix, "_id")
    normal = normalised(cut.join(where.select("_id", "theta"), "_id"), F.col("theta"), nbins, half, "_id")
    return normal.join(where.select("_id", group), "_id").groupBy(group, "iu", "iv").agg(F.avg("value").alias("value"), F.count("*").alias("n_sources"))


class _Patch:
    """The good pixels around one source, and cutouts of them about any point in it."""

    def __init__(self, nside: int, pix: np.ndarray, value: np.ndarray, lon: float, lat: float, reach: float) -> None:
        order = np.argsort(pix)
        self.nside, self.pix, self.value = nside, pix[order], value[order]
        self.z0, self.phi0, self.cos_reach = math.sin(math.radians(lat)), math.radians(lon), math.cos(min(reach, math.pi))
        self.whole = reach >= math.pi

    def at(self, x: np.ndarray, y: np.ndarray, lon: float, lat: float) -> np.ndarray | None:
        """Values (NaN where the map has none) at plane offsets in radians; None if one lies outside the patch."""
        rho, angle, t = np.hypot(x, y), np.arctan2(x, y), math.radians(lat)
        z = np.clip(math.sin(t) * np.cos(rho) + math.cos(t) * np.sin(rho) * np.cos(angle), -1, 1)
        turn = np.arctan2(np.sin(rho) * np.sin(angle), math.cos(t) * np.cos(rho) - math.sin(t) * np.sin(rho) * np.cos(angle))
        # As a position in degrees first: cells on the border of two pixels go where a cutout puts them.
        z, phi = np.sin(np.radians(np.degrees(np.arcsin(z)))), np.radians(np.mod(lon + np.degrees(turn), 360.0))
        near = z * self.z0 + np.sqrt(np.maximum((1 - z * z) * (1 - self.z0 * self.z0), 0.0)) * np.cos(phi - self.phi0)
        if not self.whole and near.min() < self.cos_reach:
            return None
        wanted = pixels_of(self.nside, z, phi)
        place = np.minimum(np.searchsorted(self.pix, wanted), len(self.pix) - 1)
        return np.where(self.pix[place] == wanted, self.value[place], np.nan)


def _shrunk(patch: _Patch, lon: float, lat: float, size: float, npix: int, final: float, radius: float, shrink: float, max_iterations: int) -> tuple[float, float, bool, int, float] | None:
    """Centre, whether it converged, steps and last radius of one source; None if it leaves the patch."""
    n = npix + 1 - npix % 2
    offset = (np.arange(n) - (n - 1) / 2.0) * size / n
    y, x = (v.ravel() for v in np.meshgrid(offset, offset, indexing="ij"))
    apart = np.hypot(x, y)
    limit, steps = radius, 0
    while steps < max_iterations:
        value = patch.at(x * ARCMIN, y * ARCMIN, lon, lat)
        if value is None:
            return None
        weight = np.where(np.isfinite(value) & (apart <= limit), np.maximum(value, 0.0), 0.0)
        total = weight.sum()
        steps += 1
        if not total > 0:
            return lon, lat, False, steps, limit
        dx, dy = (weight * x).sum() / total, (weight * y).sum() / total
        lon, lat, limit = lon + dx / 60 / math.cos(math.radians(lat)), lat + dy / 60, limit * shrink
        if limit < final:
            break
    else:
        return lon, lat, False, steps, limit
    # The peak in the last aperture; of equal values the first in reading order.
    value = patch.at(x * ARCMIN, y * ARCMIN, lon, lat)
    if value is None:
        return None
    inside = np.flatnonzero(np.isfinite(value) & (apart <= final))
    if len(inside):
        best = inside[np.argmax(value[inside])]
        lon, lat = lon + x[best] / 60 / math.cos(math.radians(lat)), lat + y[best] / 60
    return lon, lat, True, steps, limit


def find_centers(sources: DataFrame, sky_map: DataFrame, nside: int, size_arcmin: float = 240.0, npix: int = 101, final_arcmin: float = 9.6, initial_arcmin: float | None = None, shrink: float = 0.9, max_iterations: int = 1000, key: str = "source_id") -> DataFrame:
    """Centre by shrinking apertures: weighted centroids of positive values, then the peak.

    Every step cuts a square anew around the source's present centre, takes the centroid inside the
    aperture and moves there (longitude by the cosine of the present latitude); a source without weight
    stops.  One disc join gives each source its patch of the map, twice as wide as the square, and the
    steps run within it.  Sources that leave their patch are taken again with one twice as wide.
    """
    if not 0 < shrink < 1:
        raise ValueError("the aperture must shrink")
    radius = size_arcmin / math.sqrt(2) if initial_arcmin is None else initial_arcmin
    kind = sources.schema[key].dataType
    columns = f"`{key}` {kind.simpleString()}, lon double, lat double, converged boolean, n_iterations int, final_radius double, left boolean"
    schema = pa.schema([(key, to_arrow_type(kind)), ("lon", pa.float64()), ("lat", pa.float64()), ("converged", pa.bool_()), ("n_iterations", pa.int32()), ("final_radius", pa.float64()), ("left", pa.bool_())])
    places = sources.select(key, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    start = (F.lit(False).alias("converged"), F.lit(1).alias("n_iterations"), F.lit(float(radius)).alias("final_radius"))

    def step(reach: float) -> object:
        def run(table: pa.Table) -> pa.Table:
            lon, lat = table.column("lon")[0].as_py(), table.column("lat")[0].as_py()
            patch = _Patch(nside, table.column("pix").to_numpy(), table.column("value").to_numpy(), lon, lat, reach)
            found = _shrunk(patch, lon, lat, size_arcmin, npix, final_arcmin, radius, shrink, max_iterations)
            row = (lon, lat, False, 0, radius, True) if found is None else (*found, False)
            return pa.table([table.column(key).slice(0, 1), *[pa.array([v], f.type) for v, f in zip(row, list(schema)[1:], strict=True)]], schema=schema)

        return run

    # Half a diagonal and a pixel: the square itself; the rest is room to move.
    reach, left, out = 2 * (size_arcmin * ARCMIN / math.sqrt(2)) + 2.0 / nside, places, None
    while True:
        # Dealt by key before the discs are listed: a source's pixels are made in the task that follows it.
        near = aperture_join(spread(left, key), sky_map, nside, F.lit(min(reach + 2.0 / nside, math.pi))).select(key, "lon", "lat", "pix", F.col("value").cast("double").alias("value"))
        found = written(near.groupBy(key).applyInArrow(step(reach), columns), "centres")
        done = found.where("not left").drop("left")
        out = done if out is None else out.unionByName(done)
        again = found.where("left").select(key)
        if again.isEmpty():
            break
        left, reach = places.join(again, key, "left_semi"), 2 * reach
    lost = places.join(out.select(key), key, "left_anti").select(key, "lon", "lat", *start)
    return out.unionByName(lost)


def display_scale(image: DataFrame) -> float:
    """99th percentile of the absolute values, with the maximum and then 1 to fall back on."""
    row = image.agg(F.percentile(F.abs("value"), F.lit(0.99)), F.max(F.abs("value"))).first()
    return next((v for v in row if v is not None and v > 0), 1.0)
