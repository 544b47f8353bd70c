"""Spatial joins between sources and the pixels of a map.

A disc is an arc of every ring it crosses, by column arithmetic.  Sums over discs look the ends of the
arcs up in running sums along the rings; where the pixels themselves are asked for, arcs are listed.
Either way the join with the map is an equi-join on the pixel: no theta join, no broadcast that grows
with the map.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import healpix as hp
from .rows import computed


def with_position(sources: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds the height z0 and azimuth phi0 of sources given in degrees."""
    return sources.withColumn("z0", F.sin(F.radians(F.col(lat)))).withColumn("phi0", F.radians(F.pmod(F.col(lon), F.lit(360.0))))


def with_cos_distance(df: DataFrame, out: str = "cos_dist") -> DataFrame:
    """Adds the cosine of the angle between the pixel centre (pz, pphi) and the position (z0, phi0)."""
    flat = F.sqrt(F.greatest((1 - F.col("pz") * F.col("pz")) * (1 - F.col("z0") * F.col("z0")), F.lit(0.0)))
    cos = F.col("pz") * F.col("z0") + flat * F.cos(F.col("pphi") - F.col("phi0"))
    return df.withColumn(out, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def _rings(sources: DataFrame, nside: int, radius: Column, lon: str, lat: str) -> DataFrame:
    """One row for each source and ring that its disc may cross, give or take one at either end.

    Adds ``z0, phi0`` and the ring ``_k``, its height ``_z``, length ``_n``, shift ``_shift`` and ``_flat``,
    the product of the radii of both parallels.  Without a position or radius the ring is null.
    """
    rows = with_position(sources, lon, lat).withColumn("_r", radius).withColumn("_b", F.asin("z0"))
    top = F.when(F.col("_b") + F.col("_r") >= hp.HALF_PI, F.lit(1.0)).otherwise(F.sin(F.col("_b") + F.col("_r")))
    low = F.when(F.col("_b") - F.col("_r") <= -hp.HALF_PI, F.lit(-1.0)).otherwise(F.sin(F.col("_b") - F.col("_r")))
    rows = rows.withColumn("_top", top).withColumn("_low", low)
    rows = rows.withColumn("_from", F.greatest(F.lit(1), hp.rings_above(nside, F.col("_top")) - 1)).withColumn("_to", F.least(F.lit(4 * nside - 1), hp.rings_above(nside, F.col("_low")) + 1))
    # Rows are dropped by empty lists under outer explodes: a filter on a derived column would be
    # pushed down with all of its expressions copied into it.
    rings = rows.withColumn("_k", F.explode_outer(F.when((F.col("_r") >= 0) & F.col("z0").isNotNull(), F.sequence("_from", F.greatest("_from", "_to")))))
    k, z = F.col("_k"), F.col("_z")
    rings = rings.withColumn("_z", hp.ring_z(nside, k)).withColumn("_n", hp.ring_length(nside, k)).withColumn("_shift", hp.ring_shift(nside, k))
    return rings.withColumn("_flat", F.sqrt(F.greatest((1 - z * z) * (1 - F.col("z0") * F.col("z0")), F.lit(0.0))))


def _reach(radius: Column) -> Column:
    """Cosine of half the arc of a ring within the radius: above 1 none of it is, from -1 down all."""
    gap = F.cos(radius) - F.col("_z") * F.col("z0")
    # On a pole (or for a source there) the ring is inside or outside as a whole.
    return F.when(F.col("_flat") > 1e-12, F.try_divide(gap, F.col("_flat"))).otherwise(F.when(gap <= 0, -2.0).otherwise(2.0))


def _arc(x: Column) -> tuple[Column, Column]:
    """First and last place on the ring of an arc; they may lie beyond its ends, as many times as it wraps."""
    n = F.col("_n")
    edge = lambda sign: n * (F.col("phi0") + sign * F.acos(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))) / hp.TWO_PI - F.col("_shift")
    low = F.when(x <= -1, 0).otherwise(F.ceil(edge(-1))).cast("long")
    return low, F.when(x <= -1, n - 1).otherwise(F.least(F.floor(edge(1)), low + n - 1)).cast("long")


def disc_pixels(sources: DataFrame, nside: int, radius: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row for each source and pixel whose centre lies within ``radius`` (radians).

    All columns of the sources stay; ``z0, phi0`` is their position, ``pix, pz, pphi`` the pixel and its centre.  A source with a null position or radius has no pixels.
    """
    rings = _rings(sources, nside, radius, lon, lat).withColumn("_x", _reach(F.col("_r")))
    x, n = F.col("_x"), F.col("_n")
    low, high = _arc(x)
    spans = rings.withColumn("_lo", low).withColumn("_hi", high)
    cells = spans.withColumn("_start", hp.ring_start(nside, F.col("_k"))).withColumn("_i", F.explode_outer(F.when((x <= 1) & (F.col("_hi") >= F.col("_lo")), F.sequence("_lo", F.greatest("_lo", "_hi")))))
    cells = cells.withColumn("_i", F.pmod(F.col("_i"), n))
    centre = ((F.col("_i") + F.col("_shift")) * hp.TWO_PI / n).alias("pphi")
    return cells.select(*sources.columns, "z0", "phi0", (F.col("_start") + F.col("_i")).alias("pix"), F.col("_z").alias("pz"), centre).where("pix is not null")


def ring_sums(sky_map: DataFrame, nside: int) -> DataFrame:
    """``pix, s, c, ring_s, ring_c``: sum and number of the good pixels of the ring up to each pixel, and of the
    whole ring.  Every pixel has a row, good or not; a window holds one ring, at most 4 nside pixels."""
    every = sky_map.sparkSession.range(hp.npix(nside)).withColumnRenamed("id", "pix").join(good_pixels(sky_map), "pix", "left")
    rows = hp.with_ring(every, nside, "pix", "_k")
    ring = Window.partitionBy("_k").orderBy("pix")
    upto, whole = ring.rowsBetween(Window.unboundedPreceding, 0), ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value, one = F.coalesce("value", F.lit(0.0)), F.when(F.col("value").isNotNull(), 1).otherwise(0).cast("long")
    return rows.select("pix", F.sum(value).over(upto).alias("s"), F.sum(one).over(upto).alias("c"), F.sum(value).over(whole).alias("ring_s"), F.sum(one).over(whole).alias("ring_c"))


#: Pixels of a map at most that each task gets whole.
MAP_ROWS = hp.npix(128)


def with_map(rows: DataFrame, pixels: DataFrame, nside: int) -> DataFrame:
    """Rows by pixel joined with those of a map.

    The number of rows that lists make is unknown to the optimizer, which may take them for the smaller side and
    broadcast them.  So a map of few pixels (by its resolution) is broadcast, and with a larger one both sides are dealt.
    """
    return rows.join(F.broadcast(pixels) if hp.npix(nside) <= MAP_ROWS else pixels.hint("merge"), "pix")


def spread(sources: DataFrame, key: str) -> DataFrame:
    """Sources dealt by key over the shuffle partitions, before each makes many rows."""
    return sources.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def shell_lookups(sources: DataFrame, nside: int, radii: Column, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``key, r_idx, pix, _turns, _sign``: running sums to add up for the shell between each of the rising radii
    (an array in radians) and the one before.

    A disc is an arc of each ring it crosses, and an arc's sum is a difference of two running sums.  So
    there are a few rows for each ring, radius and source, and none where the arc is that of the radius
    before.
    """
    rings = _rings(sources.select(key, lon, lat, radii.alias("_radii")), nside, F.element_at("_radii", -1), lon, lat)
    each = rings.select("*", F.posexplode_outer(F.when(F.col("_k").isNotNull(), F.col("_radii"))).alias("r_idx", "_at"))
    before = F.when(F.col("r_idx") > 0, F.try_element_at("_radii", F.greatest("r_idx", F.lit(1))))
    each = each.withColumn("_x", _reach(F.col("_at"))).withColumn("_y", _reach(before))
    for x, lo, hi in (("_x", "_lo", "_hi"), ("_y", "_lo0", "_hi0")):
        low, high = _arc(F.col(x))
        each = each.withColumn(lo, low).withColumn(hi, high)
    inside = lambda x, lo, hi: F.col(x).isNotNull() & (F.col(x) <= 1) & (F.col(hi) >= F.col(lo))
    now, had = inside("_x", "_lo", "_hi"), inside("_y", "_lo0", "_hi0")
    look = lambda place, sign: F.struct(place.alias("i"), F.lit(sign).alias("sign"))
    new = F.array(look(F.col("_hi"), 1), look(F.col("_lo") - 1, -1))
    more = F.concat(new, F.array(look(F.col("_hi0"), -1), look(F.col("_lo0") - 1, 1)))
    same = had & (F.col("_lo") == F.col("_lo0")) & (F.col("_hi") == F.col("_hi0"))
    asked = F.when(now & ~same, F.when(had, more).otherwise(new))
    rows = each.withColumn("_start", hp.ring_start(nside, F.col("_k"))).select(key, "r_idx", "_start", "_n", F.explode_outer(asked).alias("_l"))
    i, n = F.col("_l.i"), F.col("_n")
    return rows.select(key, "r_idx", (F.col("_start") + F.pmod(i, n)).alias("pix"), F.floor(i / n).alias("_turns"), F.col("_l.sign").alias("_sign"))


def shell_sums(sources: DataFrame, sums: DataFrame, nside: int, radii: Column, key: str) -> DataFrame:
    """``key, r_idx, s, n``: sum and number of the good pixels of each shell, from the map's ``ring_sums``;
    shells that gain no good pixel have no row."""
    near = spread(sources.select(key, "lon", "lat", radii.alias("_at")), key)
    met = with_map(shell_lookups(near, nside, F.col("_at"), key), sums, nside)
    part = lambda one, ring: F.sum(F.col("_sign") * (F.col(one) + F.col("_turns") * F.col(ring)))
    return met.groupBy(key, "r_idx").agg(part("s", "ring_s").alias("s"), part("c", "ring_c").alias("n")).where("n > 0")


def fewer_by_rings(nside: int, total: Column | float, largest: Column | float) -> Column | bool:
    """Whether looking up two ends on each ring that discs of so many radians in total cross joins fewer rows
    than the pixels of the largest one (about 12 nside^2 of them on the sphere)."""
    return 2 * 8 * nside / math.pi * total <= 3 * nside * nside * largest * largest


def good_pixels(sky_map: DataFrame, mask: DataFrame | None = None, unseen: float = -1.6375e30) -> DataFrame:
    """``pix, value`` of the pixels that are finite, not the unseen mark and, with a mask, positive there.

    Every join with a map goes through this rule, so a map that was bound to its mask here keeps it in
    apertures, profiles and cutouts.
    """
    value = F.col("value")
    rows = sky_map.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 1e300) & (value != unseen))
    if mask is not None:
        weight = F.col("weight")
        good = weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) < 1e300) & (weight > 0) & (weight != unseen)
        rows = rows.join(mask.where(good).select("pix"), "pix", "left_semi")
    return rows.select("pix", "value")


@dataclass(frozen=True)
class BoundMap:
    """A map with its resolution, mask and cutout settings, as the composite runs take them."""

    pixels: DataFrame
    nside: int
    fwhm_arcmin: float = 9.66
    npix: int = 301
    nbins: int = 128
    half: float = 2.0
    #: Running sums along the rings, where they are stored already.
    sums: DataFrame | None = field(default=None, compare=False)


def bound_map(sky_map: DataFrame, nside: int, mask: DataFrame | None = None, mask_nside: int | None = None, **settings: float) -> BoundMap:
    """The good pixels of a map; a mask of another resolution is an error."""
    if mask is not None and mask_nside is not None and mask_nside != nside:
        raise ValueError(f"the mask has nside {mask_nside}, the map {nside}")
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of two")
    return BoundMap(good_pixels(sky_map, mask), nside, **settings)


def aperture_join(sources: DataFrame, sky_map: DataFrame, nside: int, radius: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Sources with the value of every good pixel within the radius."""
    return with_map(disc_pixels(sources, nside, radius, lon, lat), good_pixels(sky_map), nside)


def nearest_pixel(points: DataFrame, sky_map: DataFrame, nside: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with the value of the pixel that holds them (null where the map has none)."""
    return computed(points, pix=hp.lonlat_to_pix(nside, F.col(lon), F.col(lat))).join(good_pixels(sky_map), "pix", "left")


def cell_neighbours(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, *carried: str) -> DataFrame:
    """Pairs within ``radius`` in three dimensions, by cells of that size and an equi-join.

    Both sides have x, y, z; ids come out under the given names with ``dist`` and the ``carried`` columns of
    either side, so that pairs needn't be joined again.  All pairs of a left row are made in one place.
    """
    kept = lambda rows: [F.col(c) for c in carried if c in rows.columns]
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]
    a = left.select(F.col(left_id), *[F.col(c).alias(f"a{c}") for c in "xyz"], *cell, *kept(left))
    around = F.explode(F.array(*[F.array(*[F.lit(v) for v in (i, j, k)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    b = right.select(F.col(right_id), *[F.col(c).alias(f"b{c}") for c in "xyz"], *cell, *kept(right), around.alias("_d"))
    b = b.select(right_id, "bx", "by", "bz", *[(F.col(f"c{c}") + F.col("_d")[i]).alias(f"c{c}") for i, c in enumerate("xyz")], *kept(right))
    dist = F.sqrt(sum((F.pow(F.col(f"a{c}") - F.col(f"b{c}"), 2) for c in "xyz"), F.lit(0.0)))
    # Pairs grow faster than the rows that are dealt, so cells are dealt by a fixed number, and lists aren't broadcast.
    n, at = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["cx", "cy", "cz"]
    return a.repartition(n, *at).join(b.repartition(n, *at).hint("merge"), at).withColumn("dist", dist).where(F.col("dist") <= radius).select(left_id, right_id, "dist", *carried)
