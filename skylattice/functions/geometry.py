"""Spherical geometry on Spark columns.  Angles are degrees unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rotation from ICRS to Galactic axes (fixed values, published).
ICRS_TO_GALACTIC = (
    (-0.0548755604, -0.8734370902, -0.4838350155),
    (0.4941094279, -0.4448296300, 0.7469822445),
    (-0.8676661490, -0.1980763734, 0.4559837762),
)
ARCMIN = 3.141592653589793 / 10800.0


def clipped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    lon, lat = F.radians(lon), F.radians(lat)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def rotated(v: tuple[Column, Column, Column], inverse: bool = False) -> tuple[Column, ...]:
    m = tuple(zip(*ICRS_TO_GALACTIC, strict=True)) if inverse else ICRS_TO_GALACTIC
    return tuple(v[0] * a + v[1] * b + v[2] * c for a, b, c in m)


def lon_lat(v: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Longitude in [0, 360) and latitude of a vector of any positive length; null for length zero."""
    r = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.pmod(F.degrees(F.atan2(v[1], v[0])), F.lit(360.0)), F.degrees(F.asin(clipped(F.try_divide(v[2], r))))


def radec_to_galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    return lon_lat(rotated(unit_vector(ra, dec)))


def galactic_to_radec(ell: Column, b: Column) -> tuple[Column, Column]:
    return lon_lat(rotated(unit_vector(ell, b), inverse=True))


def shifted(x: Column, y: Column, z: Column, centre: tuple) -> tuple[Column, Column, Column]:
    return x - centre[0], y - centre[1], z - centre[2]


def cartesian_to_r_theta_phi(x: Column, y: Column, z: Column, centre: tuple = (0.0, 0.0, 0.0)) -> tuple[Column, Column, Column]:
    """Distance, polar angle and azimuth (radians); the polar angle of the centre itself is null."""
    dx, dy, dz = shifted(x, y, z, centre)
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    return r, F.acos(clipped(F.try_divide(dz, r))), F.pmod(F.atan2(dy, dx), F.lit(6.283185307179586))


def icrs_to_galactic_spherical(x: Column, y: Column, z: Column, centre: tuple) -> tuple[Column, Column, Column]:
    """Distance (unit of the input), Galactic longitude and latitude about the centre."""
    v = shifted(x, y, z, centre)
    r = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return (r, *lon_lat(rotated(v)))


def icrs_to_galactic_cartesian(x: Column, y: Column, z: Column, centre: tuple) -> tuple[Column, ...]:
    """Position turned about the centre into Galactic axes."""
    return tuple(v + c for v, c in zip(rotated(shifted(x, y, z, centre)), centre, strict=True))


def spherical_to_cartesian(r: Column, lon: Column, lat: Column) -> tuple[Column, ...]:
    return tuple(r * c for c in unit_vector(lon, lat))


def cos_separation(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    return clipped(F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2)))


def separation_arcmin(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle separation by the haversine, exact for small angles."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.sqrt(h), F.lit(1.0)))) * 60


def offsets_arcmin(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Longitude (within 180 degrees either way) and latitude in the frame centred on (lon0, lat0)."""
    x, y, z = unit_vector(lon - lon0, lat)
    t = F.radians(lat0)
    along, up = x * F.cos(t) + z * F.sin(t), z * F.cos(t) - x * F.sin(t)
    return F.degrees(F.atan2(y, along)) * 60, F.degrees(F.asin(clipped(up))) * 60


def sky_of_offset(x_rad: Column, y_rad: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Sky position of plane offsets (azimuthal equidistant about the centre)."""
    rho, angle, t = F.hypot(x_rad, y_rad), F.atan2(x_rad, y_rad), F.radians(lat0)
    lat = F.asin(clipped(F.sin(t) * F.cos(rho) + F.cos(t) * F.sin(rho) * F.cos(angle)))
    dlon = F.atan2(F.sin(rho) * F.sin(angle), F.cos(t) * F.cos(rho) - F.sin(t) * F.sin(rho) * F.cos(angle))
    return F.pmod(lon0 + F.degrees(dlon), F.lit(360.0)), F.degrees(lat)


def angular_size_arcmin(radius: Column, distance: Column) -> Column:
    return F.degrees(F.atan(F.try_divide(radius, distance))) * 60


def solid_angle(theta_arcmin: Column) -> Column:
    return F.lit(3.141592653589793) * F.pow(theta_arcmin * ARCMIN, 2)
