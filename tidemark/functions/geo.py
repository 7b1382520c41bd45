"""Spherical geometry as Spark columns. Angles are degrees, vectors tuples of three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]

EARTH_RADIUS_M = 6_371_000.0
ROTATION_RATE = 7.2921159e-5


def column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def wrap_longitude(lon) -> Column:
    """To [-180, 180); 180 becomes -180."""
    return F.pmod(column(lon) + 180.0, F.lit(360.0)) - 180.0


def unit(lat, lon) -> Vector:
    lat, lon = F.radians(column(lat)), F.radians(column(lon))
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def latitude(v: Vector) -> Column:
    """Of a vector of any length above 0; null for the null vector."""
    return F.degrees(F.asin(clip(v[2] / F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)))))


def longitude(v: Vector) -> Column:
    return F.when(dot(v, v) > 0, wrap_longitude(F.degrees(F.atan2(v[1], v[0]))))


def angular_distance(a: Vector, b: Vector) -> Column:
    return F.degrees(F.acos(clip(dot(a, b))))


def axial_distance(a: Vector, b: Vector) -> Column:
    """Between axes: an axis and its opposite are the same."""
    d = angular_distance(a, b)
    return F.least(d, 180.0 - d)


def plane_distance(v: Vector, pole: Vector) -> Column:
    """Signed degrees from the great circle with this pole."""
    return F.degrees(F.asin(clip(dot(v, pole))))


def rotate(v: Vector, axis: Vector, angle) -> Vector:
    """Right-handed turn of v about a unit axis."""
    t = F.radians(column(angle))
    along, turned = dot(axis, v), cross(axis, v)
    return tuple(x * F.cos(t) + y * F.sin(t) + k * along * (1 - F.cos(t)) for x, y, k in zip(v, turned, axis))


def centrifugal_potential(v: Vector, pole: Vector) -> Column:
    along = dot(v, pole)
    return F.lit(-0.5 * ROTATION_RATE**2 * EARTH_RADIUS_M**2) * (1 - along * along)


def potential_anomaly(v: Vector, old: Vector, new: Vector) -> Column:
    """What the potential gains where the pole moves from `old` to `new`."""
    return centrifugal_potential(v, new) - centrifugal_potential(v, old)


def displaced_pole(offset, azimuth) -> Vector:
    """The pole moved by `offset` degrees from north towards longitude `azimuth`."""
    a, p = F.radians(column(offset)), F.radians(column(azimuth))
    return F.sin(a) * F.cos(p), F.sin(a) * F.sin(p), F.cos(a)


def predicted_elevation(v: Vector, pole: Vector, bulge) -> Column:
    """-bulge * ((north . v)^2 - (pole . v)^2): how far the figure's surface sinks at v when its pole moves."""
    return -column(bulge) * (v[2] * v[2] - dot(pole, v) * dot(pole, v))


def cell_key(lat, lon, lat_step: float = 10.0, lon_step: float = 20.0) -> Column:
    """`a_b`: the numbers of the latitude and the longitude band."""
    return F.concat_ws("_", F.floor((column(lat) + 90.0) / lat_step).cast("string"), F.floor((column(lon) + 180.0) / lon_step).cast("string"))


def steps(first: float, n: int, step: float) -> Column:
    """An array of n numbers; each is first + k * step, nothing is summed up."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(float(first)) + k * F.lit(float(step)))
