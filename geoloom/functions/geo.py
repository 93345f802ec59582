"""Coordinate math as column expressions: tiles, Mercator, UTM, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 20037508.342789244  # half of the Mercator square's side in metres
# GRS80 and the UTM grid.
A, FLAT, K0 = 6378137.0, 1 / 298.257222101, 0.9996
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)
M_PER_LON, M_PER_LAT = 111320.0, 110540.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def tile_fraction(lon, lat, z) -> tuple[Column, Column]:  # noqa: ANN001
    """Tile coordinates with fractions."""
    n = F.pow(F.lit(2.0), _c(z))
    r = F.radians(_c(lat))
    return (_c(lon) + 180) / 360 * n, (1 - F.asinh(F.tan(r)) / math.pi) / 2 * n


def tile_fraction_secant(lon, lat, z) -> tuple[Column, Column]:  # noqa: ANN001
    """The same by the logarithm of tangent plus secant."""
    n = F.pow(F.lit(2.0), _c(z))
    r = F.radians(_c(lat))
    return (_c(lon) + 180) / 360 * n, (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n


def tile_xy(lon, lat, z, clamp: bool = True) -> tuple[Column, Column]:  # noqa: ANN001
    """Tile x, y; clamped to the square if asked."""
    x, y = (F.floor(v) for v in tile_fraction(lon, lat, z))
    if clamp:
        last = F.pow(F.lit(2.0), _c(z)).cast("bigint") - 1
        x, y = (F.least(F.greatest(v, F.lit(0).cast("bigint")), last) for v in (x, y))
    return x, y


def pixel_in_tile(fraction: Column, size: int = 256) -> Column:
    return F.floor((fraction - F.floor(fraction)) * size)


def flip_row(y, z) -> Column:  # noqa: ANN001
    """Row counted from the other end."""
    return F.pow(F.lit(2.0), _c(z)).cast("bigint") - 1 - _c(y)


def mercator_to_lonlat(x, y) -> tuple[Column, Column]:  # noqa: ANN001
    return _c(x) / EARTH * 180, F.degrees(2 * F.atan(F.exp(_c(y) / EARTH * math.pi)) - math.pi / 2)


def lonlat_to_mercator(lon, lat) -> tuple[Column, Column]:  # noqa: ANN001
    return _c(lon) / 180 * EARTH, F.asinh(F.tan(F.radians(_c(lat)))) / math.pi * EARTH


def tile_metres(z) -> Column:  # noqa: ANN001
    return 2 * EARTH / F.pow(F.lit(2.0), _c(z))


def pixel_metres(z, size: int = 256) -> Column:  # noqa: ANN001
    return tile_metres(z) / size


def tile_range(x0, y0, x1, y1, z) -> tuple[Column, Column, Column, Column]:  # noqa: ANN001
    """First and last tile column and row of a Mercator extent; its far edges are open."""
    m = tile_metres(z)
    return (
        F.floor((_c(x0) + EARTH) / m), F.floor((_c(x1) - 1e-6 + EARTH) / m),
        F.floor((EARTH - (_c(y1) - 1e-6)) / m), F.floor((EARTH - _c(y0)) / m),
    )


def tile_bounds(x, y, z) -> tuple[Column, Column, Column, Column]:  # noqa: ANN001
    """Mercator west, south, east, north of a tile."""
    m = tile_metres(z)
    return _c(x) * m - EARTH, EARTH - (_c(y) + 1) * m, (_c(x) + 1) * m - EARTH, EARTH - _c(y) * m


def _arc(phi: Column) -> Column:
    """Meridian arc from the equator."""
    e4, e6 = E2**2, E2**3
    return A * (
        (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )


def to_utm(lon, lat, meridian: float = 9.0) -> tuple[Column, Column]:  # noqa: ANN001
    """Easting and northing by the usual series (zone 32 by default)."""
    phi = F.radians(_c(lat))
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    t, c = F.pow(F.tan(phi), 2), EP2 * F.pow(F.cos(phi), 2)
    a = F.cos(phi) * F.radians(_c(lon) - meridian)
    east = K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * F.pow(a, 5) / 120) + 500000
    north = K0 * (
        _arc(phi)
        + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * F.pow(a, 6) / 720)
    )
    return east, north


def from_utm(east, north, meridian: float = 9.0) -> tuple[Column, Column]:  # noqa: ANN001
    """Longitude and latitude (in this order) of zone coordinates."""
    mu = _c(north) / K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    phi = (
        mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    s2 = 1 - E2 * F.pow(F.sin(phi), 2)
    n, r = A / F.sqrt(s2), A * (1 - E2) / F.pow(s2, 1.5)
    t, c = F.pow(F.tan(phi), 2), EP2 * F.pow(F.cos(phi), 2)
    d = (_c(east) - 500000) / (n * K0)
    lat = phi - n * F.tan(phi) / r * (
        d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * F.pow(d, 4) / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * F.pow(d, 6) / 720
    )
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(phi)
    return F.degrees(lon) + meridian, F.degrees(lat)


def km_tile(east, north) -> tuple[Column, Column]:  # noqa: ANN001
    return F.floor(_c(east) / 1000), F.floor(_c(north) / 1000)


def flat_distance(lon1, lat1, lon2, lat2) -> Column:  # noqa: ANN001
    """Metres on a plane at the first point's latitude."""
    return F.hypot((_c(lon2) - _c(lon1)) * M_PER_LON * F.cos(F.radians(_c(lat1))), (_c(lat2) - _c(lat1)) * M_PER_LAT)


def between_points(a, b, t) -> Column:  # noqa: ANN001
    """Linear interpolation from a to b."""
    return _c(a) + (_c(b) - _c(a)) * _c(t)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of (x, y) structs."""
    n = F.size(ring)
    crossed = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            ((F.get(ring, i)["y"] > py) != (F.get(ring, F.pmod(i + 1, n))["y"] > py))
            & (
                px
                < (F.get(ring, F.pmod(i + 1, n))["x"] - F.get(ring, i)["x"]) * (py - F.get(ring, i)["y"]) / (F.get(ring, F.pmod(i + 1, n))["y"] - F.get(ring, i)["y"])
                + F.get(ring, i)["x"]
            ),
            1,
        ).otherwise(0),
    )
    return F.when(n < 3, F.lit(False)).otherwise(crossed % 2 == 1)


def segment_distance(px, py, ax, ay, bx, by) -> Column:  # noqa: ANN001
    """Distance of a point from a line segment."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    d2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(d2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d2)))
    return F.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def encode_height(h) -> tuple[Column, Column, Column]:  # noqa: ANN001
    """Height in metres as the red, green and blue byte of the terrain encoding."""
    v = F.least(F.greatest(_c(h).cast("double") + 32768, F.lit(0.0)), F.lit(65535.996))
    w = F.floor(v)
    return F.floor(w / 256).cast("int"), F.pmod(w, F.lit(256)).cast("int"), F.floor((v - w) * 256).cast("int")


def decode_height(r, g, b) -> Column:  # noqa: ANN001
    return _c(r) * 256 + _c(g) + _c(b) / 256 - 32768


def close_ring(ring: Column) -> Column:
    """The ring with its first point at the end too."""
    return F.when((F.size(ring) > 0) & (F.element_at(ring, 1) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def triples(numbers: Column) -> Column:
    """Flat numbers as (x, y, z) points; null unless at least four whole points of numbers."""
    n = F.size(numbers)
    ok = (n >= 12) & (n % 3 == 0) & F.forall(numbers, lambda v: v.isNotNull())
    at = lambda i, k: F.get(numbers, i + k)
    points = F.transform(F.sequence(F.lit(0), n - 3, F.lit(3)), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("z")))
    return F.when(ok, points)


def ceil_div(n, k) -> Column:  # noqa: ANN001
    return F.ceil(_c(n) / _c(k))


def retry_delay(code, attempt) -> Column:  # noqa: ANN001
    """Seconds to wait after an HTTP code (null: network error); null if it is not retried."""
    c, p = _c(code), F.pow(F.lit(2.0), _c(attempt))
    return F.when(c.isNull(), p).when(c == 429, 10 * p).when(c.isin(500, 502, 503, 504), 2 * p)
