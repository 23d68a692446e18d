"""Map projections of the WGS84 ellipsoid as column expressions: transverse Mercator (UTM) and Albers' conic.

Angles are degrees, lengths metres. Series run to the fourth power of the third flattening, so forward and inverse
agree within a tenth of a millimetre in and around a zone. NULL in any argument gives NULL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EAST = 500000.0
FALSE_NORTH_SOUTH = 10000000.0

E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
N = FLATTENING / (2 - FLATTENING)

# Coefficients of N, N^2, N^3, N^4 in the sine series between latitudes and grid coordinates.
TO_GRID = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
FROM_GRID = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
FROM_CONFORMAL = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
FROM_AUTHALIC = ((4 / 3, 4 / 45, -16 / 35, -2582 / 14175), (0, 46 / 45, 152 / 945, -11966 / 14175), (0, 0, 3044 / 2835, 3802 / 14175), (0, 0, 0, 6059 / 4725))


def series(rows) -> list[float]:
    return [sum(c * N ** (p + 1) for p, c in enumerate(row)) for row in rows]


#: Radius of the sphere whose meridian is as long as the ellipsoid's.
RECTIFYING = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA, BETA, DELTA, AUTHALIC = (series(s) for s in (TO_GRID, FROM_GRID, FROM_CONFORMAL, FROM_AUTHALIC))


def _total(terms) -> Column:
    out = None
    for t in terms:
        out = t if out is None else out + t
    return out


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60 of a longitude; 180 degrees belongs to zone 1, the exceptions around Norway are not applied."""
    return (F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1).cast("int")


def _central(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def utm_forward(lon: Column, lat: Column, zone: Column, south: Column | bool = False) -> tuple[Column, Column]:
    """(easting, northing) in a zone; ``south`` puts the false northing of the southern grid on top."""
    s, l = F.sin(F.radians(lat)), F.radians(lon - _central(zone))
    t = F.sinh(F.atanh(s) - E * F.atanh(E * s))
    xi, eta = F.atan2(t, F.cos(l)), F.atanh(F.sin(l) / F.sqrt(1.0 + t * t))
    terms = [(a, 2.0 * (j + 1)) for j, a in enumerate(ALPHA)]
    east = eta + _total(a * F.cos(k * xi) * F.sinh(k * eta) for a, k in terms)
    north = xi + _total(a * F.sin(k * xi) * F.cosh(k * eta) for a, k in terms)
    return UTM_SCALE * RECTIFYING * east + FALSE_EAST, UTM_SCALE * RECTIFYING * north + _false_north(south)


def utm_inverse(east: Column, north: Column, zone: Column, south: Column | bool = False) -> tuple[Column, Column]:
    """(longitude, latitude) of a place in a zone."""
    xi, eta = (north - _false_north(south)) / (UTM_SCALE * RECTIFYING), (east - FALSE_EAST) / (UTM_SCALE * RECTIFYING)
    terms = [(b, 2.0 * (j + 1)) for j, b in enumerate(BETA)]
    x = xi - _total(b * F.sin(k * xi) * F.cosh(k * eta) for b, k in terms)
    y = eta - _total(b * F.cos(k * xi) * F.sinh(k * eta) for b, k in terms)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + _total(d * F.sin(2.0 * (j + 1) * chi) for j, d in enumerate(DELTA))
    return _central(zone) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def _false_north(south: Column | bool) -> Column:
    flag = south if isinstance(south, Column) else F.lit(bool(south))
    return F.when(flag, FALSE_NORTH_SOUTH).otherwise(0.0)


@dataclass(frozen=True)
class Albers:
    """Equal-area conic with two standard parallels (degrees) and an origin.

    The parallels must not lie opposite each other about the equator, where the cone becomes a cylinder.
    """

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    east0: float = 0.0
    north0: float = 0.0

    @staticmethod
    def _q(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - E2) * (s / (1 - E2 * s * s) + math.atanh(E * s) / E)

    @property
    def cone(self) -> tuple[float, float, float]:
        """Cone constant, the constant of the radius, and the radius at the origin."""
        m = lambda lat: math.cos(math.radians(lat)) / math.sqrt(1 - E2 * math.sin(math.radians(lat)) ** 2)
        m1, m2, q1, q2 = m(self.lat1), m(self.lat2), self._q(self.lat1), self._q(self.lat2)
        n = math.sin(math.radians(self.lat1)) if self.lat1 == self.lat2 else (m1 * m1 - m2 * m2) / (q2 - q1)
        if abs(n) < 1e-12:
            raise ValueError("standard parallels must not be opposite about the equator")
        c = m1 * m1 + n * q1
        return n, c, SEMI_MAJOR * math.sqrt(c - n * self._q(self.lat0)) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, r0 = self.cone
        s = F.sin(F.radians(lat))
        q = (1 - E2) * (s / (1.0 - E2 * s * s) + F.atanh(E * s) / E)
        r = SEMI_MAJOR / n * F.sqrt(F.greatest(c - n * q, F.lit(0.0)))
        turn = n * F.radians(lon - self.lon0)
        return r * F.sin(turn) + self.east0, r0 - r * F.cos(turn) + self.north0

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        n, c, r0 = self.cone
        x, y = east - self.east0, r0 - (north - self.north0)
        side = math.copysign(1.0, n)
        turn = F.atan2(side * x, side * y)
        q = (c - (x * x + y * y) * (n / SEMI_MAJOR) ** 2) / n
        xi = F.asin(F.least(F.greatest(q / self._q(90.0 - 1e-12), F.lit(-1.0)), F.lit(1.0)))
        lat = xi + _total(a * F.sin(2.0 * (j + 1) * xi) for j, a in enumerate(AUTHALIC))
        return self.lon0 + F.degrees(turn / n), F.degrees(lat)


def parse_crs(code: str) -> tuple[int, bool]:
    """(zone, south) of an ``EPSG:326zz`` or ``EPSG:327zz`` code."""
    head, _, number = code.strip().upper().partition(":")
    if head == "EPSG" and len(number) == 5 and number.isdigit() and number[:3] in ("326", "327") and 1 <= int(number[3:]) <= 60:
        return int(number[3:]), number[:3] == "327"
    raise ValueError(f"not a UTM code: {code}")
