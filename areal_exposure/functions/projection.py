"""Equal-area conic projection (Albers) on the ellipsoid, both ways, as column arithmetic.

Forward and inverse follow Snyder, "Map projections: a working manual" (1987), section 14.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from areal_exposure import constants as K


@dataclass(frozen=True)
class Albers:
    """An Albers grid; the default is the California one. Angles in degrees, lengths in metres."""

    parallels: tuple[float, float] = K.ALBERS_STANDARD_PARALLELS
    origin: tuple[float, float] = K.ALBERS_ORIGIN
    offset: tuple[float, float] = K.ALBERS_FALSE_EASTING_NORTHING
    semi_major: float = K.GRS80_SEMI_MAJOR
    inverse_flattening: float = K.GRS80_INVERSE_FLATTENING

    @property
    def _e(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    def _q_of(self, phi: float) -> float:
        e, s = self._e, math.sin(phi)
        return (1 - e * e) * (s / (1 - e * e * s * s) + math.atanh(e * s) / e)

    @property
    def _cone(self) -> tuple[float, float, float]:
        """Cone constant n, constant C, and the radius of the origin parallel."""
        e = self._e
        p1, p2 = (math.radians(p) for p in self.parallels)
        m1, m2 = (math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2) for p in (p1, p2))
        q0, q1, q2 = (self._q_of(p) for p in (math.radians(self.origin[1]), p1, p2))
        n = (m1 * m1 - m2 * m2) / (q2 - q1)
        c = m1 * m1 + n * q1
        return n, c, self.semi_major * math.sqrt(c - n * q0) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e = self._e
        n, c, rho0 = self._cone
        s = F.sin(F.radians(lat))
        q = (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(s * e) / e)
        rho = F.sqrt(c - q * n) * (self.semi_major / n)
        theta = F.radians(lon - self.origin[0]) * n
        return rho * F.sin(theta) + self.offset[0], rho0 - rho * F.cos(theta) + self.offset[1]

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Latitude from the authalic series and one Newton step, good to rounding."""
        e2 = self._e**2
        n, c, rho0 = self._cone
        dx, dy = x - self.offset[0], F.lit(rho0) - (y - self.offset[1])
        q = (c - (dx * dx + dy * dy) * (n * n / self.semi_major**2)) / n
        beta = F.asin(q / self._q_of(math.pi / 2))
        phi = (
            beta
            + F.sin(beta * 2) * (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040)
            + F.sin(beta * 4) * (23 * e2**2 / 360 + 251 * e2**3 / 3780)
            + F.sin(beta * 6) * (761 * e2**3 / 45360)
        )
        s = F.sin(phi)
        bend = 1 - s * s * e2
        phi = phi + bend * bend / (F.cos(phi) * 2) * (q / (1 - e2) - s / bend - F.atanh(s * self._e) / self._e)
        return F.degrees(F.atan2(dx, dy) / n) + self.origin[0], F.degrees(phi)


CALIFORNIA = Albers()

#: Nodes and weights of Gauss and Legendre on [0, 1], five of them: exact for polynomials of degree nine.
_NODES = [(0.5, 64 / 225)] + [
    (0.5 + sign * math.sqrt(5 + k * 2 * math.sqrt(10 / 7)) / 6, (322 - k * 13 * math.sqrt(70)) / 1800) for k in (-1, 1) for sign in (-1, 1)
]


def ellipsoid_area(geom: Column, datum: Albers = CALIFORNIA) -> Column:
    """Area in square metres of a polygon in degrees of longitude and latitude, on the datum's ellipsoid itself.

    The integral of the authalic latitude along each side, which is a straight line in degrees; signed by ring as
    :func:`~areal_exposure.functions.geometry.area`. A side takes the short way round, so rings may cross the date
    line; a ring round a pole is not known. Exact for sides along meridians and parallels, to 1e-9 for slanting
    sides of a degree. Null for null, 0 for no rings.
    """
    e, half_square = datum._e, datum.semi_major**2 / 2

    def side(p: Column, q: Column) -> Column:
        turn = q["x"] - p["x"]
        short = turn - F.round(turn / 360) * 360

        def weighed(t: float, w: float) -> Column:
            s = F.sin(F.radians(p["y"] + (q["y"] - p["y"]) * t))
            return (s / (1 - s * s * e * e) + F.atanh(s * e) / e) * (w * (1 - e * e))

        return F.radians(short) * sum((weighed(t, w) for t, w in _NODES[1:]), weighed(*_NODES[0])) * -half_square

    def ring(r: Column) -> Column:
        return F.aggregate(F.transform(r, lambda p, i: side(p, F.get(r, (i + 1) % F.size(r)))), F.lit(0.0), lambda s, v: s + v)

    return F.aggregate(F.transform(geom, ring), F.lit(0.0), lambda s, v: s + v)


def map_points(geom: Column, move: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Apply a point function, such as ``CALIFORNIA.forward``, to every vertex of a polygon."""

    def vertex(p: Column) -> Column:
        x, y = move(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(geom, lambda ring: F.transform(ring, vertex))
