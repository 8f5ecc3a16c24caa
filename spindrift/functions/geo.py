"""Column functions of spherical and projected geometry. Angles are degrees, distances km unless said otherwise."""

from __future__ import annotations

from dataclasses import dataclass
from math import atanh, cos, log, pi, radians, sin, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371.0
MAX_SPEED = 0.45  # m/s


def haversine(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle distance in km."""
    p0, p1 = F.radians(lat0), F.radians(lat1)
    dp, dl = F.radians(lat1 - lat0) / 2, F.radians(lon1 - lon0) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(p0) * F.cos(p1) * F.sin(dl) * F.sin(dl)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Direction plus half a turn, in [0, 360]: the convention of the displacement products."""
    p0, p1, dl = F.radians(lat0), F.radians(lat1), F.radians(lon1 - lon0)
    return F.degrees(F.lit(pi) + F.atan2(F.sin(dl) * F.cos(p1), F.cos(p0) * F.sin(p1) - F.sin(p0) * F.cos(p1) * F.cos(dl)))


def wrap360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def wrap180(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360.0).otherwise(lon)


def wrap_any(lon: Column) -> Column:
    """Any longitude into [-180, 180)."""
    return ((lon + 180.0) % 360.0 + 360.0) % 360.0 - 180.0


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    b: float

    @property
    def e(self) -> float:
        return sqrt(1 - (self.b / self.a) ** 2)


WGS84 = Ellipsoid(6378137.0, 6356752.314245179)
HUGHES = Ellipsoid(6378273.0, 6356889.44891)
GRS80 = Ellipsoid(6378137.0, 6356752.314140356)


def _geodetic(chi: Column, e2: float) -> Column:
    """Latitude of a conformal latitude, both in radians (Snyder 1987, 3-5)."""
    return (
        chi
        + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) * F.sin(2 * chi)
        + (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) * F.sin(4 * chi)
        + (7 * e2**3 / 120 + 81 * e2**4 / 1120) * F.sin(6 * chi)
        + 4279 * e2**4 / 161280 * F.sin(8 * chi)
    )


@dataclass(frozen=True)
class Laea:
    """Lambert azimuthal equal area at a pole (Snyder 1987, 24): metres."""

    north: bool = True
    lon0: float = 0.0
    ellipsoid: Ellipsoid = WGS84

    @property
    def pole(self) -> float:
        e = self.ellipsoid.e
        return 1 + (1 - e * e) / e * atanh(e)

    def authalic(self, lat: Column) -> Column:
        e = self.ellipsoid.e
        s = F.sin(F.radians(lat))
        return F.lit(1 - e * e) * (s / (1 - e * e * s * s) - F.lit(1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        side = 1.0 if self.north else -1.0
        rho = F.lit(self.ellipsoid.a) * F.sqrt(F.greatest(F.lit(self.pole) - side * self.authalic(lat), F.lit(0.0)))
        turn = F.radians(lon - self.lon0)
        return rho * F.sin(turn), -side * rho * F.cos(turn)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        side, e2 = (1.0 if self.north else -1.0), self.ellipsoid.e**2
        ratio = 1 - (x * x + y * y) / (self.ellipsoid.a**2 * self.pole)
        beta = side * F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
        lat = (
            beta
            + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta)
            + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta)
            + 761 * e2**3 / 45360 * F.sin(6 * beta)
        )
        return F.degrees(lat), wrap_any(F.degrees(F.atan2(x, -side * y)) + self.lon0)


@dataclass(frozen=True)
class Stere:
    """Polar stereographic with a latitude of true scale (Snyder 1987, 21): metres."""

    north: bool = True
    lon0: float = -45.0
    lat_ts: float = 70.0
    ellipsoid: Ellipsoid = HUGHES

    @property
    def scale(self) -> float:
        e, p = self.ellipsoid.e, radians(self.lat_ts)
        t = tan(pi / 4 - p / 2) / ((1 - e * sin(p)) / (1 + e * sin(p))) ** (e / 2)
        return self.ellipsoid.a * cos(p) / sqrt(1 - (e * sin(p)) ** 2) / t

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        e, side = self.ellipsoid.e, (1.0 if self.north else -1.0)
        p = F.radians(side * lat)
        s = e * F.sin(p)
        rho = F.lit(self.scale) * F.tan(F.lit(pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
        turn = F.radians(side * (lon - self.lon0))
        return side * rho * F.sin(turn), -side * rho * F.cos(turn)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        e2, side = self.ellipsoid.e**2, (1.0 if self.north else -1.0)
        chi = F.lit(pi / 2) - 2 * F.atan(F.sqrt(x * x + y * y) / self.scale)
        return F.degrees(side * _geodetic(chi, e2)), wrap_any(side * F.degrees(F.atan2(side * x, -side * y)) + self.lon0)


@dataclass(frozen=True)
class Lcc:
    """Lambert conformal conic with two standard parallels (Snyder 1987, 15), the origin on the equator or north of it: metres."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    x0: float = 0.0
    y0: float = 0.0
    ellipsoid: Ellipsoid = GRS80

    def _constants(self) -> tuple[float, float, float]:
        """The cone's constant, the radius where t is 1, and the origin's radius."""
        e = self.ellipsoid.e
        t = lambda p: tan(pi / 4 - p / 2) / ((1 - e * sin(p)) / (1 + e * sin(p))) ** (e / 2)
        m = lambda p: cos(p) / sqrt(1 - (e * sin(p)) ** 2)
        p1, p2 = radians(self.lat1), radians(self.lat2)
        n = log(m(p1) / m(p2)) / log(t(p1) / t(p2))
        unit = self.ellipsoid.a * m(p1) / (n * t(p1) ** n)
        return n, unit, unit * t(radians(self.lat0)) ** n

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        n, unit, rho0 = self._constants()
        e, p = self.ellipsoid.e, F.radians(lat)
        s = e * F.sin(p)
        rho = unit * F.pow(F.tan(F.lit(pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2)), F.lit(n))
        turn = n * F.radians(wrap_any(lon - self.lon0))
        return rho * F.sin(turn) + self.x0, rho0 - rho * F.cos(turn) + self.y0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, unit, rho0 = self._constants()
        east, north = x - self.x0, rho0 - (y - self.y0)
        chi = F.lit(pi / 2) - 2 * F.atan(F.pow(F.sqrt(east * east + north * north) / unit, F.lit(1 / n)))
        return F.degrees(_geodetic(chi, self.ellipsoid.e**2)), wrap_any(F.degrees(F.atan2(east, north) / n) + self.lon0)


def to_cell(x: Column, y: Column, bx: float, ax: float, by: float, ay: float) -> tuple[Column, Column]:
    """Fractional grid place of projected metres; grid parameters in km, rows run downwards."""
    return (x / 1000 - bx) / ax, -(y / 1000 - by) / ay


def truncate(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def round_significant(x: Column, digits: int) -> Column:
    """Rounded to so many significant figures; zero stays zero."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * power) / power)


def max_drift_km(days: Column) -> Column:
    return F.greatest(days.cast("double"), F.lit(1.0)) * (MAX_SPEED * 86400 / 1000)


def sigmoid(x: Column, limit: Column, power: float = 10.0) -> Column:
    """Weight that falls from one to zero at the limit; the exponent is kept from overflowing."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), (x - limit) * power))))


def corners(x: Column, y: Column) -> Column:
    """The four grid points around a place, as an array of (cx, cy, weight)."""
    fx, fy = F.floor(x), F.floor(y)
    wx, wy = x - fx, y - fy
    corner = lambda dx, dy, w: F.struct((fx + dx).cast("bigint").alias("cx"), (fy + dy).cast("bigint").alias("cy"), w.alias("weight"))
    return F.array(corner(0, 0, (1 - wx) * (1 - wy)), corner(1, 0, wx * (1 - wy)), corner(0, 1, (1 - wx) * wy), corner(1, 1, wx * wy))


