"""Ellipsoidal map projections as column expressions: Albers equal-area, Lambert conformal conic, transverse Mercator.

Angles are degrees. Series and Newton steps have a fixed length, so forward and inverse are plain expressions; the inverse
undoes the forward to well below a micrometre inside a projection's area of use. Each value that is used more than once is
a step of its own, so the expressions stay small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Semi-major axis and inverse flattening of the ellipsoids, the US survey foot.
GRS80, CLARKE_1866, AIRY = (6378137.0, 298.257222101), (6378206.4, 294.978698214), (6377563.396, 299.3249646)
US_FOOT = 1200 / 3937


@dataclass(frozen=True)
class Projection:
    """kind albers, lambert or mercator; parallels of the conics; scale of the transverse Mercator; metres in a unit."""

    kind: str
    lon0: float
    lat0: float
    parallels: tuple[float, float] = (0.0, 0.0)
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    unit: float = 1.0
    ellipsoid: tuple[float, float] = GRS80

    @property
    def e2(self) -> float:
        f = 1 / self.ellipsoid[1]
        return f * (2 - f)


def crs(epsg: int) -> Projection:
    """The systems that model projects use: 5070 (conterminous Albers), 2276-2279 (Texas north central to south, feet), and the
    UTM zones of the northern half (269zz, 326zz)."""
    if epsg == 5070:
        return Projection("albers", -96.0, 23.0, (29.5, 45.5))
    # Origin, parallels and false easting and northing in metres of the Texas zones.
    texas = {
        2276: (-98.5, 31 + 40 / 60, (32 + 8 / 60, 33 + 58 / 60), 600_000.0, 2_000_000.0),
        2277: (-100 - 20 / 60, 29 + 40 / 60, (30 + 7 / 60, 31 + 53 / 60), 700_000.0, 3_000_000.0),
        2278: (-99.0, 27 + 50 / 60, (28 + 23 / 60, 30 + 17 / 60), 600_000.0, 4_000_000.0),
        2279: (-98.5, 25 + 40 / 60, (26 + 10 / 60, 27 + 50 / 60), 300_000.0, 5_000_000.0),
    }
    if epsg in texas:
        lon, lat, parallels, east, north = texas[epsg]
        return Projection("lambert", lon, lat, parallels, east=east, north=north, unit=US_FOOT)
    if epsg // 100 in (269, 326) and 1 <= epsg % 100 <= 60:
        return Projection("mercator", 6.0 * (epsg % 100) - 183, 0.0, scale=0.9996, east=500_000.0)
    raise ValueError(f"no projection for EPSG:{epsg}")


class _Steps:
    """Columns added one after another to a table; calling it with an expression gives the new column."""

    def __init__(self, df: DataFrame):
        self.df, self.names = df, df.columns

    def __call__(self, value: Column) -> Column:
        name = f"_step{len(self.df.columns)}"
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def done(self, **out: Column) -> DataFrame:
        return self.df.withColumns(out).select(*dict.fromkeys([*self.names, *out]))


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def _conformal(let: _Steps, tau: Column, e2: float) -> Column:
    """Tangent of the conformal latitude from that of the latitude."""
    e = math.sqrt(e2)
    root = let(F.sqrt(1 + tau * tau))
    ratio = let(e * tau / root)
    sigma = let(F.sinh(e * _atanh(ratio)))
    return let(tau * F.sqrt(1 + sigma * sigma) - sigma * root)


def _geodetic(let: _Steps, tau1: Column, e2: float) -> Column:
    """The inverse of _conformal, by three Newton steps."""
    tau = let(tau1 / (1 - e2))
    for _ in range(3):
        at = _conformal(let, tau, e2)
        tau = let(tau + (tau1 - at) / F.sqrt(1 + at * at) * (1 + (1 - e2) * tau * tau) / ((1 - e2) * F.sqrt(1 + tau * tau)))
    return tau


def _authalic(s, e2: float, log=F.log):
    """q of the equal-area latitude from the sine of the latitude."""
    e = math.sqrt(e2)
    return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))


def _radius(s: float, c: float, e2: float) -> float:
    return c / math.sqrt(1 - e2 * s * s)


def _albers(p: Projection) -> tuple[float, float, float]:
    (s1, c1), (s2, c2) = ((math.sin(math.radians(v)), math.cos(math.radians(v))) for v in p.parallels)
    m1, m2 = _radius(s1, c1, p.e2), _radius(s2, c2, p.e2)
    q = lambda v: _authalic(v, p.e2, math.log)
    n = (m1 * m1 - m2 * m2) / (q(s2) - q(s1)) if s1 != s2 else s1
    c = m1 * m1 + n * q(s1)
    return n, c, p.ellipsoid[0] * math.sqrt(c - n * q(math.sin(math.radians(p.lat0)))) / n


def _lambert(p: Projection) -> tuple[float, float, float]:
    """n, radius at the equator's t = 1, radius at the origin."""
    e = math.sqrt(p.e2)

    def t(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    m = [_radius(math.sin(math.radians(v)), math.cos(math.radians(v)), p.e2) for v in p.parallels]
    n = math.log(m[0] / m[1]) / math.log(t(p.parallels[0]) / t(p.parallels[1])) if m[0] != m[1] else math.sin(math.radians(p.parallels[0]))
    f = p.ellipsoid[0] * m[0] / (n * t(p.parallels[0]) ** n)
    return n, f, f * t(p.lat0) ** n


def _krueger(p: Projection) -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the coefficients of the forward and inverse series in the third flattening, to its sixth power."""
    f = 1 / p.ellipsoid[1]
    n = f / (2 - f)
    radius = p.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    return radius, alpha, beta


def _meridian(p: Projection) -> float:
    """Northing of the origin's latitude on the central meridian, before the scale."""
    radius, alpha, _ = _krueger(p)
    t, e = math.tan(math.radians(p.lat0)), math.sqrt(p.e2)
    sigma = math.sinh(e * math.atanh(e * t / math.hypot(1, t)))
    xi = math.atan(t * math.hypot(1, sigma) - sigma * math.hypot(1, t))
    return radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha)))


def forward(df: DataFrame, p: Projection, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """df with x and y, in the projection's unit, of the degrees in lon and lat; null where either is null."""
    let = _Steps(df)
    turn = let(F.radians(F.pmod(F.col(lon) - p.lon0 + 180, F.lit(360.0)) - 180))
    if p.kind == "albers":
        n, c, rho0 = _albers(p)
        s = let(F.sin(F.radians(lat)))
        rho = let(p.ellipsoid[0] * F.sqrt(c - n * _authalic(s, p.e2)) / n)
        east, north = rho * F.sin(n * turn), rho0 - rho * F.cos(n * turn)
    elif p.kind == "lambert":
        n, f, rho0 = _lambert(p)
        tau1 = _conformal(let, let(F.tan(F.radians(lat))), p.e2)
        rho = let(f * F.pow(F.sqrt(1 + tau1 * tau1) - tau1, F.lit(n)))
        east, north = rho * F.sin(n * turn), rho0 - rho * F.cos(n * turn)
    else:
        radius, alpha, _ = _krueger(p)
        tau1 = _conformal(let, let(F.tan(F.radians(lat))), p.e2)
        xi, eta = let(F.atan2(tau1, F.cos(turn))), let(F.asinh(F.sin(turn) / F.sqrt(tau1 * tau1 + F.cos(turn) * F.cos(turn))))
        north, east = xi, eta
        for j, a in enumerate(alpha, 1):
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        east, north = p.scale * radius * east, p.scale * (radius * north - _meridian(p))
    return let.done(**{x: (east + p.east) / p.unit, y: (north + p.north) / p.unit})


def inverse(df: DataFrame, p: Projection, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with the degrees lon and lat of x and y; null where either is null."""
    let = _Steps(df)
    east, north = let(F.col(x) * p.unit - p.east), let(F.col(y) * p.unit - p.north)
    if p.kind == "mercator":
        radius, _, beta = _krueger(p)
        xi, eta = let((north / p.scale + _meridian(p)) / radius), let(east / (p.scale * radius))
        north, east = xi, eta
        for j, b in enumerate(beta, 1):
            north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north, east = let(north), let(east)
        tau1 = let(F.sin(north) / F.sqrt(F.sinh(east) * F.sinh(east) + F.cos(north) * F.cos(north)))
        return let.done(**{lon: p.lon0 + F.degrees(F.atan2(F.sinh(east), F.cos(north))), lat: F.degrees(F.atan(_geodetic(let, tau1, p.e2)))})
    n, size, rho0 = _albers(p) if p.kind == "albers" else _lambert(p)
    side = math.copysign(1, n)
    rho, turn = let(F.sqrt(east * east + (rho0 - north) * (rho0 - north))), F.atan2(side * east, side * (rho0 - north))
    degrees = p.lon0 + F.degrees(turn / n)
    if p.kind == "lambert":
        t = let(F.pow(rho / abs(size), F.lit(1 / n)))
        return let.done(**{lon: degrees, lat: F.degrees(F.atan(_geodetic(let, let((1 / t - t) / 2), p.e2)))})
    q = let((size - F.pow(rho * n / p.ellipsoid[0], F.lit(2))) / n)
    phi = let(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _authalic(1.0, p.e2, math.log)))))
    for _ in range(4):
        s = let(F.sin(phi))
        phi = let(phi + F.pow(1 - p.e2 * s * s, F.lit(2)) / (2 * (1 - p.e2) * F.cos(phi)) * (q - _authalic(s, p.e2)))
    return let.done(**{lon: degrees, lat: F.degrees(phi)})


def reproject(df: DataFrame, of: Projection, to: Projection, x: str = "x", y: str = "y") -> DataFrame:
    """df with x and y, coordinates of one projection, replaced by those of another."""
    names = df.columns
    return forward(inverse(df, of, x, y, "_lon", "_lat"), to, "_lon", "_lat", x, y).select(*names)
