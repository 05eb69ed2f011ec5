"""Column functions on pixels: spectral indices, backscatter, embeddings, dates, geographic cells, UTM."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-6


def known(x: Column) -> Column:
    """NaN to NULL: in Spark a NaN is larger than any number and spoils aggregates, a NULL is left out."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """What enters a feature row: NULL, NaN and infinities become 0."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(0.0)


def reflectance(dn: Column) -> Column:
    return dn / F.lit(10000.0)


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); 0 where the sum is not positive or an input is missing."""
    total = known(a) + known(b)
    return F.when(total > 0, (a - b) / F.greatest(total, F.lit(TINY))).otherwise(0.0)


def ndvi(b08="b08", b04="b04") -> Column:
    return normalized_difference(F.col(b08), F.col(b04))


def ndmi(b08="b08", b11="b11") -> Column:
    return normalized_difference(F.col(b08), F.col(b11))


def decibel(power: Column) -> Column:
    """10 log10 of positive power, else NULL."""
    return F.when(known(power) > 0, 10 * F.log10(power))


# ---- embeddings -------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b| + 1e-6): a zero vector is at distance 1."""
    return 1 - dot(a, b) / (norm(a) * norm(b) + F.lit(TINY))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


# ---- dates ------------------------------------------------------------------------------------------------------


def yymm(unix_days: Column) -> Column:
    """YYMM of days since 1970, 0 for none; years are clipped to 1970 ... 2100."""
    d = F.date_from_unix_date(unix_days.cast("int"))
    y = F.least(F.greatest(F.year(d), F.lit(1970)), F.lit(2100))
    return F.when(unix_days > 0, y % 100 * 100 + F.month(d)).otherwise(0).cast("int")


def region(tile_id: Column, n: int = 5) -> Column:
    return F.substring(tile_id, 1, n)


# ---- geographic cells -------------------------------------------------------------------------------------------


def dem_cell(lat: Column, lon: Column) -> Column:
    """The name of the 1-degree elevation tile with its south-west corner at (lat, lon)."""
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.format_string("Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM", ns, F.abs(lat).cast("int"), ew, F.abs(lon).cast("int"))


def cells_between(lo: Column, hi: Column) -> Column:
    """The whole degrees that an interval touches; an upper bound that is itself whole doesn't count."""
    a = F.floor(lo)
    b = F.when(hi > a + 1, F.floor(hi - F.lit(1e-9))).otherwise(a)
    return F.sequence(a.cast("int"), b.cast("int"))


# ---- UTM --------------------------------------------------------------------------------------------------------

#: WGS84 and the UTM projection.
A, FLAT, SCALE, EAST0, NORTH0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


class _Columns:
    sin, cos, sinh, cosh, asin, atan2, atanh, sqrt = map(staticmethod, (F.sin, F.cos, F.sinh, F.cosh, F.asin, F.atan2, F.atanh, F.sqrt))


class Numbers:
    """The same functions of numpy arrays."""

    sin, cos, sinh, cosh, asin, atan2, atanh, sqrt = map(staticmethod, (np.sin, np.cos, np.sinh, np.cosh, np.arcsin, np.arctan2, np.arctanh, np.sqrt))


def _named(values, f):
    return f(*values)


def bound(values, f):
    """f of Columns that are computed once, as an array: lambdas of array functions aren't compiled, and there a Column is computed again at each place of its use."""
    made = lambda s: (lambda got: F.array(*got) if isinstance(got, tuple) else got)(f(*[s[f"v{i}"] for i in range(len(values))]))
    return F.get(F.transform(F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])), made), F.lit(0))


def utm_to_lonlat(east, north, zone, south=False, ops=_Columns, let=_named):
    """Longitude and latitude in degrees, by the third-order series of the transverse Mercator projection (under a millimetre in zone).

    ops: where sin, cos and so on come from: Columns by default, or numpy / math for numbers. let: bound, inside a lambda; the result is an array then."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (north - (NORTH0 if south else 0.0)) / (SCALE * radius)
    eta = (east - EAST0) / (SCALE * radius)

    def sphere(xi, eta):
        x, y = xi, eta
        for k, b in enumerate(beta, 1):
            x = x - b * ops.sin(2 * k * xi) * ops.cosh(2 * k * eta)
            y = y - b * ops.cos(2 * k * xi) * ops.sinh(2 * k * eta)
        return let((x, y), conformal)

    def conformal(x, y):
        return let((ops.asin(ops.sin(x) / ops.cosh(y)), ops.atan2(ops.sinh(y), ops.cos(x))), degrees)

    def degrees(chi, lon):
        lat = chi
        for k, d in enumerate(delta, 1):
            lat = lat + d * ops.sin(2 * k * chi)
        return zone * 6 - 183 + lon * (180 / math.pi), lat * (180 / math.pi)

    return let((xi, eta), sphere)


def lonlat_to_utm(lon, lat, zone, south=False, ops=_Columns, let=_named):
    """East and north in metres: the forward direction of the same series. let: as there."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, away = lat * (math.pi / 180), (lon - (zone * 6 - 183)) * (math.pi / 180)
    t = ops.sinh(ops.atanh(ops.sin(phi)) - e * ops.atanh(e * ops.sin(phi)))

    def sphere(t, away):
        return let((ops.atan2(t, ops.cos(away)), ops.atanh(ops.sin(away) / ops.sqrt(1 + t * t))), plane)

    def plane(xi, eta):
        x, y = eta, xi
        for k, a in enumerate(alpha, 1):
            x = x + a * ops.cos(2 * k * xi) * ops.sinh(2 * k * eta)
            y = y + a * ops.sin(2 * k * xi) * ops.cosh(2 * k * eta)
        return EAST0 + SCALE * radius * x, SCALE * radius * y + (NORTH0 if south else 0.0)

    return let((t, away), sphere)


# ---- reference systems ------------------------------------------------------------------------------------------

#: EPSG codes of longitude and latitude on WGS84, and of its UTM zones north (32601 ...) and south (32701 ...).
LONLAT, UTM_NORTH, UTM_SOUTH = 4326, 32600, 32700


def moved(x: np.ndarray, y: np.ndarray, source: int | None, target: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates brought from one system to another; systems other than the above, or none, keep them."""
    utm = lambda c: UTM_NORTH < c <= UTM_SOUTH + 60
    if source is None or target is None or source == target or not all(utm(c) or c == LONLAT for c in (source, target)):
        return x, y
    lon, lat = utm_to_lonlat(x, y, source % 100, source > UTM_SOUTH, Numbers) if utm(source) else (x, y)
    return lonlat_to_utm(lon, lat, target % 100, target > UTM_SOUTH, Numbers) if utm(target) else (lon, lat)


def reproject(df: DataFrame, x: str, y: str, source: Column, target: Column) -> DataFrame:
    """df with the coordinates in columns x and y brought from one system to another; source and target are EPSG codes as columns. Others than the above keep
    their coordinates.

    Both series in one go repeat their terms too often for a column expression, so batches of coordinates go through numpy."""

    def move(xs: pd.Series, ys: pd.Series, sources: pd.Series, targets: pd.Series) -> pd.DataFrame:
        u, v = xs.to_numpy(float).copy(), ys.to_numpy(float).copy()
        for a, b in set(zip(sources, targets)):
            at = ((sources == a) & (targets == b)).to_numpy()
            u[at], v[at] = moved(u[at], v[at], a, b)
        return pd.DataFrame({"u": u, "v": v})

    at = F.pandas_udf(move, "u double, v double")(F.col(x), F.col(y), source.cast("int"), target.cast("int"))
    return df.withColumn("_moved", at).withColumns({x: F.col("_moved.u"), y: F.col("_moved.v")}).drop("_moved")
