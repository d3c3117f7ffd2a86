"""UTM (southern hemisphere) to degrees and back, by the Krueger series of sixth order.

Everything stays in JVM expressions; intermediate values are bound once by ``_let``.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.geometry import clean_datum, impute_zone
from umbral.functions.scalars import col

# ---- fixed values: ellipsoids (semi-major axis, inverse flattening) and UTM ------------------------
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "aust_SA": (6378160.0, 298.25)}
DATUM_ELLIPSOID = {"WGS84": "WGS84", "SAD69": "aust_SA"}
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
# Krueger series: row j holds the coefficients of n^j, n^(j+1), ..., n^6
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
# -----------------------------------------------------------------------------------------------


def _third_flattening(ellps: str) -> float:
    f = 1 / ELLIPSOIDS[ellps][1]
    return f / (2 - f)


def _series(table, ellps: str) -> list[float]:
    n = _third_flattening(ellps)
    return [sum(c * n ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(table, start=1)]


def _radius(ellps: str) -> float:
    n = _third_flattening(ellps)
    return ELLIPSOIDS[ellps][0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def _eccentricity(ellps: str) -> float:
    f = 1 / ELLIPSOIDS[ellps][1]
    return sqrt(f * (2 - f))


def _meridian(zone: Column) -> Column:
    return zone * 6 - 183


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Bind a value to a name inside an expression, so that it is computed once.

    Plain columns would not do: a filter on the result is pushed through them with every use written out.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _constants(ellps: Column) -> Column:
    """Ellipsoid constants of a row: ``e``, ``scale`` and the series ``f1..f6`` and ``i1..i6``."""
    out = None
    for name in ELLIPSOIDS:
        values = {"e": _eccentricity(name), "scale": K0 * _radius(name)}
        values |= {f"f{j}": v for j, v in enumerate(_series(FORWARD, name), start=1)}
        values |= {f"i{j}": v for j, v in enumerate(_series(INVERSE, name), start=1)}
        row = F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()])
        out = F.when(ellps == name, row) if out is None else out.when(ellps == name, row)
    return out


def _conformal(t: Column, e: Column) -> Column:
    """Tangent of the conformal latitude from the tangent of the latitude."""
    root = F.sqrt(1 + t * t)
    return _let(F.sinh(e * F.atanh(e * t / root)), lambda s: t * F.sqrt(1 + s * s) - s * root)


def _newton(t: Column, target: Column, e: Column) -> Column:
    """One step towards the latitude whose conformal tangent is ``target``."""
    slope = (1 + (1 - e * e) * t * t) / ((1 - e * e) * F.sqrt(1 + t * t))
    return _let(_conformal(t, e), lambda g: t + (target - g) / F.sqrt(1 + g * g) * slope)


def utm_inverse(x: Column, y: Column, zone: Column, ellps: Column) -> Column:
    """``struct<lon,lat>`` in degrees of UTM south coordinates on the row's ellipsoid."""

    def plane(k):
        start = F.struct(((y - FALSE_NORTH) / k["scale"]).alias("xi"), ((x - FALSE_EAST) / k["scale"]).alias("eta"))
        return _let(start, lambda v: sphere(k, v["xi"], v["eta"]))

    def sphere(k, xi, eta):
        dxi = sum((k[f"i{j}"] * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j in range(1, 7)), F.lit(0.0))
        deta = sum((k[f"i{j}"] * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j in range(1, 7)), F.lit(0.0))
        return _let(F.struct((xi - dxi).alias("xi"), (eta - deta).alias("eta")), lambda w: latitude(k, w["xi"], w["eta"]))

    def latitude(k, xi, eta):
        start = F.sin(xi) / F.sqrt(F.pow(F.sinh(eta), F.lit(2.0)) + F.pow(F.cos(xi), F.lit(2.0)))
        tangent = _let(start, lambda tp: F.aggregate(F.sequence(F.lit(1), F.lit(5)), tp, lambda t, _: _newton(t, tp, k["e"])))
        lon = _meridian(zone) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
        return F.struct(lon.alias("lon"), F.degrees(F.atan(tangent)).alias("lat"))

    return _let(_constants(ellps), plane)


def utm_forward(lon: Column, lat: Column, zone: Column, ellps: Column) -> Column:
    """``struct<x,y>`` in metres of UTM south from degrees on the row's ellipsoid."""

    def sphere(k):
        start = F.struct(
            F.radians(lon - _meridian(zone)).alias("lam"),
            _let(F.tan(F.radians(lat)), lambda t: _conformal(t, k["e"])).alias("tp"),
        )
        return _let(start, lambda v: plane(k, v["lam"], v["tp"]))

    def plane(k, lam, tp):
        start = F.struct(
            F.atan2(tp, F.cos(lam)).alias("xi"),
            F.asinh(F.sin(lam) / F.sqrt(tp * tp + F.pow(F.cos(lam), F.lit(2.0)))).alias("eta"),
        )
        return _let(start, lambda w: metres(k, w["xi"], w["eta"]))

    def metres(k, xi, eta):
        north = sum((k[f"f{j}"] * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j in range(1, 7)), xi)
        east = sum((k[f"f{j}"] * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j in range(1, 7)), eta)
        return F.struct((FALSE_EAST + k["scale"] * east).alias("x"), (FALSE_NORTH + k["scale"] * north).alias("y"))

    return _let(_constants(ellps), sphere)


def utm_to_lonlat(df: DataFrame, x: str, y: str, zone: Column, ellps: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add longitude and latitude of UTM south coordinates."""
    out = df.withColumn("_ll", utm_inverse(col(x), col(y), zone, ellps))
    return out.withColumns({lon: F.col("_ll.lon"), lat: F.col("_ll.lat")}).drop("_ll")


def lonlat_to_utm(df: DataFrame, lon: str, lat: str, zone: Column, ellps: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Add UTM south coordinates of longitude and latitude."""
    out = df.withColumn("_xy", utm_forward(col(lon), col(lat), zone, ellps))
    return out.withColumns({x: F.col("_xy.x"), y: F.col("_xy.y")}).drop("_xy")


def reproject_utm(df: DataFrame, x: str = "easting", y: str = "northing", zone: str = "huso", datum: str = "datum") -> DataFrame:
    """UTM 18S or 19S on either ellipsoid to UTM 19S on the South American one; ``x`` and ``y`` are replaced.

    No datum shift is applied: only ellipsoid and zone change.
    """
    own = F.when(col(datum) == "WGS84", F.lit("WGS84")).when(col(datum) == "SAD69", F.lit("aust_SA"))
    moved = _let(
        utm_inverse(col(x), col(y), col(zone), own),
        lambda p: utm_forward(p["lon"], p["lat"], F.lit(19), F.lit("aust_SA")),
    )
    here = F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    same = (col(datum) == "SAD69") & (col(zone) == 19)
    out = df.withColumn("_xy", F.when(same, here).otherwise(moved))
    return out.withColumns({x: F.col("_xy.x"), y: F.col("_xy.y")}).drop("_xy")


def harmonise_crs(df: DataFrame, x: str, y: str, to: str) -> DataFrame:
    """Points in UTM 19S (South American ellipsoid) to ``lonlat``, or back to ``utm19s``."""
    if to == "lonlat":
        out = utm_to_lonlat(df, x, y, F.lit(19), F.lit("aust_SA"), "_lon", "_lat")
        return out.withColumns({x: F.col("_lon"), y: F.col("_lat")}).drop("_lon", "_lat")
    if to == "utm19s":
        out = lonlat_to_utm(df, x, y, F.lit(19), F.lit("aust_SA"), "_e2", "_n2")
        return out.withColumns({x: F.col("_e2"), y: F.col("_n2")}).drop("_e2", "_n2")
    raise ValueError(f"unknown target {to!r}")


def clean_coordinates(
    df: DataFrame, datum: str = "datum", x: str = "easting", y: str = "northing", zone: str = "huso", strict: bool = False
) -> DataFrame:
    """Known datum and zone only, reprojected to UTM 19S on the South American ellipsoid."""
    known = df.withColumn(datum, clean_datum(datum, strict)).where(col(datum).isin(*DATUM_ELLIPSOID))
    zoned = known.withColumn(zone, impute_zone(zone, x, y)).where(col(zone).isin(18, 19))
    return reproject_utm(zoned, x, y, zone, datum)
