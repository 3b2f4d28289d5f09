"""Positions on a sphere or plane as Columns, and tables of axes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def phase(angle: Column, low: float = 0.0, turn: float = 360.0) -> Column:
    """The angle in [low, low + turn)."""
    return angle - F.floor((angle - low) / turn) * turn


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Central angle in radians between positions in degrees; right for near and for opposite ones."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.cos(b) * F.sin(d)
    y = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.atan2(F.hypot(x, y), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))


def _plane(true_lat: float) -> float:
    return 1 + math.sin(math.radians(abs(true_lat)))


def stereographic(lon: Column, lat: Column, lon0: float = 0.0, true_lat: float = 90.0, south: bool = False) -> tuple[Column, Column]:
    """Polar stereographic plane of the unit sphere, true to scale at ``true_lat``; of the south pole with ``south``.

    The meridian ``lon0`` points down on the northern plane and up on the southern one, so that east is to the right of it.
    """
    r = F.tan(F.radians(F.lit(45.0) - (-lat if south else lat) / 2)) * _plane(true_lat)
    d = F.radians(lon - lon0)
    return r * F.sin(d), r * F.cos(d) * (1 if south else -1)


def stereographic_inverse(x: Column, y: Column, lon0: float = 0.0, true_lat: float = 90.0, south: bool = False) -> tuple[Column, Column]:
    lat = F.lit(90.0) - 2 * F.degrees(F.atan(F.hypot(x, y) / _plane(true_lat)))
    return F.degrees(F.atan2(x, y if south else -y)) + lon0, -lat if south else lat


def scale_factor(lat: Column, true_lat: float = 90.0, south: bool = False) -> Column:
    """Length on the stereographic plane for a unit of length on the sphere."""
    return F.lit(_plane(true_lat)) / (F.lit(1.0) + F.sin(F.radians(-lat if south else lat)))


def plane_length(x1: Column, y1: Column, x2: Column, y2: Column, true_lat: float = 90.0) -> Column:
    """The length on the unit sphere of what is a straight line between two points of the stereographic plane.

    On the plane a unit of length at distance r from the pole is 2 k / (k k + r r) long on the sphere times k / 2,
    k being the plane's radius of the equator; along a line that is the derivative of an arc tangent.
    """
    k = _plane(true_lat)
    length = F.hypot(x2 - x1, y2 - y1)
    ux, uy = (x2 - x1) / length, (y2 - y1) / length
    along1, along2 = x1 * ux + y1 * uy, x2 * ux + y2 * uy
    off = F.abs(x1 * uy - y1 * ux)
    height = F.sqrt(off * off + k * k)
    return F.when(length == 0, 0.0).otherwise(2 * k / height * (F.atan(along2 / height) - F.atan(along1 / height)))


def cell_area(lon1: Column, lon2: Column, lat1: Column, lat2: Column) -> Column:
    """Area on the unit sphere between two meridians and two circles of latitude, in degrees; exact for narrow cells too."""
    a, b = F.radians(lat1), F.radians(lat2)
    return F.abs(F.radians(lon2 - lon1) * 2 * F.sin((b - a) / 2) * F.cos((a + b) / 2))


#: Newton steps, each of which doubles the digits.
NEWTON = 6


def gauss_latitudes(spark: SparkSession, n: int, steps: int = NEWTON) -> DataFrame:
    """Rows (j, lat, weight), north to south: roots of the Legendre polynomial of degree n; weights sum to 2.

    Each row is a root: a first guess by its angle, then Newton steps over the recurrence of the polynomials, folded as
    expressions. Rows are dealt over tasks, and the southern half mirrors the northern one.
    """
    order = F.sequence(F.lit(2), F.lit(n)) if n > 1 else F.array().cast("array<int>")

    def polynomials(theta: Column) -> Column:
        """At cos(theta): p of degree n, d its difference from degree n - 1, t = 1 - cos(theta). Steps by differences lose nothing near the poles."""
        t = F.lit(2.0) * F.pow(F.sin(theta / 2), F.lit(2.0))

        def up(s: Column, k: Column) -> Column:
            d = ((k - 1) * s["d"] - (2 * k - 1) * t * s["p"]) / k
            return F.struct((s["p"] + d).alias("p"), d.alias("d"))

        last = F.aggregate(order, F.struct((F.lit(1.0) - t).alias("p"), (-t).alias("d")), up)
        return F.struct(last["p"].alias("p"), (F.lit(float(-n)) * (t * last["p"] - last["d"]) / F.sin(theta)).alias("slope"))

    def newton(theta: Column, _: Column) -> Column:
        """In the angle, along which roots lie evenly."""
        return F.get(F.transform(F.array(polynomials(theta)), lambda s: theta - s["p"] / s["slope"]), F.lit(0))

    guess = F.lit(math.pi) * (F.col("id") + 0.75) / (n + 0.5)
    north = spark.range((n + 1) // 2).select("id", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), guess, newton).alias("theta"))
    if n % 2:
        north = north.withColumn("theta", F.when(F.col("id") == n // 2, F.lit(math.pi / 2)).otherwise(F.col("theta")))
    weight = F.lit(2.0) / F.pow(polynomials(F.col("theta"))["slope"], F.lit(2.0))
    lat = F.lit(90.0) - F.degrees("theta")
    north = north.select("id", lat.alias("lat"), weight.alias("weight"))
    both = F.array(F.struct(F.col("id").alias("j"), F.col("lat")), F.struct((F.lit(n - 1) - F.col("id")).alias("j"), (-F.col("lat")).alias("lat")))
    return north.select(F.explode(F.when(F.col("id") * 2 + 1 == n, F.slice(both, 1, 1)).otherwise(both)).alias("s"), "weight").select("s.j", "s.lat", "weight")


def longitudes(spark: SparkSession, n: int, start: float = 0.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") * (360.0 / n) + start).alias("lon"), ((F.col("id") - 0.5) * (360.0 / n) + start).alias("low"), ((F.col("id") + 0.5) * (360.0 / n) + start).alias("high"))
