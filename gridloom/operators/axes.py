"""Checks of axes: order, spacing and symmetry of the positions along each, with tolerances."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = sys.float_info.epsilon


def checked(axes: DataFrame, axis: str = "axis", place: str = "j", position: str = "x", origin: float = 0.0, tolerance: float | None = None) -> DataFrame:
    """A row for each axis: n, monotonic, spacing, deviation, equidistant, symmetry, spans, asymmetry.

    ``axes`` has rows (axis, place, position), places being 0, 1, ... without a gap. ``monotonic``: 1 rising, -1 falling,
    0 neither (one position alone too). ``deviation``: the largest step less the smallest. ``spacing``: "strict" if that is 0, "enough" if
    it is lost in the positions' digits, else "none", and "none" for what isn't monotonic. ``equidistant``: whether
    the deviation is within ``tolerance`` (default: two units in the last place of the largest position). ``symmetry`` about ``origin``: "even" if a
    position lies on it, "odd" if none does, "none" if the positions on both sides aren't mirror images within
    ``tolerance`` (default: two units in the last place of the larger end), or if one side has none; ``spans`` whether both sides have as
    many, ``asymmetry`` the largest sum of a position and its mirror image.

    Neighbours and mirror images are found by equality joins on (axis, place), so a long axis is no single task.
    """
    a = axes.select(F.col(axis).alias("axis"), F.col(place).cast("long").alias("j"), (F.col(position).cast("double")).alias("x"))
    after = a.select("axis", (F.col("j") - 1).alias("j"), F.col("x").alias("next"))
    step = F.col("next") - F.col("x")
    size = F.abs("x")
    about = a.join(after, ["axis", "j"], "left").groupBy("axis").agg(
        F.count("*").alias("n"), F.min(step).alias("low"), F.max(step).alias("high"), F.max(size).alias("most"), F.min(F.when(size > 0, size)).alias("least"),
        F.max(F.when(F.col("next").isNotNull(), size)).alias("inner"), F.min_by("x", "j").alias("first"), F.max_by("x", "j").alias("last"),
    )
    given = F.lit(tolerance).cast("double")
    about = about.withColumn("t", F.coalesce(given, F.greatest(F.abs("first"), F.abs("last")) * (2 * EPSILON)))
    rising = F.col("first") - origin < F.col("t")
    beyond = F.when(rising, F.col("x") - origin >= -F.col("t")).otherwise(F.col("x") - origin <= F.col("t"))
    small = about.select("axis", "n", "first", "t")
    crossing = a.join(small, "axis").where((F.col("j") > 0) & beyond).groupBy("axis").agg(F.min("j").alias("at"), F.min_by("x", "j").alias("x_at"))
    about = about.join(crossing, "axis", "left")
    on = F.abs(F.col("x_at") - origin) <= F.col("t")
    above, below = F.when(on, F.col("n") - 1 - F.col("at")).otherwise(F.col("n") - F.col("at")), F.col("at")
    about = about.withColumn("on", on).withColumn("above", above).withColumn("below", below)
    pairs = a.join(about.select("axis", "at", "on", F.least("above", "below").alias("pairs")), "axis")
    upper = pairs.where((F.col("j") >= F.col("at") + F.col("on").cast("int")) & (F.col("j") < F.col("at") + F.col("on").cast("int") + F.col("pairs")))
    mirror = upper.select("axis", (2 * F.col("at") - F.col("j") - F.when(F.col("on"), 0).otherwise(1)).alias("j"), F.col("x").alias("image"))
    worst = mirror.join(a, ["axis", "j"]).groupBy("axis").agg(F.max(F.abs((F.col("x") - origin) + (F.col("image") - origin))).alias("asymmetry"))
    about = about.join(worst, "axis", "left")
    monotonic: Column = F.when(F.col("low") > 0, 1).when(F.col("high") < 0, -1).otherwise(0)
    deviation = F.col("high") - F.col("low")
    enough = F.abs(deviation * (F.col("least") / F.col("most"))) < EPSILON
    spacing = F.when((F.col("n") < 2) | (monotonic == 0), "none").when(deviation == 0, "strict").when(enough, "enough").otherwise("none")
    even = F.coalesce(given, F.col("inner") * (2 * EPSILON))
    lopsided = F.col("at").isNull() | (F.col("above") == 0) | (F.col("below") == 0) | (F.col("asymmetry") > F.col("t"))
    symmetry = F.when(F.coalesce(lopsided, F.lit(True)), "none").when(F.col("on"), "even").otherwise("odd")
    return about.select(
        "axis", "n", monotonic.alias("monotonic"), spacing.alias("spacing"), F.coalesce(deviation, F.lit(0.0)).alias("deviation"), F.coalesce(deviation <= even, F.lit(True)).alias("equidistant"),
        symmetry.alias("symmetry"), ((symmetry != "none") & (F.col("above") == F.col("below"))).alias("spans"), F.coalesce("asymmetry", F.lit(0.0)).alias("asymmetry"),
    )
