"""Differences of two data sets, record by record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_differences(reference: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """All cells of both: ``r``, ``t``, ``diff`` (t - r) and ``rel`` (diff / r, NULL for r = 0)."""
    met = reference.select(*keys, F.col("v").alias("r")).join(target.select(*keys, F.col("v").alias("t")), keys, "full_outer")
    diff = F.col("t") - F.col("r")
    return met.select(*keys, "r", "t", diff.alias("diff"), F.when(F.col("r") != 0, diff / F.col("r")).alias("rel"))


def compare(reference: DataFrame, target: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """For each of ``by``: least and largest size, largest difference, relative and against zero, and one-sided missing cells.

    The least size leaves out zeros of the reference; a cell of which one side has no row counts as missing there.
    """
    cells = cell_differences(reference, target, keys)
    r, t = F.col("r"), F.col("t")
    both = r.isNotNull() & t.isNotNull()
    return cells.groupBy(*by).agg(
        F.min(F.when(both & (r != 0), F.abs(r))).alias("abs_min"),
        F.max(F.when(both, F.abs(r))).alias("abs_max"),
        F.max(F.abs("diff")).alias("abs_diff"),
        F.max(F.abs("rel")).alias("rel_diff"),
        F.max(F.when((r == 0) & (t != 0), F.abs("diff"))).alias("zero_diff"),
        F.count_if(r.isNotNull() & t.isNull()).alias("miss_target"),
        F.count_if(r.isNull() & t.isNotNull()).alias("miss_reference"),
    )


def beyond(reference: DataFrame, target: DataFrame, keys: list[str], rtol: float, atol: float) -> DataFrame:
    """The cells that differ by more than both tolerances."""
    cells = cell_differences(reference, target, keys)
    return cells.where((F.abs("diff") > atol) & (F.coalesce(F.abs("rel"), F.lit(float("inf"))) > rtol))
