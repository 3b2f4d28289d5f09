"""Neighbours in an order too long for one task: it is cut into blocks by quantiles, which pass on their edge rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a whole order; a line of it has as many edge rows at most.
BLOCKS = 256


def blocked(df: DataFrame, by: str, blocks: int = BLOCKS) -> DataFrame:
    """With ``__block``: how many of the quantiles of ``by`` lie below a row. The quantiles are a subquery of the plan."""
    at = F.array(*[F.lit(k / blocks) for k in range(1, blocks)])
    bounds = df.agg(F.array_distinct(F.percentile_approx(by, at, F.lit(4 * blocks))).alias("bounds")).scalar()
    return df.withColumn("__bounds", bounds).withColumn("__block", F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col(by))), F.lit(0))).drop("__bounds")


def with_neighbours(df: DataFrame, keys: list[str], by: str, values: dict[str, Column], blocks: int = BLOCKS, cyclic: bool = False) -> DataFrame:
    """``df`` with ``before`` and ``after``: structs of ``values`` of the neighbours by ``by`` among rows that share ``keys``.

    Rows of a block are sorted together; the first and last row of each block of a line go to the blocks next to it,
    by a table of at most ``blocks`` rows a line. NULL at an end, or with ``cyclic`` the row at the other end. ``by``
    must be unique and not NULL within a line.
    """
    own = F.struct(*[c.alias(k) for k, c in values.items()])
    cut = blocked(df, by, blocks).withColumn("__own", own)
    within = Window.partitionBy(*keys, "__block").orderBy(by)
    cut = cut.withColumn("before", F.lag("__own").over(within)).withColumn("after", F.lead("__own").over(within))
    edges = cut.groupBy(*keys, "__block").agg(F.min_by("__own", by).alias("__first"), F.max_by("__own", by).alias("__last"))
    line = Window.partitionBy(*keys).orderBy("__block")
    edges = edges.withColumn("__before", F.lag("__last").over(line)).withColumn("__after", F.lead("__first").over(line))
    if cyclic:
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        edges = edges.withColumn("__before", F.coalesce("__before", F.last("__last").over(whole))).withColumn("__after", F.coalesce("__after", F.first("__first").over(whole)))
    edges = edges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), "__before", "__after")
    met = cut.join(edges, [F.col("__block") == F.col("__b"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]])
    return met.select(*df.columns, F.coalesce("before", "__before").alias("before"), F.coalesce("after", "__after").alias("after"))


def nearest(marks: DataFrame, asked: DataFrame, keys: list[str], at: str, value: Column, name: str, later: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """As-of lookup: ``asked`` with the ``value`` of the last of ``marks`` that has the same ``keys`` and whose ``at``
    isn't later; with ``later`` of the first whose ``at`` isn't earlier.

    Both are put in one order and cut into blocks of it; a block gets the mark next to it from a table of at most
    ``blocks`` rows a line, so a line as long as the table is no single task. Of marks at the same ``at`` the largest
    value counts (``later``: the smallest). NULL where there is none; a NULL ``at`` or key finds nothing.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in asked.columns])
    mine = marks.where(F.col(at).isNotNull()).groupBy(*keys, at).agg((F.min if later else F.max)(value).alias("x"))
    mine = mine.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.struct("x").alias("__mark"))
    both = mine.unionByName(asked.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__kind"), kept.alias("__row")), allowMissingColumns=True)
    cut = blocked(both, "__at", blocks)
    order = lambda c: F.col(c).desc() if later else F.col(c).asc()
    seen = Window.partitionBy(*keys, "__block").orderBy(order("__at"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("__found", F.last("__mark", ignorenulls=True).over(seen))
    edge = (F.min_by if later else F.max_by)("__mark", F.when(F.col("__mark").isNotNull(), F.col("__at")))
    line = Window.partitionBy(*keys).orderBy(order("__block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = cut.groupBy(*keys, "__block").agg(edge.alias("__last"))
    edges = edges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), F.last("__last", ignorenulls=True).over(line).alias("__before"))
    met = cut.where("__kind = 1").join(edges, [F.col("__block") == F.col("__b"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]])
    unknown = F.lit(False)
    for k in ("__at", *keys):
        unknown = unknown | F.col(k).isNull()
    return met.select("__row.*", F.when(~unknown, F.coalesce("__found", "__before")["x"]).alias(name))
