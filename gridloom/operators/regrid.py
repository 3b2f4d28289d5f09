"""Regridding: tables of weights (dst, src, w), made from axes, applied to fields by a join and a sum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import BLOCKS, with_neighbours


def overlap_weights(src: DataFrame, dst: DataFrame, period: float) -> DataFrame:
    """Conservative weights of a circular axis from cells (cell, low, high): overlap over the target cell's width.

    The range join is an equi-join: cells, with their copies a turn before and after, are cut at the bins of a grid of
    as many bins as there are target cells, so each pair of cells meets in a bin that both touch, and counts in the
    first such. The longer of the two tables is dealt by bin; nothing is crossed.
    """
    bins = dst.agg(F.greatest(F.count("*"), F.lit(1))).scalar()  # a subquery of the plan

    def binned(df: DataFrame, name: str) -> DataFrame:
        width = F.lit(float(period)) / F.col("bins")
        first, last = F.floor(F.col("low") / width), F.floor(F.col("high") / width)
        return df.withColumn("bins", bins).select(F.col("cell").alias(name), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"), width.alias(f"{name}_width"), F.explode(F.sequence(first, last)).alias("bin"))

    turned = src.select("cell", "low", "high", F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0))).alias("k"))
    turned = turned.select("cell", (F.col("low") + F.col("k") * period).alias("low"), (F.col("high") + F.col("k") * period).alias("high"))
    met = binned(turned, "src").join(binned(dst.select("cell", "low", "high"), "dst"), "bin")
    start = F.greatest("src_low", "dst_low")
    shared = F.least("src_high", "dst_high") - start
    met = met.where((shared > 0) & (F.col("bin") == F.floor(start / F.col("dst_width"))))
    return met.select("dst", "src", (shared / (F.col("dst_high") - F.col("dst_low"))).alias("w")).groupBy("dst", "src").agg(F.sum("w").alias("w"))


def apply_weights(field: DataFrame, weights: DataFrame, axis: str, keys: list[str] | None = None, normalised: bool = False, value: str = "v") -> DataFrame:
    """Sum of w times the source cell for each target cell; ``keys`` are the other coordinates. Missing cells make missing ones.

    With ``normalised`` missing cells are left out and the sum is divided by the weights that remain, NULL for none.
    Target cells without weights have no row.
    """
    keys = keys or []
    met = field.join(weights.withColumnRenamed("src", axis), axis)
    v, w = F.col(value), F.col("w")
    if normalised:
        used = F.sum(F.when(v.isNotNull(), w))
        out = F.when(used != 0, F.sum(v * w) / used)
    else:
        out = F.when(F.count(v) == F.count(F.lit(1)), F.sum(v * w))
    return met.groupBy(*keys, "dst").agg(out.alias(value)).withColumnRenamed("dst", axis)


def transposed(weights: DataFrame) -> DataFrame:
    return weights.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "w")


def apply_vector(field: DataFrame, weights: DataFrame, axis: str, components: dict[str, str], keys: list[str] | None = None, denominator: str | None = None, destinations: DataFrame | None = None, undefined: float | None = None, value: str = "v") -> DataFrame:
    """Several components at once: for each target cell the sum over components and sources of weight times value, over
    the sum of the weights of ``denominator``.

    ``components`` has for each column of ``field`` its column of ``weights`` (dst, src, ...); ``denominator`` names
    one of the latter (default: the first), whose sum over all sources of a target cell divides, whatever is missing.
    A missing component of any source that has a row makes the cell missing; sources without a row count as zero. Target cells with a denominator of 0, and those
    of ``destinations`` (dst) without weights, get ``undefined`` (NULL for missing); without ``destinations`` the latter have no row.

    The denominators are sums of the weights alone, one row for each target cell; the rest is one join and one aggregate.
    """
    keys = keys or []
    below = weights.groupBy("dst").agg(F.sum(denominator or next(iter(components.values()))).alias("__d"))
    used = weights.select("dst", F.col("src").alias(axis), *[F.col(w).alias(f"__w{i}") for i, w in enumerate(components.values())])
    term = sum((F.col(c) * F.col(f"__w{i}") for i, c in enumerate(components)), F.lit(0.0))
    met = field.join(used, axis).groupBy(*keys, "dst").agg(F.when(F.count(term) == F.count(F.lit(1)), F.sum(term)).alias("__s"))
    met = met.join(below, "dst", "left").select(*keys, "dst", F.when(F.col("__d") != 0, F.col("__s") / F.col("__d")).otherwise(F.lit(undefined)).alias(value))
    if destinations is not None:
        met = completed(met, destinations, keys, undefined, value)
    return met.withColumnRenamed("dst", axis)


def completed(target: DataFrame, destinations: DataFrame, keys: list[str], undefined: float | None = None, value: str = "v") -> DataFrame:
    """``target`` (keys, dst, value) with a row ``undefined`` for each cell of ``destinations`` (dst) that it lacks, in each line of ``keys``."""
    lines = target.select(*keys).distinct() if keys else target.sparkSession.range(1).select()
    every = lines.withColumn("__one", F.lit(1)).join(destinations.select("dst").distinct().withColumn("__one", F.lit(1)), "__one").drop("__one") if keys else destinations.select("dst").distinct()
    return target.unionByName(every.join(target, [*keys, "dst"], "left_anti").withColumn(value, F.lit(undefined).cast("double")))


def jagged_order(weights: DataFrame) -> DataFrame:
    """With ``layer``: the place of an entry among its target's, by source."""
    return weights.withColumn("layer", F.row_number().over(Window.partitionBy("dst").orderBy("src")) - 1)


def jagged(weights: DataFrame, block_size: int = 64) -> DataFrame:
    """Weights by jagged diagonals: a row (block, sources, layers) for each ``block_size`` targets that follow each other.

    Layer k has the k-th entry (by source) of each target of the block that has so many: three arrays dst, src and w
    of one order, targets with more entries first. So layers get shorter, layer 0 has all targets, and the sums of
    a layer are the first ones of the block. ``sources`` are the different sources of the block.
    """
    each = jagged_order(weights.select("dst", "src", "w")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("dst")))
    block = F.floor(F.col("dst") / block_size).alias("block")
    one = each.groupBy(block, "layer").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "dst", "src", "w"))).alias("e"))
    layers = one.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("layer", F.col("e.dst").alias("dst"), F.col("e.src").alias("src"), F.col("e.w").alias("w")))).alias("layers"))
    return layers.select("block", F.array_distinct(F.flatten("layers.src")).alias("sources"), "layers")


def apply_jagged(field: DataFrame, blocks: DataFrame, axis: str, keys: list[str] | None = None, value: str = "v") -> DataFrame:
    """As ``apply_weights`` does, from the rows of ``jagged``: sums of w times the source cell, NULL where one is missing.

    A source cell goes once to each block that needs it, however many of its targets do; there the cells of a line (those
    that share ``keys``) are one map, and layers are added up by place. So no row is made or shuffled for an entry of the
    weights. A block's weights and the cells that it needs of one line must fit in a row.
    """
    keys = keys or []
    needed = blocks.select("block", F.explode("sources").alias(axis))
    entry = F.struct(F.col(axis).cast("long"), F.struct(F.col(value).alias("x")))
    lines = field.join(needed, axis).groupBy(*keys, "block").agg(F.map_from_entries(F.collect_list(entry)).alias("__line"))
    met = lines.join(blocks.select("block", "layers"), "block")

    def add(done: Column, layer: Column) -> Column:
        def at(old: Column, k: Column) -> Column:
            held = F.try_element_at(F.col("__line"), F.get(layer["src"], k).cast("long"))
            new = F.struct((old["s"] + F.coalesce(held["x"], F.lit(0.0)) * F.get(layer["w"], k)).alias("s"), (old["n"] + 1).alias("n"), (old["gone"] | held["x"].isNull()).alias("gone"))
            return F.when((k < F.size(layer["dst"])) & held.isNotNull(), new).otherwise(old)

        return F.transform(done, at)

    first = F.get("layers", F.lit(0))["dst"]
    none = F.transform(first, lambda _: F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(False).alias("gone")))
    out = met.select(*keys, F.explode(F.arrays_zip(first.alias("dst"), F.aggregate("layers", none, add).alias("t"))).alias("z"))
    return out.where("z.t.n > 0").select(*keys, F.col("z.dst").alias(axis), F.when(~F.col("z.t.gone"), F.col("z.t.s")).alias(value))


def derivative(df: DataFrame, axis: str, position: Column, keys: list[str], value: str = "v", period: float | None = None, degrees: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """First derivative along an axis of uneven spacing by three points; one-sided at the ends.

    With ``period`` the axis is a circle of that length in ``position``, and its ends are neighbours. With ``degrees``
    positions are degrees and slopes are by radian. ``keys`` may be empty; an axis of any length is dealt over tasks
    in blocks that pass on their edge rows (``with_neighbours``).
    """
    x, v = position, F.col(value)
    near = with_neighbours(df.withColumn("__x", x), keys, axis, {"x": F.col("__x"), "v": v, "p": F.col(axis)}, blocks, cyclic=period is not None)
    x, before, after = F.col("__x"), F.col("before.v"), F.col("after.v")
    x_before, x_after = F.col("before.x"), F.col("after.x")
    if period is not None:
        x_before = F.when(F.col("before.p") >= F.col(axis), x_before - period).otherwise(x_before)
        x_after = F.when(F.col("after.p") <= F.col(axis), x_after + period).otherwise(x_after)
    a, b = x - x_before, x_after - x
    inner = -b / (a * (a + b)) * before + (b - a) / (a * b) * v + a / (b * (a + b)) * after
    slope = F.when(a.isNull(), (after - v) / b).when(b.isNull(), (v - before) / a).otherwise(inner)
    return near.select(*df.columns, (slope * F.lit(180.0 / math.pi) if degrees else slope).alias("slope"))
