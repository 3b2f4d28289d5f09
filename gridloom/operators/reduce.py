"""Reductions along coordinates, and folds across several values of a cell."""

from __future__ import annotations

from functools import reduce as fold
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

if TYPE_CHECKING:
    from ..field import Field


def _strict(agg, cells: int | None):
    """NULL if any cell is missing, or absent from a box of ``cells`` cells."""
    return lambda v: F.when(F.count(v) == (F.count(F.lit(1)) if cells is None else F.lit(cells)), agg(v))


def aggregates(name: str, v: Column, w: Column | None = None, cells: int | None = None) -> dict[str, Column]:
    """The aggregate columns of a reduction. L... and SUM, COUNT look at defined cells, the others want all defined.

    WSUM gives the sum of w v and of w where both are defined. Weighted moments (WMV) are ``weighted_moments``.
    """
    simple = {"ADD": F.sum, "MUL": F.product, "MAX": F.max, "MIN": F.min}
    if name in simple:
        return {"v": _strict(simple[name], cells)(v)}
    if name[0] == "L" and name[1:] in simple:
        return {"v": simple[name[1:]](v)}
    if name == "COUNT":
        return {"v": F.count(v).cast("double")}
    if name == "SUM":
        return {"v": F.coalesce(F.sum(v), F.lit(0.0))}
    if name == "WSUM":
        return {"v": F.coalesce(F.sum(v * w), F.lit(0.0)), "w": F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0))}
    raise KeyError(name)


STATE = ["__w", "__p", "__d", "__q"]


def _merged(states: Column) -> Column:
    """One state (w, p, d, q) of many: d and q are weighted sums of deviations from a pivot p and of their squares, and
    all are moved to the first pivot; pivots are means of parts, so what is moved is small and nothing cancels."""
    pivot = F.get(states, F.lit(0))["__p"]

    def add(done: Column, x: Column) -> Column:
        off = x["__p"] - pivot
        return F.struct((done["w"] + x["__w"]).alias("w"), (done["d"] + x["__d"] + x["__w"] * off).alias("d"), (done["q"] + x["__q"] + 2 * off * x["__d"] + x["__w"] * off * off).alias("q"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("d"), F.lit(0.0).alias("q"))
    return F.aggregate(states, zero, add, lambda t: F.struct(t["w"].alias("__w"), pivot.alias("__p"), t["d"].alias("__d"), t["q"].alias("__q")))


def weighted_moments(df: DataFrame, keys: list[str], v: str, w: str) -> DataFrame:
    """WMV: ``keys``, mean, s (the undivided weighted sum of squared deviations) and w, where v and w are defined.

    One scan: each task turns its rows into states that can be merged (``_merged``), one for each key of a batch, and
    only states are shuffled; they are merged by key and task first, so that a hot key's states are few in the end.
    Mean and s are NULL where the weights of a key add up to 0.
    """
    used = df.where(F.col(v).isNotNull() & F.col(w).isNotNull()).select(*keys, F.col(v).cast("double").alias("__v"), F.col(w).cast("double").alias("__w"))
    schema = StructType([*used.select(*keys).schema.fields, StructField("__task", LongType()), *[StructField(c, DoubleType()) for c in STATE]])

    def partial(batches):
        task = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.zeros(batch.num_rows, np.int64)
            for c in (batch.column(k).dictionary_encode("encode") for k in keys):
                group = np.unique(group * (len(c.dictionary) + 1) + np.asarray(c.indices, np.int64), return_inverse=True)[1]
            _, first, group = np.unique(group, return_index=True, return_inverse=True)
            x, weight = (batch.column(c).to_numpy() for c in ("__v", "__w"))
            pivot = np.bincount(group, x) / np.bincount(group)
            off = x - pivot[group]
            states = [np.bincount(group, weight), pivot, np.bincount(group, weight * off), np.bincount(group, weight * off * off)]
            held = [batch.column(k).take(pa.array(first)) for k in keys]
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(len(first), task)), *map(pa.array, states)], names=[*keys, "__task", *STATE])

    states = used.mapInArrow(partial, schema)
    merge = lambda d, by: d.groupBy(*by).agg(_merged(F.collect_list(F.struct(*STATE))).alias("__t")).select(*by, "__t.*")
    done = merge(merge(states, [*keys, "__task"]), keys)
    whole = F.col("__w") != 0
    return done.select(*keys, F.when(whole, F.col("__p") + F.col("__d") / F.col("__w")).alias("mean"), F.when(whole, F.col("__q") - F.col("__d") * F.col("__d") / F.col("__w")).alias("s"), F.col("__w").alias("w"))


def reduced(field: Field, name: str, over: list[str], weight: Field | None, ranges: dict[str, tuple[int, int]]) -> Field:
    """Reduce ``over`` these coordinates (none: all), within ``ranges``; records stay apart."""
    from dataclasses import replace

    from . import align, shape

    unknown = set(over) - set(field.names)
    if unknown:
        raise KeyError(f"no coordinate {sorted(unknown)}")
    over = over or field.names
    field = shape.selected(field, ranges) if ranges else field
    kept = [c for c in field.coords if c.name not in over]
    keys = (["rec"] if field.has_rec else []) + [c.name for c in kept]
    sizes = [c.end - c.begin if c.end is not None and c.begin is not None else None for c in field.coords if c.name in over]
    cells = fold(lambda a, b: a * b, sizes, 1) if None not in sizes else None
    if weight is not None:
        df = align.aligned([field, weight], "first").df
        if name == "WMV":
            return replace(field, df=weighted_moments(df, keys, "v0", "v1"), coords=tuple(kept), meta=field.meta.reduced(name, over))
        aggs = aggregates(name, F.col("v0"), F.col("v1"))
    else:
        df, aggs = field.df, aggregates(name, F.col("v"), cells=cells)
    return replace(field, df=df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()]), coords=tuple(kept), kind="int" if name == "COUNT" else field.kind, meta=field.meta.reduced(name, over))


def across(name: str, values: list[Column], weights: list[Column] | None = None) -> dict[str, Column]:
    """The same across several values of one cell: COUNT, SUM, WSUM, WMV, and any operator of two as a left fold."""
    from ..functions.scalar import OPERATORS

    if name == "COUNT":
        return {"v": fold(lambda a, b: a + b, [x.isNotNull().cast("double") for x in values])}
    if name == "SUM":
        return {"v": fold(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in values])}
    if name in ("WSUM", "WMV"):
        both = [(F.when(w.isNotNull(), x), F.when(x.isNotNull(), w)) for x, w in zip(values, weights, strict=True)]
        total = fold(lambda a, b: a + b, [F.coalesce(w, F.lit(0.0)) for _, w in both])
        wv = fold(lambda a, b: a + b, [F.coalesce(x * w, F.lit(0.0)) for x, w in both])
        if name == "WSUM":
            return {"v": wv, "w": total}
        mean = F.when(total != 0, wv / total)
        return {"mean": mean, "s": fold(lambda a, b: a + b, [F.coalesce(w * (x - mean) * (x - mean), F.lit(0.0)) for x, w in both]), "w": total}
    return {"v": fold(OPERATORS[name], values)}
