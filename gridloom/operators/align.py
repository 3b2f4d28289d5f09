"""Alignment: operands meet cell by cell on the coordinates they share."""

from __future__ import annotations

import math
from functools import reduce as fold
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..field import Coord, Field


class AmbiguousCoordinates(ValueError):
    """Coordinates of different names stand at the same place, so neither order nor meaning is certain."""


HOW = {"inclusive": "full_outer", "intersect": "inner", "first": "left"}


#: Cells up to which an operand that shares nothing with the others is broadcast.
OUTER_CELLS = 1 << 16


def merged_names(fields: list[Field], names: list[str] | None = None) -> list[str]:
    """The coordinates of the result, in an order that agrees with that of every operand.

    Names are put in the order in which the operands have them, the first operand's first where they leave it open. An
    operand with no name in common with those before it, one of whose names stands at the place of another one, is
    ambiguous, unless ``names`` orders them: a list of all names, in which "*" stands for those not
    listed, in their own order. Operands that contradict each other (lon before lat, lat before lon) take the first
    operand's order if they have the same names; a contradiction in a circle of several operands is an error.
    """
    every = list(dict.fromkeys(n for f in fields for n in f.names))
    if names is not None:
        listed = [n for n in names if n != "*"]
        if len(set(names)) < len(names) or not set(listed) <= set(every) or "*" not in names and set(listed) != set(every):
            raise ValueError(f"{names} are not the coordinates of {[f.names for f in fields]}")
        rest = [n for n in every if n not in listed]
        return [m for n in names for m in (rest if n == "*" else [n])]
    merged: list[str] = []
    for f in fields:
        shared = [n for n in f.names if n in merged]
        if merged and f.names and not shared and any(merged.index(a) == f.names.index(b) for a in merged for b in f.names):
            raise AmbiguousCoordinates(f"{merged} and {f.names}")
        merged += [n for n in f.names if n not in merged]
    orders = [f.names for i, f in enumerate(fields) if not any(set(f.names) <= set(g.names) for g in fields[:i])]  # others are permutations or parts
    left, out = list(merged), []
    while left:
        free = [n for n in left if not any(m in left and o.index(m) < o.index(n) for o in orders if n in o for m in o[: o.index(n)])]
        if not free:
            raise AmbiguousCoordinates(f"{[f.names for f in fields]} contradict each other in the order of {left}")
        out.append(free[0])
        left.remove(free[0])
    return out


def _few(field: Field) -> bool:
    """Whether the ranges of a field hold at most OUTER_CELLS cells; with open ranges Spark's own estimate decides how to join."""
    sizes = [c.end - c.begin if c.begin is not None and c.end is not None else None for c in field.coords]
    return not field.has_rec and None not in sizes and math.prod(sizes) <= OUTER_CELLS


def domain(fields: list[Field], mode: str, names: list[str]) -> tuple[Coord, ...]:
    """The ranges of a result: for each coordinate the hull of the operands' ranges (``inclusive``), what they share
    (``intersect``), or that of the first operand that has it (``first``). A range that an operand leaves open is open."""
    from ..field import Coord

    out = []
    for name in names:
        own = [c for f in fields for c in f.coords if c.name == name]
        if mode == "first":
            own = own[:1]
        begin, end = [c.begin for c in own], [c.end for c in own]
        low, high = (max, min) if mode == "intersect" else (min, max)
        b, e = None if None in begin else low(begin), None if None in end else high(end)
        if b is not None and e is not None:
            e = max(b, e)
        cycles = {c.cycle for c in own}
        out.append(Coord(name, b, e, cycles.pop() if len(cycles) == 1 else None))
    return tuple(out)


def _closed(coords) -> bool:
    return all(c.begin is not None and c.end is not None for c in coords)


def lattice(spark: SparkSession, coords: tuple[Coord, ...], records: DataFrame | None = None) -> DataFrame:
    """All cells of a box, for each of ``records`` if given: the longest axis is dealt over tasks, the others follow it."""
    sizes = {c.name: c.end - c.begin for c in coords}
    if records is None:
        longest = max(coords, key=lambda c: sizes[c.name], default=None)
        df = spark.range(1).select() if longest is None else spark.range(longest.begin, longest.end).withColumnRenamed("id", longest.name)
        rest = [c for c in coords if c is not longest]
    else:
        df, rest = records, list(coords)
    for c in rest:
        axis = F.sequence(F.lit(c.begin), F.lit(c.end - 1)).cast("array<bigint>")
        df = df.withColumn(c.name, F.explode(axis if sizes[c.name] else F.array().cast("array<bigint>")))
    return df


def _inside(coords) -> Column:
    return fold(lambda a, b: a & b, [(F.col(c.name) >= c.begin) & (F.col(c.name) < c.end) for c in coords], F.lit(True))


def _covers(fields: list[Field], box: tuple[Coord, ...]) -> bool:
    """Whether the operands' boxes leave no cell of ``box``: one of them is the box, or they follow each other along one axis."""
    ranges = [{c.name: (c.begin, c.end) for c in f.coords} for f in fields]
    whole = {c.name: (c.begin, c.end) for c in box}
    if whole in ranges:
        return True
    apart = {n for r in ranges for n in whole if r.get(n) != whole[n]}
    if len(apart) > 1:
        return False
    (name,) = apart
    at = whole[name][0]
    for b, e in sorted(r[name] for r in ranges):
        if b > at:
            return False
        at = max(at, e)
    return at >= whole[name][1]


def aligned(fields: list[Field], mode: str = "inclusive", names: list[str] | None = None) -> Field:
    """One frame of all operands: the coordinates, v0, v1, ... and in0, in1, ...: whether the cell is in that operand.

    The result has the ranges of ``domain``. An operand that lacks a coordinate is spread over it. Where all ranges
    are known, the result doesn't depend on the order of operands: it has the cells that any of them has (``intersect``:
    that all have; ``first``: that lie in the first one's ranges), and as missing cells those of the domain that lie in
    nobody's ranges. Cells come from a join of the operands where their boxes leave no gap, else from a lattice of the
    domain that each operand is joined to. Where one operand has all coordinates and the domain's ranges, and with open
    ranges, an operand with fewer coordinates reaches only the cells that others have rows for.

    An operand that shares nothing with those before it spans the product of their cells and its own, within a record;
    it is broadcast if its ranges have OUTER_CELLS cells at most, and the product has as many cells as both have in any case.
    ``names`` orders the coordinates where their order in the operands leaves it open, as with two single axes.
    """
    from ..field import Field

    names = merged_names(fields, names)
    box = domain(fields, mode, names)
    rec = any(f.has_rec for f in fields)
    keys = (["rec"] if rec else []) + names
    frames = [f.df.select(*f.keys, F.col("v").alias(f"v{i}"), F.lit(True).alias(f"in{i}")) for i, f in enumerate(fields)]
    whole = [set(f.keys) == set(keys) for f in fields]
    df = _over_lattice(fields, frames, box, mode) if _has_gaps(fields, whole, box, mode) else _joined(fields, frames, whole, mode)
    df = df.select(*keys, *[c for i in range(len(fields)) for c in (f"v{i}", F.coalesce(f"in{i}", F.lit(False)).alias(f"in{i}"))])
    kind = max((f.kind for f in fields), key=["int", "double"].index)
    return Field(df, box, rec, kind, fields[0].meta)


def _has_gaps(fields: list[Field], whole: list[bool], box: tuple[Coord, ...], mode: str) -> bool:
    """Whether the domain has cells that no join of the operands would give."""
    if mode == "intersect" or not all(_closed(f.coords) for f in fields):
        return False
    if mode == "first":
        return not whole[0]
    return not _covers(fields, box) if all(whole) else not any(w and _same_box(f, box) for w, f in zip(whole, fields))


def _same_box(field: Field, box: tuple[Coord, ...]) -> bool:
    return {(c.name, c.begin, c.end) for c in field.coords} == {(c.name, c.begin, c.end) for c in box}


def _over_lattice(fields: list[Field], frames: list[DataFrame], box: tuple[Coord, ...], mode: str) -> DataFrame:
    """Each operand on the cells of the domain; what no operand has stays only if it lies in no operand's ranges."""
    with_rec = [f for f in fields if f.has_rec]
    records = None
    if with_rec:
        used = with_rec[:1] if mode == "first" else with_rec
        records = fold(lambda a, b: a.union(b), [f.df.select("rec") for f in used]).distinct()
    df = lattice(fields[0].df.sparkSession, box, records)
    for f, frame in zip(fields, frames):
        df = df.join(frame, f.keys, "left") if f.keys else df.crossJoin(F.broadcast(frame))  # one number
    found = fold(lambda a, b: a | b, [F.col(f"in{i}").isNotNull() for i in range(len(fields))])
    return df.where(found | ~fold(lambda a, b: a | b, [_inside(f.coords) for f in fields]))


def _joined(fields: list[Field], frames: list[DataFrame], whole: list[bool], mode: str) -> DataFrame:
    """Operands with all coordinates meet first, those with fewer are joined to the cells that are there then."""
    order = range(len(fields)) if mode != "inclusive" else sorted(range(len(fields)), key=lambda i: not whole[i])
    df, have = None, []
    for i in order:
        f = fields[i]
        if df is None:
            df, have = frames[i], list(f.keys)
            continue
        on = [k for k in have if k in f.keys]
        if not on:  # an outer product is what is asked for here
            df = df.crossJoin(F.broadcast(frames[i]) if _few(f) else frames[i])
        else:
            how = HOW[mode] if set(have) == set(f.keys) else "left" if mode != "intersect" and set(f.keys) < set(have) else "inner"
            df = df.join(frames[i], on, how)
        have += [k for k in f.keys if k not in have]
    return df
