"""Slices, shifts, renaming, permutation, spreading and index fields."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..field import Field


def _coord(field: Field, name: str):
    found = [c for c in field.coords if c.name == name]
    if not found:
        raise KeyError(f"no coordinate {name}")
    return found[0]


def selected(field: Field, ranges: dict) -> Field:
    """Keep [begin, end) of each named coordinate, either end open; a single integer is one element. Reaches the scan."""
    df, coords = field.df, list(field.coords)
    for name, r in ranges.items():
        c = _coord(field, name)
        b, e = (r, r + 1) if isinstance(r, int) else r
        df = df.where(F.col(name) >= b) if b is not None else df
        df = df.where(F.col(name) < e) if e is not None else df
        coords[coords.index(c)] = replace(c, begin=c.begin if b is None else b, end=c.end if e is None else e)
    return replace(field, df=df, coords=tuple(coords))


def shifted(field: Field, name: str, by: int, cycle: int | None = None) -> Field:
    """Move cells ``by`` along a coordinate. With ``cycle`` its range stays, and what leaves comes in at the other end.

    Of a circular axis, cell c of the range [begin, end) is read from begin + (c - by - begin) mod cycle, and what lies
    beyond the range after that is lost.
    """
    c = _coord(field, name)
    x = F.col(name)
    if cycle is None:
        bounds = {"begin": None if c.begin is None else c.begin + by, "end": None if c.end is None else c.end + by}
        coords = tuple(replace(k, **bounds) if k is c else k for k in field.coords)
        return replace(field, df=field.df.withColumn(name, x + by), coords=coords)
    if c.begin is None or c.end is None:
        raise ValueError("a circular shift needs the coordinate's range")
    if cycle < c.end - c.begin:
        raise ValueError("the cycle is shorter than the range")
    moved = field.df.withColumn(name, F.pmod(x + by - c.begin, F.lit(cycle)) + c.begin)
    return replace(field, df=moved.where(F.col(name) < c.end), coords=tuple(replace(k, cycle=cycle) if k is c else k for k in field.coords))


def renamed(field: Field, names: dict[str, str]) -> Field:
    for name in names:
        _coord(field, name)
    return replace(field, df=field.df.withColumnsRenamed(names), coords=tuple(replace(c, name=names.get(c.name, c.name)) for c in field.coords))


def permuted(field: Field, names: list[str]) -> Field:
    """The named coordinates first, in that order; the others follow."""
    first = [_coord(field, n) for n in names]
    return replace(field, coords=tuple(first + [c for c in field.coords if c.name not in names]))


def spread(field: Field, name: str, begin: int, end: int) -> Field:
    """Repeat the cells along a new coordinate of the range [begin, end)."""
    from ..field import Coord

    if name in field.names:
        raise ValueError(f"{name} exists")
    df = field.df.withColumn(name, F.explode(F.sequence(F.lit(begin), F.lit(end - 1)).cast("array<bigint>"))) if end > begin else field.df.where("false").withColumn(name, F.lit(0).cast("long"))
    return replace(field, df=df, coords=(*field.coords, Coord(name, begin, end)))


def index(field: Field, name: str) -> Field:
    """The place along a coordinate as a value of each cell."""
    _coord(field, name)
    return replace(field, df=field.df.withColumn("v", F.col(name).cast("double")), kind="int")


def flat(field: Field, names: list[str]) -> Field:
    """The flat place along the named coordinates (none: all), the first running fastest; those come to the front."""
    out = permuted(field, names)
    used = out.coords[: len(names) or None]
    if any(c.begin is None or c.end is None for c in used[:-1]):
        raise ValueError("a flat index needs the coordinates' ranges")
    value, stride = F.lit(0).cast("long"), 1
    for c in used:
        value = value + (F.col(c.name) - (c.begin or 0)) * stride
        stride *= (c.end - c.begin) if c.end is not None else 1
    return replace(out, df=out.df.withColumn("v", value.cast("double")), kind="int")
