"""Record selection and running several record sequences in step."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..field import Field


class InsufficientRecords(ValueError):
    """Sequences that run in step have different numbers of records."""


def selected(field: Field, begin: int = 0, end: int | None = None, step: int = 1, number: int = 1) -> Field:
    """Records begin, begin + step, ... before ``end``, ``number`` consecutive ones of each (0: the whole step).

    ``rec`` becomes the turn; with several a turn, a coordinate ``slot`` tells them apart. Filters on ``rec`` reach
    the scan.
    """
    from ..field import Coord

    rec = F.col("rec")
    number = number or step
    df = field.df.where(rec >= begin) if end is None else field.df.where((rec >= begin) & (rec < end))
    slot = F.pmod(rec - begin, F.lit(step))
    df = df.where(slot < number) if number < step else df
    turn = F.floor((rec - begin) / step).cast("long")
    if number == 1:
        return replace(field, df=df.withColumn("rec", turn))
    return replace(field, df=df.withColumn("slot", slot).withColumn("rec", turn), coords=(*field.coords, Coord("slot", 0, number)))


def listed(field: Field, wanted: list[int]) -> Field:
    """The records ``wanted``, one a turn, in that order; a record may come several times."""
    turns: dict[int, list[int]] = {}
    for turn, rec in enumerate(wanted):
        turns.setdefault(rec, []).append(turn)
    where = F.create_map(*[x for rec, of in turns.items() for x in (F.lit(rec).cast("long"), F.array(*[F.lit(t).cast("long") for t in of]))]) if turns else None
    df = field.df.where(F.col("rec").isin(list(turns)) if turns else F.lit(False))
    return replace(field, df=df if where is None else df.withColumn("rec", F.explode(where[F.col("rec").cast("long")])))


def tuples(field: Field, wanted: list[tuple[int, ...]]) -> list[Field]:
    """One operand for each member of tuples of records: turn i has the records of ``wanted[i]``.

    Selections of one source can be used together as they are: ``tuples(a, [(1, 2), (3, 4)]) + [listed(a, [5, 6])]``.
    """
    if len({len(t) for t in wanted}) > 1:
        raise ValueError("tuples of records differ in length")
    return [listed(field, list(members)) for members in zip(*wanted)]


def count(field: Field) -> int:
    """Number of records, rec being 0, 1, ...."""
    last = field.df.agg(F.max("rec")).first()[0]
    return 0 if last is None else last + 1


def counted(field: Field) -> Column:
    """The same as a subquery of the plan that uses it."""
    return field.df.agg(F.coalesce(F.max("rec") + 1, F.lit(0)).cast("long")).scalar()


def in_step(fields: list[Field], modes: list[str]) -> list[Field]:
    """Bring sequences to one number of turns: the longest, or that of those that end the run.

    ``terminate``: ends the run; several must be as long as each other, else InsufficientRecords (to know, they are
    counted here). ``cyclic``: starts again. ``persistent``: keeps its last record. Numbers of records are otherwise
    subqueries of the plan, so that building it runs no job.
    """
    ends = [f for f, m in zip(fields, modes) if m == "terminate"]
    if len(ends) > 1:
        found = [count(f) for f in ends]
        if len(set(found)) > 1:
            raise InsufficientRecords(f"{min(found)} of {max(found)} records")
    numbers = [counted(f) for f in fields]
    turns = counted(ends[0]) if ends else F.greatest(*numbers) if len(numbers) > 1 else numbers[0]
    return [f if m == "terminate" else replace(f, df=_repeated(f.df, k, turns, m)) for f, k, m in zip(fields, numbers, modes)]


def _repeated(df: DataFrame, k: Column, turns: Column, mode: str) -> DataFrame:
    columns = df.columns
    df = df.withColumn("rec", F.col("rec").cast("long")).withColumn("__k", k).withColumn("__turns", turns)
    rec, k, turns = F.col("rec"), F.col("__k"), F.col("__turns")
    if mode == "cyclic":
        again = F.when(rec < turns, F.sequence(rec, turns - 1, k))
    else:
        again = F.when(rec < F.least(k, turns) - 1, F.array(rec)).when(rec == k - 1, F.sequence(rec, F.greatest(rec, turns - 1)))
    return df.withColumn("rec", F.explode(again)).where(F.col("rec") < turns).select(*columns)


def first_matching(field: Field, predicate) -> DataFrame:
    """The first record that has a cell for which ``predicate`` (a Column) holds."""
    return field.df.where(predicate).agg(F.min("rec").alias("rec"))
