"""Fields: cells keyed by a record and named integer coordinates, with a value that may be missing (NULL)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scalar import DEFINED, INT_KIND, LAZY, OPERATORS, TERNARY
from .meta import Meta
from .operators import align, reduce, shape

REC = "rec"


@dataclass(frozen=True)
class Coord:
    """A half-open range [begin, end) of an integer axis; ``cycle`` is its length where it closes on itself."""

    name: str
    begin: int | None = None
    end: int | None = None
    cycle: int | None = None


@dataclass(frozen=True)
class Field:
    """``df`` has a column for each coordinate, ``rec`` if there are records, and the value ``v``.

    A coordinate that a field doesn't have is spread over by whatever it meets. Operators only add to the plan; a cell
    that has no row is outside, a row with NULL is a missing cell.
    """

    df: DataFrame
    coords: tuple[Coord, ...]
    has_rec: bool = False
    kind: str = "double"
    meta: Meta = field(default_factory=Meta)

    @classmethod
    def of(cls, df: DataFrame, value: Column | str, coords: list[str | Coord], rec: Column | str | None = None, **about) -> Field:
        """A field of ``df``; ``about`` is what ``titled`` takes."""
        made = tuple(c if isinstance(c, Coord) else Coord(c) for c in coords)
        col = lambda x: F.col(x) if isinstance(x, str) else x
        keys = [col(rec).alias(REC)] if rec is not None else []
        return cls(df.select(*keys, *[F.col(c.name) for c in made], col(value).cast("double").alias("v")), made, rec is not None, meta=Meta(**about))

    @classmethod
    def of_frame(cls, df: DataFrame) -> Field:
        """The field that ``frame`` made, from the metadata of its columns; a column without metadata is no coordinate."""
        about = {c.name: c.metadata for c in df.schema.fields}
        coords = sorted((m["gridloom"]["place"], Coord(n, *(m["gridloom"].get(k) for k in ("begin", "end", "cycle")))) for n, m in about.items() if "place" in m.get("gridloom", {}))
        kept = about.get("v", {}).get("gridloom", {})
        made = tuple(c for _, c in coords)
        return cls(df.select(*([REC] if REC in df.columns else []), *[c.name for c in made], "v"), made, REC in df.columns, kept.get("kind", "double"), Meta.of(kept))

    def frame(self) -> DataFrame:
        """The cells, with ranges, kind, item, title, unit and missing value as metadata of the columns, which Parquet keeps."""
        coord = lambda i, c: {"gridloom": {"place": i} | {k: v for k, v in (("begin", c.begin), ("end", c.end), ("cycle", c.cycle)) if v is not None}}
        about = {"gridloom": {"kind": self.kind} | self.meta.kept()}
        return self.df.select(*([REC] if self.has_rec else []), *[F.col(c.name).alias(c.name, metadata=coord(i, c)) for i, c in enumerate(self.coords)], F.col("v").alias("v", metadata=about))

    def titled(self, **about) -> Field:
        """The same with another item, title, unit or missing value (of files; cells that miss are NULL)."""
        return replace(self, meta=replace(self.meta, **about))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.coords]

    @property
    def keys(self) -> list[str]:
        return ([REC] if self.has_rec else []) + self.names

    def _with(self, df: DataFrame, name: str = "", **changes) -> Field:
        return replace(self, df=df, kind="int" if name in INT_KIND else self.kind, **changes)

    def map(self, name: str, *args: float) -> Field:
        """A unary operator, or one whose other operands are numbers; no join. Of two operands, more are taken one after another."""
        f, numbers = OPERATORS[name], [F.lit(float(a)) for a in args]
        one_by_one = len(numbers) > 1 and name not in TERNARY
        value = fold(f, numbers, F.col("v")) if one_by_one else f(F.col("v"), *numbers)
        return self._with(self.df.withColumn("v", value), name, meta=self.meta.after(name, *args))

    def op(self, name: str, *others: Field | float, mode: str = "inclusive", names: list[str] | None = None) -> Field:
        """An operator, aligned by coordinate names, of which ``names`` can give the order; numbers need no join.

        Of operators of two operands, more are taken one after another from the left. A number is inside everywhere.
        """
        if not any(isinstance(o, Field) for o in others):
            return self.map(name, *others)
        if name in DEFINED:
            raise ValueError(f"{name} has one operand: use map")
        if name in TERNARY and len(others) != 2:
            raise ValueError(f"{name} has three operands")
        fields = [self, *[o for o in others if isinstance(o, Field)]]
        out = align.aligned(fields, "intersect" if name in TERNARY and mode == "inclusive" else mode, names)
        place = {id(o): i for i, o in reversed(list(enumerate(fields)))}
        operands = [(F.col(f"v{place[id(o)]}"), F.col(f"in{place[id(o)]}")) if isinstance(o, Field) else (F.lit(float(o)), F.lit(True)) for o in (self, *others)]
        if name in LAZY:
            value = fold(lambda a, b: (LAZY[name](a[0], b[0], a[1], b[1]), a[1] | b[1]), operands)[0]
        elif name in TERNARY:
            value = OPERATORS[name](*[v for v, _ in operands])
        else:
            value = fold(OPERATORS[name], [v for v, _ in operands])
        meta = self.meta.after(name, *[o.meta if isinstance(o, Field) else o for o in others])
        return replace(out, df=out.df.select(*out.keys, value.alias("v")), kind="int" if name in INT_KIND else out.kind, meta=meta)

    def complete(self) -> Field:
        """With a missing cell wherever the ranges have a cell without a row, in each record that has any."""
        if not align._closed(self.coords):
            raise ValueError("to complete a field, its ranges must be known")
        cells = align.lattice(self.df.sparkSession, self.coords, self.df.select(REC).distinct() if self.has_rec else None)
        absent = cells.join(self.df, self.keys, "left_anti").select(*self.keys, F.lit(None).cast("double").alias("v"))
        return replace(self, df=self.df.select(*self.keys, "v").unionByName(absent))

    def reduce(self, name: str, *over: str, weight: Field | None = None, ranges: dict[str, tuple[int, int]] | None = None) -> Field:
        return reduce.reduced(self, name, list(over), weight, ranges or {})

    def select(self, **ranges: int | tuple[int | None, int | None]) -> Field:
        return shape.selected(self, ranges)

    def shift(self, name: str, by: int, cycle: int | None = None) -> Field:
        return shape.shifted(self, name, by, cycle)

    def rename(self, **names: str) -> Field:
        return shape.renamed(self, names)

    def permute(self, *names: str) -> Field:
        return shape.permuted(self, list(names))

    def spread(self, name: str, begin: int, end: int) -> Field:
        return shape.spread(self, name, begin, end)

    def index(self, name: str) -> Field:
        return shape.index(self, name)

    def flat(self, *names: str) -> Field:
        return shape.flat(self, list(names))

    def records(self, begin: int = 0, end: int | None = None, step: int = 1, number: int = 1) -> Field:
        from .operators import records

        return records.selected(self, begin, end, step, number)

    def properties(self) -> DataFrame:
        """One row: item, title, unit, kind, shape, and from the cells n_cells, n_missing, low and high."""
        from .meta import properties

        return properties([self])

    def cells(self, defined_only: bool = False) -> DataFrame:
        """The cells in order; with ``defined_only`` without the missing ones."""
        df = self.df.where(F.col("v").isNotNull()) if defined_only else self.df
        order = [*([REC] if self.has_rec else []), *reversed(self.names)]
        return df.orderBy(*order) if order else df
