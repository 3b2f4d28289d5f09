"""What is known of a field besides its cells: item, title, unit, missing value; kept by operators and listed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as fold
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalar import TERNARY

if TYPE_CHECKING:
    from .field import Field

#: How operators are written between operands, and how tightly they bind.
INFIX = {"ADD": ("+", 1), "SUB": ("-", 1), "MUL": ("*", 2), "DIV": ("/", 2)}
TIGHTEST = 9


@dataclass(frozen=True)
class Meta:
    """``item`` is a name or, of a result, its operands and operators in postfix order; ``title`` the same as a formula.

    ``binding`` says how tightly the title's outermost operator binds. ``missing`` is the number for missing cells in files.
    """

    item: str = ""
    title: str = ""
    unit: str = ""
    missing: float | None = None
    binding: int = TIGHTEST

    @classmethod
    def of(cls, kept: dict) -> Meta:
        return cls(**{k: kept[k] for k in ("item", "title", "unit", "missing", "binding") if k in kept})

    def kept(self) -> dict:
        """For the metadata of a column."""
        return {k: v for k, v in (("item", self.item), ("title", self.title), ("unit", self.unit), ("missing", self.missing), ("binding", self.binding)) if v is not None}

    def after(self, name: str, *others: Meta | float) -> Meta:
        """Of the result of an operator; unit and missing value are those of the first operand."""
        all_ = [self, *[o if isinstance(o, Meta) else Meta(f"{o:g}", f"{o:g}") for o in others]]
        words = [m.item or "?" for m in all_]
        item = fold(lambda a, b: f"{a} {b} {name}", words) if len(all_) > 1 and name not in TERNARY else " ".join([*words, name])
        names = [(m.title or m.item or "?", m.binding) for m in all_]
        if name in INFIX and len(all_) > 1:
            sign, binding = INFIX[name]

            def written(left: tuple[str, int], right: tuple[str, int]) -> tuple[str, int]:
                a = f"({left[0]})" if left[1] < binding else left[0]
                b = f"({right[0]})" if right[1] < binding or right[1] == binding and sign in "-/" else right[0]
                return f"{a}{sign}{b}", binding

            title, binding = fold(written, names)
        else:
            title, binding = f"{name}({','.join(t for t, _ in names)})", TIGHTEST
        return Meta(item, title, self.unit, self.missing, binding)

    def reduced(self, name: str, over: list[str]) -> Meta:
        names = ",".join(over)
        return Meta(f"{self.item or '?'} {name}={names}", f"{name}({self.title or self.item or '?'};{names})", self.unit, self.missing)


def shape_of(field: Field) -> str:
    """Like ``[lon/0:8 lat/0:4]``, open ends left out."""
    end = lambda x: "" if x is None else str(x)
    return "[" + " ".join(f"{c.name}/{end(c.begin)}:{end(c.end)}" for c in field.coords) + "]"


def properties(fields: list[Field]) -> DataFrame:
    """A row for each field, in order: position, item, title, unit, kind, shape, n_records, n_cells, n_missing, low, high.

    What is known is metadata; the numbers are one aggregate of each field's cells.
    """
    rows = []
    for i, f in enumerate(fields):
        known = [F.lit(i).alias("position"), *[F.lit(x).alias(k) for k, x in (("item", f.meta.item), ("title", f.meta.title or f.meta.item), ("unit", f.meta.unit), ("kind", f.kind), ("shape", shape_of(f)))]]
        n = F.countDistinct("rec") if f.has_rec else F.lit(1).cast("long")
        rows.append(f.df.agg(n.alias("n_records"), F.count("*").alias("n_cells"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.min("v").alias("low"), F.max("v").alias("high")).select(*known, "n_records", "n_cells", "n_missing", "low", "high"))
    return fold(lambda a, b: a.union(b), rows)
