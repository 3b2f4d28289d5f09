"""Cell-wise operators as Column functions. NULL is a missing cell; NaN is a value.

Strict operators give NULL when any operand is NULL. ``inside`` flags say whether a cell exists in an operand at all
(see ``operators.align``); without a flag a cell counts as inside. All are built-in expressions, so Catalyst folds and
compiles them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Op = Callable[..., Column]


def _both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def _whole(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` by way of integers; NaN, and values of 2**52 and more, which have no fraction, stay as they are."""
    return F.when(F.abs(x) < 2.0**52, f(x).cast("double")).otherwise(x.cast("double"))


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def trunc(x: Column) -> Column:
    return _whole(x, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def as_int(x: Column) -> Column:
    """The 32-bit integer of a value; NULL beyond its range."""
    return F.when(x.between(-2147483648.0, 2147483647.0), trunc(x)).cast("int")


def round_away(x: Column) -> Column:
    """To the nearest integer, halves away from zero."""
    return _whole(x, lambda x: F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)))


def zsign(x: Column) -> Column:
    return F.when(x < 0, -1.0).when(x > 0, 1.0).when(x == 0, 0.0)


def sign1(x: Column) -> Column:
    return F.when(x < 0, -1.0).when(x.isNotNull(), 1.0)


def _guard(ok: Callable[[Column], Column], f: Op) -> Op:
    return lambda x: F.when(ok(x), f(x))


UNARY: dict[str, Op] = {
    "NEG": lambda x: -x,
    "INV": lambda x: F.when(x != 0, F.lit(1.0) / x),
    "ABS": F.abs,
    "SQR": lambda x: x * x,
    "SIGN1": sign1,
    "ZSIGN": zsign,
    "FLOOR": floor,
    "CEIL": lambda x: _whole(x, F.ceil),
    "ROUND": round_away,
    "TRUNC": trunc,
    "INT": trunc,
    "FLOAT": lambda x: x.cast("double"),
    "BITNOT": lambda x: F.bitwise_not(as_int(x)).cast("double"),
    "SQRT": _guard(lambda x: x >= 0, F.sqrt),
    "EXP": F.exp,
    "LOG": _guard(lambda x: x > 0, F.ln),
    "LOG10": _guard(lambda x: x > 0, F.log10),
    "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan,
    "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ASINH": F.asinh, "ACOSH": F.acosh, "ATANH": F.atanh,
    "R2D": F.degrees, "D2R": F.radians,
    "FTRUNC": lambda x: x.cast("float").cast("double"),
}

DEFINED: dict[str, Op] = {
    "NOT": lambda x, inside=None: F.when(x.isNull() if inside is None else x.isNull() & inside, 1.0),
    "BOOL": lambda x, inside=None: F.when(x.isNotNull(), 1.0),
    "BIN": lambda x, inside=None: x.isNotNull().cast("double"),
}

_COMPARE: dict[str, Op] = {
    "EQ": lambda a, b: a == b, "NE": lambda a, b: a != b, "LT": lambda a, b: a < b,
    "GT": lambda a, b: a > b, "LE": lambda a, b: a <= b, "GE": lambda a, b: a >= b,
}


def _compare(test: Op) -> tuple[Op, Op, Op]:
    return (lambda a, b: test(a, b).cast("double"), lambda a, b: F.coalesce(test(a, b), F.lit(False)).cast("double"), lambda a, b: F.when(test(a, b), a))


#: EQ..GE: 1 or 0, NULL if an operand is; EQU..GEU are the same. EQB..GEB: 0 if an operand is NULL. EQF..GEF: the first where true.
COMPARE: dict[str, Op] = {"ID": lambda a, b: F.when(a.eqNullSafe(b), 1.0)}
for _name, _test in _COMPARE.items():
    _strict, _binary, _filter = _compare(_test)
    COMPARE |= {_name: _strict, _name + "U": _strict, _name + "B": _binary, _name + "F": _filter}


def _shift(a: Column, n: Column) -> Column:
    """Logical shift of 32-bit integers, left for n > 0 and right for n < 0; by 32 and more gives 0."""
    bits, by = as_int(a), as_int(n)
    left = F.call_function("shiftleft", bits, by)
    right = F.call_function("shiftrightunsigned", bits, -by)
    return F.when(by >= 32, 0).when(by <= -32, 0).when(by >= 0, left).otherwise(right).cast("double")


STRICT: dict[str, Op] = {
    "AND": lambda a, b: F.when(a.isNotNull(), b),
    "MASK": lambda a, b: F.when(b.isNotNull(), a),
    "ADD": lambda a, b: a + b,
    "SUB": lambda a, b: a - b,
    "MUL": lambda a, b: a * b,
    "DIV": lambda a, b: F.when(b != 0, a / b),
    "RDIV": lambda a, b: F.when(b != 0, a / b),
    "IDIV": lambda a, b: F.when(trunc(b) != 0, trunc(trunc(a) / trunc(b))),
    "MOD": lambda a, b: F.when(b != 0, a % b),
    "MODULO": lambda a, b: F.when(b != 0, (a % b) + F.when((a % b != 0) & ((a % b < 0) != (b < 0)), b).otherwise(0.0)),
    "POW": lambda a, b: F.when(~((a == 0) & (b <= 0)) & ~((a < 0) & (floor(b) != b)), F.pow(a, b)),
    "SIGN": lambda a, b: F.when(b < 0, -F.abs(a)).when(b.isNotNull(), F.abs(a)),
    "BITAND": lambda a, b: as_int(a).bitwiseAND(as_int(b)).cast("double"),
    "BITOR": lambda a, b: as_int(a).bitwiseOR(as_int(b)).cast("double"),
    "BITXOR": lambda a, b: as_int(a).bitwiseXOR(as_int(b)).cast("double"),
    "LSHIFT": _shift,
    "RSHIFT": lambda a, b: _shift(a, -b),
    "MIN": lambda a, b: F.when(_both(a, b), F.least(a, b)),
    "MAX": lambda a, b: F.when(_both(a, b), F.greatest(a, b)),
    "ATAN2": F.atan2,
    "HYPOT": F.hypot,
    "SCALE": lambda a, b: a * F.pow(F.lit(2.0), trunc(b)),
}

def _laid(inside: Column | None, there: Column, elsewhere: Column) -> Column:
    return there if inside is None else F.when(inside, there).otherwise(elsewhere)


#: Lazy operators; a_in and b_in say whether the cell exists in the operands (None: it does).
LAZY: dict[str, Op] = {
    "OR": lambda a, b, a_in=None, b_in=None: F.coalesce(a, b),
    "ROR": lambda a, b, a_in=None, b_in=None: F.coalesce(b, a),
    "XOR": lambda a, b, a_in=None, b_in=None: F.when(a.isNull(), b).when(b.isNull(), a),
    "LAND": lambda a, b, a_in=None, b_in=None: _laid(b_in, F.when(a.isNotNull(), b), a),
    "LMASK": lambda a, b, a_in=None, b_in=None: _laid(b_in, F.when(b.isNotNull(), a), a),
    "LLAY": lambda a, b, a_in=None, b_in=None: _laid(a_in, a, b),
    "RLAY": lambda a, b, a_in=None, b_in=None: _laid(b_in, b, a),
    "LADD": lambda a, b, a_in=None, b_in=None: F.coalesce(a + b, a, b),
    "LSUB": lambda a, b, a_in=None, b_in=None: F.coalesce(a - b, a),
    "LMUL": lambda a, b, a_in=None, b_in=None: F.coalesce(a * b, a, b),
    "LDIV": lambda a, b, a_in=None, b_in=None: F.when(~_both(a, b), a).when(b != 0, a / b),
    "LMIN": lambda a, b, a_in=None, b_in=None: F.least(a, b),
    "LMAX": lambda a, b, a_in=None, b_in=None: F.greatest(a, b),
}
LAZY |= {"LOR": LAZY["OR"], "LAY": LAZY["LLAY"]}

#: All three must be inside, which an inner join sees to.
TERNARY: dict[str, Op] = {
    "IFELSE": lambda a, b, c: F.when(a.isNotNull(), b).otherwise(c),
    "INRANGE": lambda a, b, c: F.when(a.between(b, c), a),
    "BLEND": lambda a, b, c: a * c + b * (F.lit(1.0) - c),
}


HUGE_INT = 2147483647.0


def _pow2(k: Column) -> tuple[Column, Column]:
    """Two factors whose product is 2**k; each is a double where the product may not be."""
    half = F.floor(k / 2)
    return F.pow(F.lit(2.0), half), F.pow(F.lit(2.0), k - half)


def _parts(x: Column) -> tuple[Column, Column]:
    """Fraction in [0.5, 1), with the sign, and exponent of finite values that aren't 0; exact, as all steps are by powers of 2."""
    small = F.abs(x) < 2.0**-1022
    y = F.when(small, x * 2.0**54).otherwise(x)
    guess = F.floor(F.log2(F.abs(y))).cast("double")
    a, b = _pow2(guess)
    f = y / a / b
    off = F.when(F.abs(f) >= 2, 1.0).when(F.abs(f) < 1, -1.0).otherwise(0.0)  # the logarithm may be off by one next to a power of 2
    return f / F.pow(F.lit(2.0), off + 1), guess + off + 1 - F.when(small, 54.0).otherwise(0.0)


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < math.inf)


def fraction(x: Column) -> Column:
    return F.when(x == 0, x).when(_finite(x), _parts(x)[0]).when(x.isNotNull(), math.nan)


def exponent(x: Column) -> Column:
    """0 for 0; of NaN and infinity the largest 32-bit integer, as they have none."""
    return F.when(x == 0, 0.0).when(_finite(x), _parts(x)[1]).when(x.isNotNull(), HUGE_INT)


def spacing(x: Column) -> Column:
    a, b = _pow2(F.greatest(_parts(x)[1] - 53, F.lit(-1022.0)))
    return F.when(x == 0, 2.0**-1022).when(_finite(x), a * b).when(x.isNotNull(), math.nan)


def nearest(x: Column, toward: Column) -> Column:
    """The next value that there is, up or (``toward`` below 0) down."""
    way = F.when(toward < 0, -1.0).otherwise(1.0)
    f, e = _parts(x)
    inward = (x > 0) != (way > 0)
    a, b = _pow2(F.greatest(e - 53 - F.when(inward & (F.abs(f) == 0.5), 1.0).otherwise(0.0), F.lit(-1074.0)))
    beyond = F.when(inward, F.signum(x) * float(np.finfo(float).max)).otherwise(x)
    return F.when(F.isnan(x) | F.isnan(toward), math.nan).when(x == 0, way * 5e-324).when(_finite(x), x + way * (a * b)).otherwise(beyond)


def set_exponent(x: Column, e: Column) -> Column:
    a, b = _pow2(trunc(e))
    return F.when(x == 0, x).when(F.isnan(e), math.nan).otherwise(fraction(x) * a * b)


BITS: dict[str, Op] = {
    "FRACTION": fraction,
    "EXPONENT": exponent,
    "SPACING": spacing,
    "RRSP": lambda x: F.abs(fraction(x)) * F.lit(2.0**53),
    "NEAREST": lambda a, b: F.when(_both(a, b), nearest(a, b)),
    "SETE": lambda a, b: F.when(_both(a, b), set_exponent(a, b)),
}

CONSTANTS = {"PI": float(np.pi), "E": float(np.e), "HUGE": float(np.finfo(float).max), "TINY": float(np.finfo(float).tiny)}

OPERATORS: dict[str, Op] = UNARY | DEFINED | COMPARE | STRICT | LAZY | TERNARY | BITS
#: Operators whose result is an integer by kind, which only a sink looks at.
INT_KIND = {"SIGN1", "ZSIGN", "FLOOR", "CEIL", "ROUND", "INT", "BITNOT", "IDIV", "BITAND", "BITOR", "BITXOR", "LSHIFT", "RSHIFT", "EXPONENT", "COUNT", *DEFINED, *COMPARE} - {k for k in COMPARE if k[-1] == "F"}


def register(name: str, f: Op) -> None:
    """Add an operator of one's own: a function of Columns."""
    OPERATORS[name] = f
