"""Queries of the cell-wise operators: each a table, its keys, and for each column the operator and what SQL says of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import BITS, COMPARE, DEFINED, OPERATORS, STRICT, TERNARY, UNARY

D = "DOUBLE"


def _d(x: str) -> Column:
    return F.col(x).cast("double")


def _micro(x: Column) -> Column:
    """Millionths, as integers: the last places of a transcendental function differ between libraries."""
    return F.round(x * 1e6).cast("long")


def _micro_sql(x: str) -> str:
    return f"CAST(round(({x}) * 1e6) AS BIGINT)"


def _unary() -> tuple:
    s = "c_acctbal"
    sql = {
        "NEG": f"-{s}", "INV": f"CASE WHEN {s} <> 0 THEN 1.0 / {s} END", "ABS": f"abs({s})", "SQR": f"{s} * {s}",
        "SIGN1": f"CASE WHEN {s} < 0 THEN -1.0::{D} ELSE 1.0::{D} END", "ZSIGN": f"CASE WHEN {s} < 0 THEN -1.0::{D} WHEN {s} > 0 THEN 1.0::{D} ELSE 0.0::{D} END",
        "FLOOR": f"floor({s}) + 0.0::{D}", "CEIL": f"CASE WHEN ceil({s}) = 0 THEN 0.0::{D} ELSE ceil({s}) END", "ROUND": f"CASE WHEN {s} < 0 THEN -floor(-{s} + 0.5) ELSE floor({s} + 0.5) END",
        "TRUNC": f"CASE WHEN trunc({s}) = 0 THEN 0.0::{D} ELSE trunc({s}) END", "INT": f"CASE WHEN trunc({s}) = 0 THEN 0.0::{D} ELSE trunc({s}) END", "FLOAT": f"{s}",
        "BITNOT": f"CAST(~CAST(trunc({s}) AS INTEGER) AS {D})", "FTRUNC": f"CAST(CAST({s} AS FLOAT) AS {D})",
    }
    return "customer", ["c_custkey"], [(k.lower(), lambda k=k: UNARY[k](_d(s)) + F.lit(0.0), f"({v}) + 0.0::{D}") for k, v in sql.items()]


def _float() -> tuple:
    x, s = (lambda: _d("p_retailprice") / 4096.0 - 0.25), "(p_retailprice / 4096.0::DOUBLE - 0.25::DOUBLE)"
    sql = {"SQRT": f"CASE WHEN {s} >= 0 THEN sqrt({s}) END", "LOG": f"CASE WHEN {s} > 0 THEN ln({s}) END", "LOG10": f"CASE WHEN {s} > 0 THEN log10({s}) END", "R2D": f"degrees({s})", "D2R": f"radians({s})"}
    sql |= {k: f"{k.lower()}({s})" for k in ("EXP", "SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "SINH", "COSH", "TANH", "ASINH", "ATANH")}
    rows = [(k.lower(), lambda k=k: _micro(UNARY[k](x())), _micro_sql(v)) for k, v in sql.items()]
    rows.append(("acosh", lambda: _micro(UNARY["ACOSH"](x() + 2.0)), _micro_sql(f"acosh({s} + 2.0)")))
    rows.append(("atan2", lambda: _micro(STRICT["ATAN2"](x(), _d("p_size"))), _micro_sql(f"atan2({s}, p_size)")))
    rows.append(("hypot", lambda: _micro(STRICT["HYPOT"](x(), _d("p_size"))), _micro_sql(f"sqrt({s} * {s} + p_size * p_size)")))
    rows.append(("scale", lambda: STRICT["SCALE"](x(), F.pmod(_d("p_size"), F.lit(8.0))), f"{s} * pow(2.0, p_size % 8)"))
    return "part", ["p_partkey"], rows


def _defined() -> tuple:
    x, s = (lambda: OPERATORS["GTF"](_d("o_totalprice"), F.lit(150000.0))), "CASE WHEN o_totalprice > 150000 THEN o_totalprice END"
    sql = {"NOT": f"CASE WHEN ({s}) IS NULL THEN 1.0::{D} END", "BOOL": f"CASE WHEN ({s}) IS NOT NULL THEN 1.0::{D} END", "BIN": f"CASE WHEN ({s}) IS NOT NULL THEN 1.0::{D} ELSE 0.0::{D} END"}
    return "orders", ["o_orderkey"], [(k.lower(), lambda k=k: DEFINED[k](x()), v) for k, v in sql.items()]


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_SIGNS = {"EQ": "=", "NE": "<>", "LT": "<", "GT": ">", "LE": "<=", "GE": ">="}


def _missing(x: str, low: float) -> tuple:
    return lambda: OPERATORS["GTF"](_d(x), F.lit(low)), f"CASE WHEN {x} > {low} THEN CAST({x} AS {D}) END"


def _compare(end: str) -> tuple:
    (a, sa), (b, sb) = _missing("l_quantity", 4.0), _missing("l_linenumber", 1.0)
    rows = []
    for k, sign in _SIGNS.items():
        test = f"({sa}) {sign} ({sb})"
        sql = {"": f"CASE WHEN {test} THEN 1.0::{D} WHEN NOT ({test}) THEN 0.0::{D} END", "B": f"CASE WHEN {test} THEN 1.0::{D} ELSE 0.0::{D} END", "F": f"CASE WHEN {test} THEN ({sa}) END"}[end]
        rows.append((f"c_{k.lower()}{end.lower()}", lambda k=k: COMPARE[k + end](a(), b()), sql))
    if end == "F":
        rows.append(("c_id", lambda: COMPARE["ID"](a(), b()), f"CASE WHEN ({sa}) IS NOT DISTINCT FROM ({sb}) THEN 1.0::{D} END"))
    return "lineitem", _LINE, rows


def _arith() -> tuple:
    a, b, sa, sb = (lambda: _d("l_extendedprice")), (lambda: _d("l_linenumber") - 3.0), "l_extendedprice", "(CAST(l_linenumber AS DOUBLE) - 3.0::DOUBLE)"
    (q, sq) = _missing("l_quantity", 10.0)
    sql = {
        "ADD": f"{sa} + {sb}", "SUB": f"{sa} - {sb}", "MUL": f"{sa} * {sb}", "DIV": f"CASE WHEN {sb} <> 0 THEN {sa} / {sb} END", "RDIV": f"CASE WHEN {sb} <> 0 THEN {sa} / {sb} END",
        "IDIV": f"CASE WHEN {sb} <> 0 THEN trunc(trunc({sa}) / {sb}) END", "MOD": f"CASE WHEN {sb} <> 0 THEN {sa} % {sb} END",
        "MODULO": f"CASE WHEN {sb} <> 0 THEN {sa} - {sb} * floor({sa} / {sb}) END", "SIGN": f"CASE WHEN {sb} < 0 THEN -abs({sa}) ELSE abs({sa}) END",
        "MIN": f"least({sa}, {sb})", "MAX": f"greatest({sa}, {sb})", "AND": f"CASE WHEN {sa} IS NOT NULL THEN {sb} END",
    }
    rows = [(k.lower(), lambda k=k: STRICT[k](a(), b()) + F.lit(0.0), f"({v}) + 0.0::{D}") for k, v in sql.items()]
    rows += [("add_missing", lambda: STRICT["ADD"](a(), q()), f"{sa} + ({sq})"), ("max_missing", lambda: STRICT["MAX"](a(), q()), f"CASE WHEN ({sq}) IS NOT NULL THEN greatest({sa}, ({sq})) END"), ("mask", lambda: STRICT["MASK"](a(), q()), f"CASE WHEN ({sq}) IS NOT NULL THEN {sa} END")]
    rows.append(("pow", lambda: _micro(STRICT["POW"](_d("l_discount") + F.lit(0.0), b())), _micro_sql(f"CASE WHEN NOT (l_discount = 0 AND {sb} <= 0) THEN pow(l_discount + 0.0::{D}, {sb}) END")))
    return "lineitem", _LINE, rows


def _bitwise() -> tuple:
    a, b = (lambda: _d("p_partkey")), (lambda: _d("p_size"))
    i, j = "CAST(p_partkey AS INTEGER)", "CAST(p_size AS INTEGER)"
    few, sfew = (lambda: F.pmod(b(), F.lit(16.0))), f"({j} % 16)"
    rows = [("bitand", lambda: STRICT["BITAND"](a(), b()), f"CAST({i} & {j} AS {D})"), ("bitor", lambda: STRICT["BITOR"](a(), b()), f"CAST({i} | {j} AS {D})"), ("bitxor", lambda: STRICT["BITXOR"](a(), b()), f"CAST(xor({i}, {j}) AS {D})"), ("lshift", lambda: STRICT["LSHIFT"](F.pmod(a(), F.lit(1000.0)), few()), f"CAST(CAST({i} % 1000 AS BIGINT) << {sfew} AS {D})"), ("rshift", lambda: STRICT["RSHIFT"](a(), few()), f"CAST({i} >> {sfew} AS {D})")]
    return "part", ["p_partkey"], rows


def _ternary() -> tuple:
    (q, sq) = _missing("l_quantity", 10.0)
    e, d, n = (lambda: _d("l_extendedprice")), (lambda: _d("l_discount") + F.lit(0.0)), (lambda: _d("l_linenumber"))
    rows = [("ifelse", lambda: TERNARY["IFELSE"](q(), e(), n()), f"CASE WHEN ({sq}) IS NOT NULL THEN l_extendedprice ELSE CAST(l_linenumber AS {D}) END"), ("inrange", lambda: TERNARY["INRANGE"](q(), F.lit(15.0), F.lit(30.0)), f"CASE WHEN ({sq}) BETWEEN 15 AND 30 THEN ({sq}) END"), ("blend", lambda: TERNARY["BLEND"](e(), n(), d()), f"l_extendedprice * (l_discount + 0.0::{D}) + l_linenumber * (1.0::{D} - (l_discount + 0.0::{D}))")]
    return "lineitem", _LINE, rows


def _bits() -> tuple:
    x = lambda: _d("value")
    v = "value"
    e = f"(CASE WHEN {v} = 0 THEN 0 ELSE floor(log2(abs({v}))) + 1 END)"
    up = f"CASE WHEN {v} = 0 THEN 5e-324 ELSE {v} + pow(2.0, {e} - 53 - CASE WHEN {v} < 0 AND abs({v}) = pow(2.0, {e} - 1) THEN 1 ELSE 0 END) END"
    sql = {
        "FRACTION": f"{v} / pow(2.0, {e})", "EXPONENT": f"CAST({e} AS {D})", "SPACING": f"CASE WHEN {v} = 0 THEN pow(2.0, -1022) ELSE pow(2.0, {e} - 53) END", "RRSP": f"abs({v} / pow(2.0, {e})) * pow(2.0, 53)",
    }
    rows = [(k.lower(), lambda k=k: BITS[k](x()), f"CAST({q} AS {D})") for k, q in sql.items()]
    rows += [("nearest", lambda: BITS["NEAREST"](x(), F.lit(1.0)), f"CAST({up} AS {D})"), ("sete", lambda: BITS["SETE"](x(), F.lit(3.0)), f"CAST({v} / pow(2.0, {e}) * 8 AS {D})")]
    return "events", ["event_id"], rows


CELLS = {
    "unary_arith": _unary, "float_fn": _float, "definedness": _defined, "cmp_strict": lambda: _compare(""), "cmp_binary": lambda: _compare("B"), "cmp_filter": lambda: _compare("F"),
    "arith_strict": _arith, "bitwise": _bitwise, "ternary": _ternary, "float_bits": _bits,
}


def queries() -> dict:
    def of(make):
        def run(spark, sf_dir):
            table, keys, rows = make()
            return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys, *[c().alias(name) for name, c, _ in rows])

        return run

    return {name: of(make) for name, make in CELLS.items()}


def sql() -> dict[str, str]:
    return {name: text for name, make in CELLS.items() if (text := _sql_of(make))}


def _sql_of(make) -> str:
    table, keys, rows = make()
    return "" if not rows[0][2] else f"SELECT {', '.join(keys)}, " + ", ".join(f"{s} AS {name}" for name, _, s in rows) + f" FROM {table}"


LAZY_SQL = {
    "OR": "coalesce(a, b)", "ROR": "coalesce(b, a)", "XOR": "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a END",
    "LAND": "CASE WHEN b_in THEN CASE WHEN a IS NOT NULL THEN b END ELSE a END", "LMASK": "CASE WHEN b_in THEN CASE WHEN b IS NOT NULL THEN a END ELSE a END",
    "LLAY": "CASE WHEN a_in THEN a ELSE b END", "RLAY": "CASE WHEN b_in THEN b ELSE a END", "LADD": "coalesce(a + b, a, b)", "LSUB": "coalesce(a - b, a)", "LMUL": "coalesce(a * b, a, b)",
    "LDIV": "CASE WHEN a IS NULL OR b IS NULL THEN a WHEN b <> 0 THEN a / b END", "LMIN": "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE least(a, b) END", "LMAX": "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) END",
}
