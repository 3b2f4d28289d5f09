"""All queries of the engine over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..field import Coord, Field
from ..functions import calendar as cal
from ..functions.geometry import gauss_latitudes
from ..functions.scalar import LAZY, OPERATORS
from ..meta import properties
from ..operators import align, records
from ..operators.compare import compare
from ..operators.reduce import across, aggregates, weighted_moments
from ..operators.axes import checked
from ..operators.regrid import apply_jagged, apply_vector, apply_weights, derivative, jagged, overlap_weights, transposed
from ..sources import catalogue
from ..streaming.windows import windowed
from . import cellwise

QUERIES: dict = cellwise.queries()
SQL: dict[str, str] = cellwise.sql()


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cents(x):
    """Sums as whole hundredths of a cent: the order of additions doesn't show."""
    return F.round(x * 1e4).cast("long")


def _cents_sql(x: str) -> str:
    return f"CAST(round(({x}) * 1e4) AS BIGINT)"


# -- reductions ---------------------------------------------------------------------------------------------------

_Q = "CASE WHEN l_quantity > 10 THEN l_quantity END"


def _line(spark, d):
    return _t(spark, d, "lineitem").withColumn("q", OPERATORS["GTF"](F.col("l_quantity"), F.lit(10.0)))


@query("rpn_flagship", f"SELECT l_returnflag, l_linestatus, {_cents_sql('sum(l_quantity * l_extendedprice / l_quantity) / sum(l_quantity)')} AS mean_price FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
def flagship(spark, d):
    """Weighted mean of the unit price where more than ten were ordered, by flag and status: one scan, one aggregate."""
    q = F.col("l_quantity")
    price = OPERATORS["MASK"](OPERATORS["DIV"](F.col("l_extendedprice"), q), OPERATORS["GTF"](q, F.lit(10.0)))
    got = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*[c.alias(k) for k, c in aggregates("WSUM", price, q).items()])
    return got.select("l_returnflag", "l_linestatus", _cents(OPERATORS["DIV"](F.col("v"), F.col("w"))).alias("mean_price"))


_GROUPS = "l_returnflag, l_linenumber"


@query("red_sum", f"SELECT {_GROUPS}, {_cents_sql(f'coalesce(sum({_Q}), 0)')} AS total, CAST(count({_Q}) AS DOUBLE) AS n FROM lineitem GROUP BY ALL")
def red_sum(spark, d):
    got = _line(spark, d).groupBy("l_returnflag", "l_linenumber").agg(aggregates("SUM", F.col("q"))["v"].alias("s"), aggregates("COUNT", F.col("q"))["v"].alias("n"))
    return got.select("l_returnflag", "l_linenumber", _cents(F.col("s")).alias("total"), "n")


def _strict_sql(agg: str) -> str:
    return f"CASE WHEN count({_Q}) = count(*) THEN {agg}({_Q}) END"


@query("red_strict", f"SELECT l_orderkey, {_cents_sql(_strict_sql('sum'))} AS v_add, {_strict_sql('max')} AS v_max, {_strict_sql('min')} AS v_min, CASE WHEN count({_Q}) = count(*) THEN CAST(round(ln(product({_Q})) * 1e6) AS BIGINT) END AS v_mul FROM lineitem GROUP BY ALL")
def red_strict(spark, d):
    agg = {k: aggregates(k, F.col("q"))["v"] for k in ("ADD", "MAX", "MIN", "MUL")}
    got = _line(spark, d).groupBy("l_orderkey").agg(*[c.alias(k) for k, c in agg.items()])
    return got.select("l_orderkey", _cents(F.col("ADD")).alias("v_add"), F.col("MAX").alias("v_max"), F.col("MIN").alias("v_min"), F.round(F.ln("MUL") * 1e6).cast("long").alias("v_mul"))


@query("red_lazy", f"SELECT l_orderkey, {_cents_sql(f'sum({_Q})')} AS v_ladd, max({_Q}) AS v_lmax, min({_Q}) AS v_lmin, CAST(round(ln(product({_Q})) * 1e6) AS BIGINT) AS v_lmul FROM lineitem GROUP BY ALL")
def red_lazy(spark, d):
    agg = {k: aggregates(k, F.col("q"))["v"] for k in ("LADD", "LMAX", "LMIN", "LMUL")}
    got = _line(spark, d).groupBy("l_orderkey").agg(*[c.alias(k) for k, c in agg.items()])
    return got.select("l_orderkey", _cents(F.col("LADD")).alias("v_ladd"), F.col("LMAX").alias("v_lmax"), F.col("LMIN").alias("v_lmin"), F.round(F.ln("LMUL") * 1e6).cast("long").alias("v_lmul"))


@query("red_wsum", f"SELECT {_GROUPS}, {_cents_sql(f'coalesce(sum(l_extendedprice * ({_Q})), 0) / 1e3')} AS wv, {_cents_sql(f'coalesce(sum({_Q}), 0)')} AS w FROM lineitem GROUP BY ALL")
def red_wsum(spark, d):
    got = _line(spark, d).groupBy("l_returnflag", "l_linenumber").agg(*[c.alias(k) for k, c in aggregates("WSUM", F.col("l_extendedprice"), F.col("q")).items()])
    return got.select("l_returnflag", "l_linenumber", _cents(F.col("v") / 1e3).alias("wv"), _cents(F.col("w")).alias("w"))


@query("red_wmv", "WITH m AS (SELECT l_returnflag, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mean, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(round(any_value(mean) * 1e4) AS BIGINT) AS mean, CAST(round(sum(l_quantity * (l_extendedprice - mean) * (l_extendedprice - mean)) / any_value(w)) AS BIGINT) AS variance, CAST(round(any_value(w)) AS BIGINT) AS w FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag")
def red_wmv(spark, d):
    got = weighted_moments(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return got.select("l_returnflag", _cents(F.col("mean")).alias("mean"), F.round(F.col("s") / F.col("w")).cast("long").alias("variance"), F.round("w").cast("long").alias("w"))


@query("red_range", f"SELECT l_returnflag, CAST(count({_Q}) AS DOUBLE) AS n FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 6 GROUP BY ALL")
def red_range(spark, d):
    got = Field.of(_line(spark, d), "q", ["l_returnflag", "l_linenumber"]).reduce("COUNT", "l_linenumber", ranges={"l_linenumber": (2, 6)})
    return got.df.select("l_returnflag", F.col("v").alias("n"))


@query("red_box", "WITH c AS (SELECT c_nationkey AS nation, floor(c_acctbal / 1000) AS band, count(*) AS n FROM customer GROUP BY ALL) SELECT CAST(nation AS BIGINT) AS nation, CASE WHEN count(*) = 11 THEN CAST(sum(n) AS DOUBLE) END AS v FROM c GROUP BY ALL")
def red_box(spark, d):
    """A strict reduction of a box: a nation with a band that nobody is in has no sum."""
    return Field.of(_bands(spark, d), "n", ["nation", BANDS]).reduce("ADD", "band").df


#: Balances are from -1000 to 10000: bands of a thousand.
BANDS = Coord("band", -1, 10)


def _bands(spark, d):
    c = _t(spark, d, "customer")
    return c.groupBy(F.col("c_nationkey").cast("long").alias("nation"), F.floor(F.col("c_acctbal") / 1000).alias("band")).agg(F.count("*").alias("n"))


_FOUR = ["l_quantity", "l_tax", "l_discount", "l_extendedprice"]


@query("accum", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END + 3 AS DOUBLE) AS n, {_cents_sql(f'coalesce({_Q}, 0) + l_tax + l_discount + l_extendedprice')} AS total, {_cents_sql(f'coalesce(({_Q}) * l_tax, 0) + l_discount * l_extendedprice')} AS wv, {_cents_sql(f'CASE WHEN l_quantity > 10 THEN l_tax ELSE 0 END + l_extendedprice')} AS w FROM lineitem")
def accum(spark, d):
    x = [F.col("q"), *map(F.col, _FOUR[1:])]
    pairs = across("WSUM", [x[0], x[2]], [x[1], x[3]])
    return _line(spark, d).select(*cellwise._LINE, across("COUNT", x)["v"].alias("n"), _cents(across("SUM", x)["v"]).alias("total"), _cents(pairs["v"]).alias("wv"), _cents(pairs["w"]).alias("w"))


@query("cum_fold", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_cents_sql('l_quantity - l_tax - l_discount - l_extendedprice')} AS v FROM lineitem")
def cum_fold(spark, d):
    return _t(spark, d, "lineitem").select(*cellwise._LINE, _cents(across("SUB", list(map(F.col, _FOUR)))["v"]).alias("v"))


# -- alignment ----------------------------------------------------------------------------------------------------

_A = "(SELECT o_orderkey AS k, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS a FROM orders WHERE o_orderpriority <> '1-URGENT')"
_B = "(SELECT o_orderkey AS k, CASE WHEN o_totalprice < 300000 THEN o_totalprice / 2 END AS b FROM orders WHERE o_orderstatus <> 'F')"


def _two(spark, d):
    o = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    a = Field.of(o.where("o_orderpriority <> '1-URGENT'"), OPERATORS["GTF"](F.col("o_totalprice"), F.lit(50000.0)), ["k"])
    b = Field.of(o.where("o_orderstatus <> 'F'"), OPERATORS["LTF"](F.col("o_totalprice"), F.lit(300000.0)) / 2, ["k"])
    return a, b


_MET = f"WITH x AS (SELECT k, a, b, ka IS NOT NULL AS a_in, kb IS NOT NULL AS b_in FROM (SELECT coalesce(x.k, y.k) AS k, a, b, x.k AS ka, y.k AS kb FROM {_A} x FULL JOIN {_B} y ON x.k = y.k)) "


def _lazy(name: str, ops: list[str]):
    def run(spark, d):
        out = align.aligned(list(_two(spark, d)), "inclusive").df
        return out.select("k", *[LAZY[o](F.col("v0"), F.col("v1"), F.col("in0"), F.col("in1")).alias(f"v_{o.lower()}") for o in ops])

    query(name, _MET + "SELECT k, " + ", ".join(f"{cellwise.LAZY_SQL[o]} AS v_{o.lower()}" for o in ops) + " FROM x")(run)


_lazy("logic_lazy", ["OR", "ROR", "XOR", "LAND", "LMASK", "LLAY", "RLAY"])
_lazy("arith_lazy", ["LADD", "LSUB", "LMUL", "LDIV", "LMIN", "LMAX"])


@query("logic_strict", _MET + "SELECT k, CASE WHEN a IS NOT NULL THEN b END AS v_and, CASE WHEN b IS NOT NULL THEN a END AS v_mask FROM x WHERE a_in AND b_in")
def logic_strict(spark, d):
    a, b = _two(spark, d)
    both = align.aligned([a, b], "intersect").df
    return both.select("k", OPERATORS["AND"](F.col("v0"), F.col("v1")).alias("v_and"), OPERATORS["MASK"](F.col("v0"), F.col("v1")).alias("v_mask"))


for _name, _mode, _where in (("align_inclusive", "inclusive", "TRUE"), ("align_intersect", "intersect", "a_in AND b_in"), ("align_first", "first", "a_in")):

    def _aligned(spark, d, mode=_mode):
        return align.aligned(list(_two(spark, d)), mode).df.select("k", (F.col("v0") + F.col("v1")).alias("v"), F.col("in0").alias("a_in"), F.col("in1").alias("b_in"))

    query(_name, _MET + f"SELECT k, a + b AS v, a_in, b_in FROM x WHERE {_where}")(_aligned)


@query("align_broadcast", "SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey, c_acctbal - m AS v FROM customer JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS m FROM customer GROUP BY ALL) ON c_nationkey = k")
def align_broadcast(spark, d):
    """What a reduction leaves is spread over the coordinate that went."""
    c = Field.of(_t(spark, d, "customer").withColumn("nation", F.col("c_nationkey").cast("long")), "c_acctbal", ["nation", "c_custkey"])
    return c.op("SUB", c.reduce("MAX", "c_custkey"), mode="first").df


@query("align_outer", "SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(r_regionkey AS BIGINT) AS region, CAST(n_regionkey * 10 + r_regionkey AS DOUBLE) AS v FROM nation, region")
def align_outer(spark, d):
    """Two axes of a few cells without a common name span their product."""
    a = Field.of(_t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), "n_regionkey"), F.col("n_regionkey") * 10, ["nation"])
    b = Field.of(_t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("region")), "region", ["region"])
    return a.op("ADD", b, names=["nation", "region"]).df


@query("align_mixed", "WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band, c_mktsegment AS segment, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY ALL), a AS (SELECT nation, band, sum(v) AS v FROM c GROUP BY ALL), b AS (SELECT band, segment, sum(v) AS v FROM c GROUP BY ALL) SELECT nation, band, segment, a.v - b.v AS v FROM a JOIN b USING (band)")
def align_mixed(spark, d):
    """Operands that share one coordinate of two are spread over each other's other one."""
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation"), F.floor(F.col("c_acctbal") / 1000).alias("band"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    cube = Field.of(c, "n", ["nation", "band", "segment"])
    return cube.reduce("SUM", "segment").op("SUB", cube.reduce("SUM", "nation")).df


_ALL = "WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY ALL), "


@query("align_gaps", _ALL + "a AS (SELECT * FROM c WHERE nation < 10 AND band < 4), b AS (SELECT * FROM c WHERE nation BETWEEN 5 AND 19 AND band BETWEEN 2 AND 7), g AS (SELECT n AS nation, m AS band, n < 10 AND m < 4 AS ina, n >= 5 AND m BETWEEN 2 AND 7 AS inb FROM range(20) x(n), range(-1, 8) y(m)) SELECT nation, band, a.v + b.v AS v FROM g LEFT JOIN a USING (nation, band) LEFT JOIN b USING (nation, band) WHERE a.v IS NOT NULL OR b.v IS NOT NULL OR NOT (ina OR inb)")
def align_gaps(spark, d):
    """Two boxes that overlap at a corner: the result has the box around both, with missing cells where neither is."""
    c = _cube(spark, d)
    return c.select(nation=(0, 10), band=(-1, 4)).op("ADD", c.select(nation=(5, 20), band=(2, 8))).df


@query("align_ranges", _ALL + "s AS (SELECT nation, band + 1 AS band, v FROM c), f AS (SELECT nation, band, coalesce(c.v, 0) + coalesce(s.v, 0) AS v FROM c FULL JOIN s USING (nation, band)), x AS (SELECT f.nation, f.band, f.v - i.v AS v FROM f JOIN c i ON f.nation = i.nation AND f.band = i.band WHERE f.band BETWEEN 2 AND 5) SELECT nation, 'hull' AS part, CASE WHEN count(v) = 12 THEN sum(v) END AS v FROM f GROUP BY nation UNION ALL SELECT nation, 'shared' AS part, CASE WHEN count(v) = 4 THEN sum(v) END AS v FROM x GROUP BY nation UNION ALL SELECT nation, 'turned' AS part, sum(v * ((band + 1 + 5) % 12)) AS v FROM f GROUP BY nation")
def align_ranges(spark, d):
    """What follows an alignment sees the ranges of its result: strict sums over a hull and over what is shared, and a circle of the hull."""
    c = _cube(spark, d)
    hull = c.op("LADD", c.shift("band", 1))
    shared = hull.op("SUB", c.select(band=(2, 6)), mode="intersect")
    turned = hull.shift("band", 5, cycle=12)
    weighted = turned.op("MUL", turned.index("band").map("ADD", 1)).reduce("LADD", "band")
    part = lambda f, name: f.df.select("nation", F.lit(name).alias("part"), "v")
    return part(hull.reduce("ADD", "band"), "hull").union(part(shared.reduce("ADD", "band"), "shared")).union(part(weighted, "turned"))


@query("align_swapped", _ALL + "a AS (SELECT nation, sum(v) AS v FROM c WHERE nation < 12 GROUP BY nation), b AS (SELECT * FROM c WHERE nation >= 4), g AS (SELECT n AS nation, m AS band FROM range(25) x(n), range(-1, 10) y(m)), r AS (SELECT nation, band, CASE WHEN a.v IS NULL THEN b.v ELSE a.v + coalesce(b.v, 0) END AS v, a.v - b.v AS w FROM g LEFT JOIN a USING (nation) LEFT JOIN b USING (nation, band) WHERE a.v IS NOT NULL OR b.v IS NOT NULL) SELECT nation, band, v, v AS swapped, w, -w AS minus FROM r")
def align_swapped(spark, d):
    """An operand that is spread, first and second: the same cells."""
    c = _cube(spark, d)
    a, b = c.reduce("SUM", "band").select(nation=(0, 12)), c.select(nation=(4, 25))
    made = {"v": a.op("LADD", b), "swapped": b.op("LADD", a), "w": a.op("SUB", b), "minus": b.op("SUB", a)}
    frames = [f.df.withColumnRenamed("v", k) for k, f in made.items()]
    return frames[0].join(frames[1], ["nation", "band"], "full").join(frames[2], ["nation", "band"], "full").join(frames[3], ["nation", "band"], "full")


@query("align_permuted", _ALL + "d AS (SELECT nation, band + 1 AS band, v FROM c) SELECT nation, band, c.v + 100 * d.v AS v FROM c JOIN d USING (nation, band)")
def align_permuted(spark, d):
    """Operands whose coordinates stand in different orders meet by name."""
    c = _cube(spark, d)
    return c.op("ADD", c.permute("band", "nation").shift("band", 1).map("MUL", 100), mode="intersect").df


@query("align_folded", _ALL + "x AS (SELECT * FROM c WHERE band < 3), y AS (SELECT * FROM c WHERE band >= 2 AND band < 6), z AS (SELECT * FROM c WHERE band >= 5) SELECT nation, band, CASE WHEN x.v IS NOT NULL OR y.v IS NOT NULL OR z.v IS NOT NULL THEN coalesce(x.v, 0) + coalesce(y.v, 0) + coalesce(z.v, 0) + 1 END AS v FROM x FULL JOIN y USING (nation, band) FULL JOIN z USING (nation, band)")
def align_folded(spark, d):
    """A lazy operator of three fields and a number, taken from the left."""
    c = _cube(spark, d)
    return c.select(band=(-1, 3)).op("LADD", c.select(band=(2, 6)), c.select(band=(5, 10)), 1.0).df


_SHAPES = {"cust": "[nation/0:25 band/-1:10]", "shifted": "[nation/0:25 band/-1:11]", "summed": "[nation/0:25]"}


@query("field_props", _ALL + "s AS (SELECT nation, band, c.v - d.v AS v FROM c FULL JOIN (SELECT nation, band + 1 AS band, v FROM c) d USING (nation, band)), t AS (SELECT nation, sum(v) AS v FROM c GROUP BY nation) "
       + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS position, '{item}' AS item, '{title}' AS title, '1' AS unit, 'double' AS kind, '{_SHAPES[shape]}' AS shape, CAST(1 AS BIGINT) AS n_records, count(*) AS n_cells, count(*) FILTER (v IS NULL) AS n_missing, min({v}) AS low, max({v}) AS high FROM {t}" for i, (item, title, shape, v, t) in enumerate([
           ("cust", "customers", "cust", "v", "c"), ("cust 2 MUL cust SUB", "customers*2-customers", "cust", "v", "c"), ("cust moved SUB 3 DIV", "(customers-moved)/3", "shifted", "v / 3", "s"), ("cust SUM=band", "SUM(customers;band)", "summed", "v", "t"),
       ])))
def field_props(spark, d):
    """What is known of fields after operators, and what their cells say."""
    c = _cube(spark, d)
    return properties([c, c.map("MUL", 2).op("SUB", c), c.op("SUB", c.shift("band", 1).titled(item="moved", title="moved")).map("DIV", 3), c.reduce("SUM", "band")])


# -- shapes, indices, records -------------------------------------------------------------------------------------

_CUBE = "WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY ALL) "


def _cube(spark, d) -> Field:
    return Field.of(_bands(spark, d), "n", [Coord("nation", 0, 25), BANDS], item="cust", title="customers", unit="1")


@query("shape_range", _CUBE + "SELECT nation, band, v FROM c WHERE nation >= 5 AND nation < 12 AND band = 3")
def shape_range(spark, d):
    return _cube(spark, d).select(nation=(5, 12), band=3).df


@query("shape_shift", _CUBE + "SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.band, b.band + 1) AS band, a.v - b.v AS v FROM c a FULL JOIN c b ON a.nation = b.nation AND a.band = b.band + 1")
def shape_shift(spark, d):
    c = _cube(spark, d)
    return c.op("SUB", c.shift("band", 1)).df


@query("shape_cshift", _CUBE + "SELECT nation, (band + 9) % 11 - 1 AS band, v FROM c")
def shape_cshift(spark, d):
    return _cube(spark, d).shift("band", -3, cycle=11).df


@query("shape_perm", _CUBE + "SELECT band AS level, nation, v FROM c")
def shape_perm(spark, d):
    out = _cube(spark, d).permute("band").rename(band="level")
    return out.df.select(*out.keys, "v")


@query("size_expand", "WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY ALL) SELECT nation, CAST(level AS BIGINT) AS level, v FROM c, range(4) r(level)")
def size_expand(spark, d):
    return _cube(spark, d).reduce("SUM", "band").spread("level", 0, 4).df.select("nation", "level", "v")


@query("index_x", _CUBE + "SELECT nation, band, CAST(band AS DOUBLE) AS v FROM c")
def index_x(spark, d):
    return _cube(spark, d).index("band").df


@query("flat", _CUBE + "SELECT nation, band, CAST(nation + 25 * (band + 1) AS DOUBLE) AS v FROM c")
def flat(spark, d):
    return _cube(spark, d).flat().df


@query("flat_permuted", _CUBE + "SELECT nation, band, CAST(band + 1 + 11 * nation AS DOUBLE) AS v FROM c")
def flat_permuted(spark, d):
    return _cube(spark, d).flat("band", "nation").df


_DAYS = "WITH e AS (SELECT date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS rec, user_id % 5 AS u, count(*) AS v FROM events GROUP BY ALL) "


def _first_day(spark, d):
    """The day of the first event, as a subquery of the plan."""
    return _t(spark, d, "events").agg(F.min(F.to_date("ts"))).scalar()


def _days(spark, d) -> Field:
    """Events by day, day 0 being the first, and a fifth of the users."""
    e = _t(spark, d, "events").select(F.to_date("ts").alias("day"), F.pmod("user_id", F.lit(5)).alias("u"))
    e = e.groupBy("day", "u").agg(F.count("*").alias("n")).withColumn("rec", F.datediff("day", _first_day(spark, d)).cast("long"))
    return Field.of(e, "n", ["u"], rec="rec")


@query("rec_range", _DAYS + "SELECT rec - 2 AS rec, u, CAST(v AS DOUBLE) AS v FROM e WHERE rec >= 2 AND rec < 9")
def rec_range(spark, d):
    return _days(spark, d).records(2, 9).df


@query("rec_stride", _DAYS + "SELECT rec // 3 AS rec, u, CAST(v AS DOUBLE) AS v FROM e WHERE rec % 3 = 0")
def rec_stride(spark, d):
    return _days(spark, d).records(0, None, 3).df


@query("rec_multi", _DAYS + "SELECT rec // 5 AS rec, u, rec % 5 AS slot, CAST(v AS DOUBLE) AS v FROM e WHERE rec % 5 < 2")
def rec_multi(spark, d):
    return _days(spark, d).records(0, None, 5, 2).df.select("rec", "u", "slot", "v")


@query("rec_tuples", _DAYS + "SELECT a.rec // 2 AS rec, a.u, CAST(a.v + b.v AS DOUBLE) AS v FROM e a JOIN e b ON b.u = a.u AND b.rec = a.rec + 1 WHERE a.rec IN (1, 3, 5)")
def rec_tuples(spark, d):
    a, b = records.tuples(_days(spark, d), [(1, 2), (3, 4), (5, 6)])
    return a.op("ADD", b, mode="intersect").df


@query("rec_successive", _DAYS + "SELECT a.rec // 2 AS rec, a.u, CAST(a.v + b.v + c.v AS DOUBLE) AS v FROM e a JOIN e b ON b.u = a.u AND b.rec = a.rec + 1 JOIN e c ON c.u = a.u AND c.rec = 5 + a.rec // 2 WHERE a.rec IN (1, 3)")
def rec_successive(spark, d):
    """Several selections of one source, each an operand."""
    days = _days(spark, d)
    a, b, c = [*records.tuples(days, [(1, 2), (3, 4)]), records.listed(days, [5, 6])]
    return a.op("ADD", b, mode="intersect").op("ADD", c, mode="intersect").df


def _in_step(spark, d, mode):
    whole = _days(spark, d)
    few = whole.select(u=0).records(0, 3)
    a, b = records.in_step([whole, few], ["terminate", mode])
    return a.op("SUB", b, mode="first").df


def _step_sql(rec: str) -> str:
    return _DAYS + f"SELECT a.rec, a.u, CAST(a.v - b.v AS DOUBLE) AS v FROM e a LEFT JOIN e b ON b.u = 0 AND a.u = 0 AND b.rec = {rec}"


@query("rec_cyclic", _step_sql("a.rec % 3"))
def rec_cyclic(spark, d):
    return _in_step(spark, d, "cyclic")


@query("rec_persist", _step_sql("least(a.rec, 2)"))
def rec_persist(spark, d):
    return _in_step(spark, d, "persistent")


# -- comparison, regridding, calendars, streams -------------------------------------------------------------------

@query("cmp_files", "WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS p, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS r, CASE WHEN o_totalprice >= 20000 THEN o_totalprice + o_orderkey % 3 END AS t FROM orders) SELECT p, min(CASE WHEN t IS NOT NULL AND r <> 0 THEN abs(r) END) AS abs_min, max(CASE WHEN t IS NOT NULL THEN abs(r) END) AS abs_max, CAST(round(max(abs(t - r)) * 1e6) AS BIGINT) AS abs_diff, CAST(round(max(CASE WHEN r <> 0 THEN abs((t - r) / r) END) * 1e9) AS BIGINT) AS rel_diff, max(CASE WHEN r = 0 AND t <> 0 THEN abs(t - r) END) AS zero_diff, count(*) FILTER (r IS NOT NULL AND t IS NULL) AS miss_target, count(*) FILTER (r IS NULL AND t IS NOT NULL) AS miss_reference FROM r GROUP BY p")
def cmp_files(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), "o_orderstatus", "o_totalprice")
    r = o.select("k", "p", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    t = o.where("o_totalprice >= 20000").select("k", "p", (F.col("o_totalprice") + F.col("k") % 3).alias("v"))
    got = compare(r, t, ["k", "p"], ["p"])
    return got.withColumn("abs_diff", F.round(F.col("abs_diff") * 1e6).cast("long")).withColumn("rel_diff", F.round(F.col("rel_diff") * 1e9).cast("long"))


_RING = "WITH s AS (SELECT CAST(hour(ts) AS BIGINT) AS h, sum(value) AS v FROM events GROUP BY ALL), w AS (SELECT d AS dst, h AS src, least(h + 1 + k * 24, (d + 1) * 2.4) - greatest(h + k * 24, d * 2.4) AS o FROM range(10) x(d), range(24) y(h), (VALUES (-1), (0), (1)) z(k) WHERE least(h + 1 + k * 24, (d + 1) * 2.4) - greatest(h + k * 24, d * 2.4) > 1e-9) "


def _ring(spark, d):
    src = spark.range(24).select(F.col("id").alias("cell"), F.col("id").cast("double").alias("low"), (F.col("id") + 1.0).alias("high"))
    dst = spark.range(10).select(F.col("id").alias("cell"), (F.col("id") * 2.4).alias("low"), ((F.col("id") + 1) * 2.4).alias("high"))
    hours = _t(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("h")).agg(F.sum("value").alias("v"))
    return hours, overlap_weights(src, dst, 24.0).where("w > 1e-9")


@query("regrid_cyclic", _RING + f"SELECT CAST(dst AS BIGINT) AS h, {_cents_sql('sum(o / 2.4 * v)')} AS v FROM w JOIN s ON src = h GROUP BY dst")
def regrid_cyclic(spark, d):
    hours, w = _ring(spark, d)
    return apply_weights(hours, w, "h").select("h", _cents(F.col("v")).alias("v"))


@query("regrid_jagged", _RING + f"SELECT CAST(dst AS BIGINT) AS h, {_cents_sql('sum(o / 2.4 * v)')} AS v FROM w JOIN s ON src = h GROUP BY dst")
def regrid_jagged(spark, d):
    """The same from weights by jagged diagonals."""
    hours, w = _ring(spark, d)
    return apply_jagged(hours, jagged(w, 3), "h").select("h", _cents(F.col("v")).alias("v"))


@query("regrid_vector", "WITH s AS (SELECT event_type AS k, CAST(hour(ts) AS BIGINT) AS h, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT d AS dst, h AS src, (least(h + 1, (d + 1) * 2.4) - greatest(h, d * 2.4)) / 2.4 AS o FROM range(10) x(d), range(24) y(h) WHERE least(h + 1, (d + 1) * 2.4) - greatest(h, d * 2.4) > 1e-9), d AS (SELECT dst, sum(o) AS o FROM w GROUP BY dst), r AS (SELECT k, dst, sum(w.o * v + w.o / 8 * n) / any_value(d.o) AS v FROM s JOIN w ON src = h JOIN d USING (dst) GROUP BY k, dst), g AS (SELECT DISTINCT k, t.dst FROM s, range(12) t(dst)) "
       f"SELECT k, CAST(dst AS BIGINT) AS h, CASE WHEN r.k IS NULL THEN -1427143 ELSE {_cents_sql('v / 7')} END AS v FROM g LEFT JOIN r USING (k, dst)")
def regrid_vector(spark, d):
    """Two components, the first one's weights below, and two targets that no weight reaches."""
    _, w = _ring(spark, d)
    both = _t(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.hour("ts").cast("long").alias("h")).agg(F.sum("value").alias("a"), F.count("*").alias("b"))
    w = w.select("dst", "src", F.col("w").alias("wa"), (F.col("w") / 8).alias("wb"))
    got = apply_vector(both, w, "h", {"a": "wa", "b": "wb"}, ["k"], destinations=spark.range(12).withColumnRenamed("id", "dst"), undefined=-999.0)
    return got.select("k", "h", _cents(F.col("v") / 7).alias("v"))


@query("spmv", _RING + f", t AS (SELECT CAST(dst AS BIGINT) AS h, sum(o / 2.4 * v) AS v FROM w JOIN s ON src = h GROUP BY dst) SELECT CAST(src AS BIGINT) AS h, {_cents_sql('sum(o / 2.4 * v) / sum(o / 2.4)')} AS v FROM w JOIN t ON dst = h GROUP BY src")
def spmv(spark, d):
    """There and back: the transposed weights, normalised."""
    hours, w = _ring(spark, d)
    return apply_weights(apply_weights(hours, w, "h"), transposed(w), "h", normalised=True).select("h", _cents(F.col("v")).alias("v"))


@query("axis_slope", "WITH s AS (SELECT p_size AS x, avg(p_retailprice) AS v FROM part GROUP BY ALL), n AS (SELECT x, v, x - lag(x) OVER o AS a, lead(x) OVER o - x AS b, lag(v) OVER o AS p, lead(v) OVER o AS q FROM s WINDOW o AS (ORDER BY x)) SELECT x, CAST(round(CASE WHEN a IS NULL THEN (q - v) / b WHEN b IS NULL THEN (v - p) / a ELSE -b / (a * (a + b)) * p + (b - a) / (a * b) * v + a / (b * (a + b)) * q END * 1e4) AS BIGINT) AS slope FROM n")
def axis_slope(spark, d):
    s = _t(spark, d, "part").groupBy(F.col("p_size").alias("x")).agg(F.avg("p_retailprice").alias("v"))
    return derivative(s, "x", F.col("x").cast("double"), []).select("x", _cents(F.col("slope")).alias("slope"))


_HOURS = "WITH s AS (SELECT CAST(hour(ts) AS BIGINT) AS x, avg(value) AS v FROM events GROUP BY ALL), "


@query("slope_cyclic", _HOURS + "n AS (SELECT x, v, x - coalesce(lag(x) OVER o, max(x) OVER () - 24) AS a, coalesce(lead(x) OVER o, min(x) OVER () + 24) - x AS b, coalesce(lag(v) OVER o, arg_max(v, x) OVER ()) AS p, coalesce(lead(v) OVER o, arg_min(v, x) OVER ()) AS q FROM s WINDOW o AS (ORDER BY x)) SELECT x, CAST(round((-b / (a * (a + b)) * p + (b - a) / (a * b) * v + a / (b * (a + b)) * q) * 1e4) AS BIGINT) AS slope FROM n")
def slope_cyclic(spark, d):
    """Along the hours of the day, a circle."""
    s = _t(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("x")).agg(F.avg("value").alias("v"))
    return derivative(s, "x", F.col("x").cast("double"), [], period=24.0).select("x", _cents(F.col("slope")).alias("slope"))


@query("slope_degrees", "WITH s AS (SELECT event_type AS k, CAST(hour(ts) AS BIGINT) AS x, avg(value) AS v FROM events GROUP BY ALL), n AS (SELECT k, x, v, x - coalesce(lag(x) OVER o, max(x) OVER l - 24) AS a, coalesce(lead(x) OVER o, min(x) OVER l + 24) - x AS b, coalesce(lag(v) OVER o, arg_max(v, x) OVER l) AS p, coalesce(lead(v) OVER o, arg_min(v, x) OVER l) AS q FROM s WINDOW o AS (PARTITION BY k ORDER BY x), l AS (PARTITION BY k)) SELECT k, x, CAST(round((-b / (a * (a + b)) * p + (b - a) / (a * b) * v + a / (b * (a + b)) * q) / 15 * 180 / pi() * 1e4) AS BIGINT) AS slope FROM n")
def slope_degrees(spark, d):
    """The same for each type of event, hours being 15 degrees apart and slopes by radian."""
    s = _t(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.hour("ts").cast("long").alias("x")).agg(F.avg("value").alias("v"))
    return derivative(s, "x", F.col("x") * 15.0, ["k"], period=360.0, degrees=True).select("k", "x", _cents(F.col("slope")).alias("slope"))


_YMD = "year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d"
_O = f"WITH o AS (SELECT o_orderkey, {_YMD}, hour(o_orderdate) * 3600 AS s FROM orders) "


def _dates(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), F.day("o_orderdate").cast("long").alias("d"), (F.hour("o_orderdate") * 3600).cast("double").alias("s"))


def _calendar(kind):
    def run(spark, d):
        o = _dates(spark, d).withColumn("day", cal.day_number(F.col("y"), F.col("m"), F.col("d"), kind))
        y, m, dd = cal.date_of(F.col("day") + 100, kind)
        return o.select("o_orderkey", "day", y.alias("y2"), m.alias("m2"), dd.alias("d2"))

    return run


query("cal_360", _O + "SELECT o_orderkey, y * 360 + (m - 1) * 30 + d AS day, (y * 360 + (m - 1) * 30 + d + 99) // 360 AS y2, (y * 360 + (m - 1) * 30 + d + 99) % 360 // 30 + 1 AS m2, (y * 360 + (m - 1) * 30 + d + 99) % 30 + 1 AS d2 FROM o")(_calendar(cal.IDEAL))
query("cal_leap", _O + "SELECT o_orderkey, date_diff('day', DATE '0001-01-01', make_date(y, m, d)) + 367 AS day, year(make_date(y, m, d) + 100) AS y2, month(make_date(y, m, d) + 100) AS m2, day(make_date(y, m, d) + 100) AS d2 FROM o")(_calendar(cal.LEAP))
_B365 = "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]"
query("cal_365", _O + f", n AS (SELECT o_orderkey, y * 365 + {_B365}[m] + d AS day FROM o), p AS (SELECT o_orderkey, day, (day + 99) // 365 AS y2, (day + 99) % 365 AS r FROM n), q AS (SELECT *, len(list_filter({_B365}, lambda b: b <= r)) AS m2 FROM p) SELECT o_orderkey, day, y2, m2, r - {_B365}[m2] + 1 AS d2 FROM q")(_calendar(cal.NO_LEAP))


@query("cal_auto", "WITH o AS (SELECT o_orderkey, year(o_orderdate) - shift AS y, month(o_orderdate) AS m, least(day(o_orderdate), CASE WHEN month(o_orderdate) = 2 THEN 28 ELSE 30 END) AS d FROM orders, (VALUES (0), (500), (1500)) s(shift)) SELECT o_orderkey, y, m, d, y AS y2, m AS m2, d AS d2, CASE WHEN y >= 1900 THEN date_diff('day', DATE '0001-01-01', make_date(y, m, d)) + 367 WHEN y >= 1000 THEN y * 365 + " + _B365 + "[m] + d ELSE y * 360 + (m - 1) * 30 + d END AS day FROM o")
def cal_auto(spark, d):
    """Dates of each kind that the calendar has by year, as serial days and back."""
    o = _dates(spark, d).withColumn("y", F.explode(F.array(F.col("y"), F.col("y") - 500, F.col("y") - 1500)))
    o = o.withColumn("d", F.least("d", F.when(F.col("m") == 2, 28).otherwise(30)).cast("long"))
    o = o.withColumn("day", cal.day_number(F.col("y"), F.col("m"), F.col("d"), cal.AUTO))
    y, m, dd = cal.date_of(F.col("day"), cal.AUTO)
    return o.select("o_orderkey", "y", "m", "d", "day", y.alias("y2"), m.alias("m2"), dd.alias("d2"))


@query("cal_advance", _O + "SELECT o_orderkey, date_diff('day', DATE '0001-01-01', make_date(y, m, 1)) + date_diff('day', make_date(y, m, 1), make_date(y, m, 1) + INTERVAL 3 MONTH) + d - 1 + 367 AS by_month, date_diff('day', DATE '0001-01-01', make_date(y, m, d)) + 367 + floor((s + 131400.0::DOUBLE) / 86400) AS by_hour, s + 131400.0::DOUBLE - 86400 * floor((s + 131400.0::DOUBLE) / 86400) AS second FROM o")
def cal_advance(spark, d):
    o = _dates(spark, d)
    y, m, dd, s = map(F.col, ("y", "m", "d", "s"))
    day, second = cal.advance(y, m, dd, s, F.lit(36.5), "H")
    return o.select("o_orderkey", cal.advance(y, m, dd, s, F.lit(3.7), "MO")[0].alias("by_month"), day.cast("double").alias("by_hour"), second.alias("second"))


@query("time_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(value) AS n, CAST(round(sum(value) * 1e4) AS BIGINT) AS total, max(value) AS most FROM events GROUP BY ALL")
def time_windows(spark, d):
    got = windowed(_t(spark, d, "events"), keys=["event_type"])
    return got.select("start", "event_type", "n", _cents(F.col("total")).alias("total"), "most")


@query("record_search", "SELECT min(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE))) AS rec FROM events WHERE value > 200")
def record_search(spark, d):
    e = _t(spark, d, "events").select(F.to_date("ts").alias("day"), "event_id", "value")
    f = Field.of(e.withColumn("n", F.datediff("day", _first_day(spark, d)).cast("long")), "value", ["event_id"], rec="n")
    return records.first_matching(f, F.col("v") > 200)



# -- catalogues, axes, quadrature, dates --------------------------------------------------------------------------

_KNOWN = "WITH r AS (SELECT event_type AS grp, date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS rec, min(ts) AS t FROM events GROUP BY ALL) "


def _known(spark, d):
    """The records of each type of event, by day, with the time of each."""
    e = _t(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("grp"), F.col("ts").alias("time"), F.col("value").alias("v"))
    return catalogue.catalogue(e.withColumn("rec", F.datediff("day", _first_day(spark, d)).cast("long")).withColumn("var", F.lit("value")))


@query("record_asof", _KNOWN + "SELECT event_id, r.rec FROM (SELECT event_id, event_type AS grp, ts - INTERVAL 12 HOUR AS at FROM events) e ASOF LEFT JOIN r ON e.grp = r.grp AND e.at >= r.t")
def record_asof(spark, d):
    """For each event the last record of its type at or before twelve hours earlier."""
    asked = _t(spark, d, "events").select("event_id", F.col("event_type").alias("grp"), F.lit("value").alias("var"), (F.col("ts") - F.expr("INTERVAL 12 HOUR")).alias("time"))
    return catalogue.record_at(_known(spark, d), asked).select("event_id", "rec")


@query("record_within", _KNOWN + "SELECT event_id, CASE WHEN r.t < e.high THEN r.rec END AS rec FROM (SELECT event_id, event_type AS grp, ts AS low, ts + INTERVAL 3 HOUR AS high FROM events) e ASOF LEFT JOIN r ON e.grp = r.grp AND e.low <= r.t")
def record_within(spark, d):
    """For each event the first record of its type that begins within three hours."""
    asked = _t(spark, d, "events").select("event_id", F.col("event_type").alias("grp"), F.lit("value").alias("var"), F.col("ts").alias("low"), (F.col("ts") + F.expr("INTERVAL 3 HOUR")).alias("high"))
    return catalogue.record_within(_known(spark, d), asked).select("event_id", "rec")


@query("axis_checks", "WITH a AS (SELECT 'balance' || c_nationkey AS axis, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS j, c_acctbal AS x FROM customer UNION ALL SELECT DISTINCT 'hour', hour(ts), hour(ts) * 15 - 172.5::DOUBLE FROM events UNION ALL SELECT 'region', r_regionkey, r_regionkey - 2 FROM region UNION ALL SELECT 'nation', n_nationkey, (24 - n_nationkey) * 0.1::DOUBLE FROM nation), "
       "b AS (SELECT *, lead(x) OVER (PARTITION BY axis ORDER BY j) AS nx FROM a), s AS (SELECT axis, count(*) AS n, min(nx - x) AS low, max(nx - x) AS high, max(abs(x)) AS most, min(abs(x)) FILTER (x <> 0) AS least, max(abs(x)) FILTER (nx IS NOT NULL) AS inside, arg_min(x, j) AS f, greatest(abs(arg_min(x, j)), abs(arg_max(x, j))) * 4.440892098500626e-16 AS t FROM b GROUP BY axis), "
       "c AS (SELECT axis, min(j) AS mid, arg_min(x, j) AS xa FROM a JOIN s USING (axis) WHERE j > 0 AND CASE WHEN f < t THEN x >= -t ELSE x <= t END GROUP BY axis), d AS (SELECT *, CASE WHEN abs(xa) <= t THEN 1 ELSE 0 END AS o, n - mid - CASE WHEN abs(xa) <= t THEN 1 ELSE 0 END AS up FROM s LEFT JOIN c USING (axis)), "
       "m AS (SELECT d.axis, max(abs(u.x + v.x)) AS asym FROM d JOIN a u ON u.axis = d.axis AND u.j >= mid + o AND u.j < mid + o + least(up, mid) JOIN a v ON v.axis = d.axis AND v.j = 2 * mid - u.j - 1 + o GROUP BY d.axis), k AS (SELECT *, CASE WHEN low > 0 THEN 1 WHEN high < 0 THEN -1 ELSE 0 END AS mono, coalesce(high - low, 0) AS dev, CASE WHEN mid IS NULL OR up = 0 OR asym > t THEN 'none' WHEN o = 1 THEN 'even' ELSE 'odd' END AS symmetry FROM d LEFT JOIN m USING (axis)) "
       "SELECT axis, n, CAST(mono AS INTEGER) AS monotonic, CASE WHEN n < 2 OR mono = 0 THEN 'none' WHEN dev = 0 THEN 'strict' WHEN abs(dev * (least / most)) < 2.220446049250313e-16 THEN 'enough' ELSE 'none' END AS spacing, dev AS deviation, dev <= coalesce(inside, 0) * 4.440892098500626e-16 AS equidistant, symmetry, symmetry <> 'none' AND coalesce(up = mid, false) AS spans, coalesce(asym, 0) AS asymmetry FROM k")
def axis_checks(spark, d):
    """Balances of each nation in order, hours in degrees, regions around zero, nations falling by tenths."""
    c = _t(spark, d, "customer")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")) - 1
    axes = c.select(F.concat(F.lit("balance"), F.col("c_nationkey").cast("string")).alias("axis"), rank.cast("long").alias("j"), F.col("c_acctbal").alias("x"))
    hour = F.hour("ts").cast("long")
    axes = axes.union(_t(spark, d, "events").select(F.lit("hour"), hour, hour * 15 - 172.5).distinct())
    axes = axes.union(_t(spark, d, "region").select(F.lit("region"), F.col("r_regionkey").cast("long"), (F.col("r_regionkey") - 2).cast("double")))
    axes = axes.union(_t(spark, d, "nation").select(F.lit("nation"), F.col("n_nationkey").cast("long"), (24 - F.col("n_nationkey")) * F.lit(0.1)))
    return checked(axes)


@query("gauss_mean", "WITH s AS (SELECT event_type AS k, count(*) AS c0, sum(value) / 1e3 AS c1, max(value) AS c2, avg(value) AS c6, count(DISTINCT user_id) AS c9 FROM events GROUP BY ALL) SELECT k, CAST(round((2 * c0 + c2 * 2 / 3 + c6 * 2 / 7) * 1e4) AS BIGINT) AS v FROM s")
def gauss_mean(spark, d):
    """Integrals from -1 to 1 of polynomials in the sine of latitude, exact on five latitudes up to the ninth degree."""
    e = _t(spark, d, "events").groupBy(F.col("event_type").alias("k"))
    s = e.agg(F.count("*").alias("c0"), (F.sum("value") / 1e3).alias("c1"), F.max("value").alias("c2"), F.avg("value").alias("c6"), F.countDistinct("user_id").alias("c9"))
    x = F.sin(F.radians("lat"))
    nodes = gauss_latitudes(spark, 5).select(x.alias("x"), "weight").agg(F.collect_list(F.struct("x", "weight")).alias("nodes")).scalar()  # as many as there are latitudes
    at = lambda n: F.col("c0") + F.col("c1") * n["x"] + F.col("c2") * F.pow(n["x"], F.lit(2.0)) + F.col("c6") * F.pow(n["x"], F.lit(6.0)) + F.col("c9") * F.pow(n["x"], F.lit(9.0))
    s = s.withColumn("nodes", nodes).withColumn("node", F.explode("nodes"))
    return s.groupBy("k").agg(_cents(F.sum(F.col("node.weight") * at(F.col("node")))).alias("v"))


_BEFORE = "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS s, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 400 AS INTEGER) AS a, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders), p AS (SELECT *, o_orderkey % 400 = 0 AS same, n - o_orderkey % 400 AS n0, day(last_day(b)) AS dm, CASE WHEN day(last_day(make_date(year(b), 2, 1))) = 29 THEN 366 ELSE 365 END AS dy FROM o) "


def _passed_sql(unit: str, duration: int) -> str:
    if unit == "Y":
        far = f"(year(b) - year(a)) + (month(b) - month(a)) / 12.0::DOUBLE + (day(b) - day(a)) / dy::DOUBLE >= {duration}"
    elif unit == "MO":
        far = f"(year(b) - year(a)) * 12 + (month(b) - month(a)) + (day(b) - day(a)) / dm::DOUBLE >= {duration}"
    else:
        size = duration * cal.SECONDS[unit]
        far = f"floor((n * 86400 + s) / {size}::DOUBLE) > floor((n0 * 86400 + s) / {size}::DOUBLE)"
    return f"same OR (n * 86400 + s >= 0 AND {far}) AS p_{unit.lower()}"


_STEPS = {"Y": 1, "MO": 5, "D": 90, "H": 1000, "MI": 200_000, "S": 9_000_000}


@query("cal_passed", _BEFORE + "SELECT o_orderkey, " + ", ".join(_passed_sql(u, n) for u, n in _STEPS.items()) + " FROM p")
def cal_passed(spark, d):
    """Whether durations of each unit have passed since up to 399 days before the order; some times are equal, some before the origin."""
    o = _t(spark, d, "orders")
    day = cal.day_number(*[F.lit(x) for x in (1995, 1, 1)]) + F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    second = cal.second_of(F.hour("o_orderdate"), F.minute("o_orderdate"), F.second("o_orderdate")).cast("double")
    o = o.select("o_orderkey", day.alias("day"), second.alias("s"), (day - F.col("o_orderkey") % 400).alias("day0"))
    origin = cal.day_number(*[F.lit(x) for x in (1995, 1, 1)])
    return o.select("o_orderkey", *[cal.passed(F.col("day"), F.col("s"), F.col("day0"), F.col("s"), origin, n, u).alias(f"p_{u.lower()}") for u, n in _STEPS.items()])


@query("cal_perpetual", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1979 ELSE year(o_orderdate) END AS y, CASE WHEN o_orderstatus = 'P' THEN 3 ELSE month(o_orderdate) END AS m, CASE WHEN o_orderstatus = 'P' THEN 21 ELSE day(o_orderdate) END AS d FROM orders")
def cal_perpetual(spark, d):
    """Dates that stand still at an equinox for some orders."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", cal.day_number(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate")).alias("day"))
    y, m, dd = cal.perpetual(F.col("day"), (1979, 3, 21), F.col("o_orderstatus") == "P")
    return o.select("o_orderkey", y.alias("y"), m.alias("m"), dd.alias("d"))


@query("cal_sizes", "WITH o AS (SELECT o_orderkey, day(last_day(o_orderdate)) AS dm, date_diff('day', make_date(year(o_orderdate), 1, 1), make_date(year(o_orderdate) + 1, 1, 1)) AS dy FROM orders) SELECT o_orderkey, CAST(12 AS BIGINT) AS months, dy AS days, CAST(dm * 24 AS BIGINT) AS hours, CAST(dm * 1440 AS BIGINT) AS minutes, dy * 86400 AS seconds, CAST(86400 AS BIGINT) AS day_seconds, CAST(60 AS BIGINT) AS hour_minutes FROM o")
def cal_sizes(spark, d):
    o = _dates(spark, d)
    y, m = F.col("y"), F.col("m")
    size = lambda a, b, name: cal.size_of(a, b, y, m).alias(name)
    return o.select("o_orderkey", size("Y", "MO", "months"), size("Y", "D", "days"), size("MO", "H", "hours"), size("MO", "MI", "minutes"), size("Y", "S", "seconds"), size("D", "S", "day_seconds"), size("H", "MI", "hour_minutes"))


@query("across_wmv", f"WITH x AS (SELECT *, l_tax + l_extendedprice AS w, (l_quantity * l_tax + l_discount * l_extendedprice) / (l_tax + l_extendedprice) AS mean FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_cents_sql('mean')} AS mean, CAST(round(l_tax * (l_quantity - mean) * (l_quantity - mean) + l_extendedprice * (l_discount - mean) * (l_discount - mean)) AS BIGINT) AS s, {_cents_sql('w')} AS w FROM x")
def across_wmv(spark, d):
    """Weighted moments across two values of a cell."""
    got = across("WMV", [F.col("l_quantity"), F.col("l_discount")], [F.col("l_tax"), F.col("l_extendedprice")])
    return _t(spark, d, "lineitem").select(*cellwise._LINE, _cents(got["mean"]).alias("mean"), F.round(got["s"]).cast("long").alias("s"), _cents(got["w"]).alias("w"))
