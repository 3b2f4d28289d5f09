"""Golden results of small fields, truth tables, calendars, regridding and comparison."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.field import Coord, Field
from gridloom.functions import calendar as cal
from gridloom.functions import geometry
from gridloom.functions.scalar import LAZY, OPERATORS
from gridloom.operators import align, records
from gridloom.operators.compare import beyond, compare
from gridloom.operators.reduce import across, weighted_moments
from gridloom.operators.regrid import apply_weights, derivative, jagged_order, overlap_weights


@pytest.fixture(scope="module")
def base(spark):
    cells = [(r, x, y, z, float(x + 10 * y + 100 * z + 1000 * r)) for r in range(3) for x in range(8) for y in range(4) for z in range(3)]
    df = spark.createDataFrame(cells, "rec long, lon long, lat long, lev long, v double")
    return Field.of(df, "v", [Coord("lon", 0, 8), Coord("lat", 0, 4), Coord("lev", 0, 3)], rec="rec")


@pytest.fixture(scope="module")
def mask(spark):
    cells = [(x, y, z, 1.0 if x >= y and x >= z else None) for x in range(8) for y in range(7) for z in range(6)]
    return Field.of(spark.createDataFrame(cells, "lon long, lat long, lev long, v double"), "v", [Coord("lon", 0, 8), Coord("lat", 0, 7), Coord("lev", 0, 6)])


def line(spark, values, begin=0, name="lon"):
    df = spark.createDataFrame([(begin + i, v) for i, v in enumerate(values)], f"{name} long, v double")
    return Field.of(df, "v", [Coord(name, begin, begin + len(values))])


def values(field):
    return [r["v"] for r in field.cells().collect()]


def test_flat_index(base):
    one = Field(base.df.where("rec = 0").drop("rec"), base.coords)
    got = {(r.lon, r.lat, r.lev): r.v for r in one.flat().df.collect()}
    assert got[(7, 3, 2)] == 95 and got[(1, 2, 1)] == 1 + 8 * 2 + 32
    moved = one.flat("lat", "lon")
    assert moved.names == ["lat", "lon", "lev"]
    assert {(r.lon, r.lat): r.v for r in moved.df.collect()}[(2, 3)] == 3 + 4 * 2


def test_counts(mask):
    assert values(mask.reduce("COUNT")) == [175]
    by = {(r.lat, r.lev): r.v for r in mask.reduce("COUNT", "lon").df.collect()}
    assert [by[(y, 0)] for y in range(7)] == [8, 7, 6, 5, 4, 3, 2]
    assert [by[(y, 1)] for y in range(3)] == [7, 7, 6]
    by = {r.lat: r.v for r in mask.reduce("COUNT", "lev", "lon").df.collect()}
    assert [by[y] for y in range(7)] == [33, 32, 30, 27, 23, 18, 12]
    by = {(r.lat, r.lev): r.v for r in mask.reduce("COUNT", "lon", ranges={"lon": (2, 6)}).df.collect()}
    assert [by[(y, 0)] for y in range(7)] == [4, 4, 4, 3, 2, 1, 0]


def test_strict_and_lazy_reductions(spark, mask):
    x = line(spark, [1.0, None, 3.0])
    assert values(x.reduce("ADD")) == [None] and values(x.reduce("LADD")) == [4.0]
    assert values(x.reduce("MAX")) == [None] and values(x.reduce("LMIN")) == [1.0]
    none = line(spark, [None, None])
    assert values(none.reduce("SUM")) == [0.0] and values(none.reduce("LADD")) == [None] and values(none.reduce("COUNT")) == [0.0]
    gap = Field.of(x.df.where("lon <> 1"), "v", [Coord("lon", 0, 3)])
    assert values(gap.reduce("ADD")) == [None]  # a cell of the box is not there
    with pytest.raises(KeyError):
        x.reduce("SUM", "lat")


def test_sub_region_and_addition(spark):
    yz = line(spark, [float(v) for v in range(115, 123)])
    assert values(yz.select(lon=(2, 5))) == [117, 118, 119]
    zx = line(spark, [103.0, 113.0, 123.0, 133.0], name="lat")
    some = zx.select(lat=(1, 3))
    got = zx.op("ADD", some)
    assert values(got) in ([None, 226.0, 246.0, None],)
    assert values(zx.op("ADD", some, mode="first")) == [None, 226.0, 246.0, None]
    assert values(zx.op("ADD", some, mode="intersect")) == [226.0, 246.0]
    with pytest.raises(align.AmbiguousCoordinates):
        zx.op("ADD", yz)


def test_domains(spark):
    yz = line(spark, [float(v) for v in range(115, 123)])
    five, two = yz.select(lon=(0, 5)), yz.select(lon=(3, 6))
    assert [align.aligned([five, two], m).df.count() for m in ("inclusive", "intersect", "first")] == [6, 2, 5]


def test_shift(spark):
    x = line(spark, [float(i) for i in range(8)])
    moved = {r.lon: r.v for r in x.shift("lon", 1).df.collect()}
    assert moved[8] == 7 and 0 not in moved and moved[1] == 0
    ring = Field.of(line(spark, [2.0, 3.0, 4.0, 5.0], 2).df, "v", [Coord("lon", 1, 8)])
    want = {1: {3: 2, 4: 3, 5: 4, 6: 5}, 5: {1: 5, 7: 2}, 7: {1: 3, 2: 4, 3: 5}, -1: {1: 2, 2: 3, 3: 4, 4: 5}}
    for by, cells in want.items():
        assert {r.lon: r.v for r in ring.shift("lon", by, cycle=9).df.collect() if r.lon >= 1} == cells, by
    with pytest.raises(ValueError):
        ring.shift("lon", 1, cycle=5)


def test_interpolation(spark):
    x = line(spark, [float(i) for i in range(8)])
    f = x.index("lon").map("SQR").op("ADD", x)
    got = f.op("ADD", f.shift("lon", -1), mode="intersect").map("DIV", 2.0)
    assert values(got) == [1.0, 4.0, 9.0, 16.0, 25.0, 36.0, 49.0]


def test_broadcast_and_spread(base):
    mean = base.reduce("SUM", "lon").map("DIV", 8.0)
    left = base.op("SUB", mean, mode="first").df
    assert left.count() == 8 * 4 * 3 * 3 and left.agg(F.sum("v")).first()[0] == 0
    assert mean.spread("lon", 0, 2).df.count() == 2 * 4 * 3 * 3


def test_records(base):
    assert sorted({r.rec for r in base.records(1, 3).df.collect()}) == [0, 1]
    two = base.records(0, None, 3, 2)
    assert two.names[-1] == "slot" and sorted({(r.rec, r.slot) for r in two.df.collect()}) == [(0, 0), (0, 1)]
    one = base.records(0, 1)
    for mode in ("cyclic", "persistent"):
        a, b = records.in_step([base, one], ["terminate", mode])
        assert records.count(b) == 3 and a.op("SUB", b, mode="first").df.where("rec = 2").agg(F.max("v"), F.min("v")).first() == (2000.0, 2000.0)
    with pytest.raises(records.InsufficientRecords):
        records.in_step([base, one], ["terminate", "terminate"])
    assert records.first_matching(base, F.col("v") > 1100).first().rec == 1
    assert records.count(one) == 1 and records.count(base.records(7)) == 0


def _lazy_table(spark, name):
    a = line(spark, [1.0, 1.0, None, None, 1.0, None], 0)
    b = line(spark, [2.0, None, 2.0, None], 0)
    return values(a.op(name, b))


@pytest.mark.parametrize(
    "name, want",
    [("OR", [1, 1, 2, None, 1, None]), ("ROR", [2, 1, 2, None, 1, None]), ("XOR", [None, 1, 2, None, 1, None]), ("LAND", [2, None, None, None, 1, None]), ("LMASK", [1, None, None, None, 1, None]),
     ("LLAY", [1, 1, None, None, 1, None]), ("RLAY", [2, None, 2, None, 1, None]), ("LADD", [3, 1, 2, None, 1, None]), ("LSUB", [-1, 1, None, None, 1, None]), ("LMIN", [1, 1, 2, None, 1, None])],
)
def test_lazy_truth_tables(spark, name, want):
    assert _lazy_table(spark, name) == want
    assert name in LAZY


@pytest.mark.parametrize(
    "name, args, want",
    [("MODULO", (7, -3), -2), ("MOD", (7, -3), 1), ("MOD", (-7, 3), -1), ("IDIV", (7, 0.5), None), ("IDIV", (-7, 2), -3), ("DIV", (1, 0), None), ("POW", (0, 0), None), ("POW", (-8, 1 / 3), None), ("POW", (-2, 3), -8),
     ("ROUND", (-3.5,), -4), ("ROUND", (2.5,), 3), ("TRUNC", (-2.7,), -2), ("ZSIGN", (-0.0,), 0), ("SIGN1", (0.0,), 1), ("SQRT", (-1.0,), None), ("LOG", (0.0,), None), ("RSHIFT", (-8, 1), 2147483644), ("LSHIFT", (1, 33), 0),
     ("LSHIFT", (8, -2), 2), ("BITNOT", (5,), -6), ("BITAND", (6, 3), 2), ("BITNOT", (3e9,), None), ("FRACTION", (8.0,), 0.5), ("EXPONENT", (8.0,), 4), ("SETE", (8.0, 1), 1.0), ("SCALE", (3.0, 2), 12), ("INRANGE", (5, 1, 5), 5), ("INRANGE", (6, 1, 5), None), ("BLEND", (1, 3, 0.25), 2.5),
     ("NEAREST", (1.0, 1.0), math.nextafter(1.0, 2.0)), ("SPACING", (1.0,), 2.0**-52), ("RRSP", (1.0,), 2.0**52), ("EQB", (1, 2), 0), ("GTF", (3, 2), 3), ("ID", (3, 3), 1)],
)
def test_scalars(spark, name, args, want):
    df = spark.createDataFrame([tuple(map(float, args))], [f"c{i}" for i in range(len(args))])
    assert df.select(OPERATORS[name](*map(F.col, df.columns))).first()[0] == want


def test_missing_operands(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(OPERATORS["EQ"](a, b), OPERATORS["EQB"](a, b), OPERATORS["NOT"](a), OPERATORS["BIN"](a), OPERATORS["MIN"](a, b), OPERATORS["IFELSE"](a, a, b), OPERATORS["ID"](a, a), OPERATORS["SPACING"](a)).first()
    assert list(got) == [None, 0.0, 1.0, 0.0, None, 1.0, 1.0, None]


def test_across_and_moments(spark):
    df = spark.createDataFrame([(1.0, None, 3.0)], "a double, b double, c double")
    x = [F.col(c) for c in "abc"]
    w = [F.lit(1.0), F.lit(5.0), F.lit(3.0)]
    assert df.select(across("COUNT", x)["v"], across("SUM", x)["v"], across("LADD", x)["v"], across("ADD", x)["v"]).first() == (2.0, 4.0, 4.0, None)
    assert df.select(*across("WMV", x, w).values()).first() == (2.5, 3.0, 4.0)
    rows = spark.createDataFrame([(1, 1.0, 1.0), (1, 3.0, 3.0), (1, None, 9.0)], "k long, v double, w double")
    assert weighted_moments(rows, ["k"], "v", "w").first() == (1, 2.5, 3.0, 4.0)


@pytest.mark.parametrize("kind", [cal.IDEAL, cal.NO_LEAP, cal.LEAP])
def test_calendar_round_trip(spark, kind):
    days = spark.range(-1000, 800_000, 97).withColumnRenamed("id", "day")
    y, m, d = cal.date_of(F.col("day"), kind)
    got = days.select("day", y.alias("y"), m.alias("m"), d.alias("d"))
    bad = got.where((cal.day_number(F.col("y"), F.col("m"), F.col("d"), kind) != F.col("day")) | ~F.col("m").between(1, 12) | (F.col("d") < 1) | (F.col("d") > cal.days_in_month(F.col("y"), F.col("m"), kind)))
    assert bad.count() == 0


def test_calendar_values(spark):
    one = spark.range(1)
    n = lambda *x: list(map(F.lit, x))
    got = one.select(cal.day_number(*n(0, 1, 1)), cal.day_number(*n(2023, 13, 1), cal.IDEAL), cal.day_number(*n(2024, 1, 1), cal.IDEAL), cal.is_leap(F.lit(1900)), cal.is_leap(F.lit(2000)), cal.days_in_month(*n(1950, 2), cal.AUTO), cal.days_in_month(*n(900, 2), cal.AUTO)).first()
    assert list(got) == [1, 2024 * 360 + 1, 2024 * 360 + 1, False, True, 28, 30]
    day, second = cal.advance(*n(2000, 1, 31), F.lit(0.0), F.lit(25.0), "H")
    assert one.select(day - cal.day_number(*n(2000, 1, 31)), second, cal.passed(F.lit(3), F.lit(0.0), F.lit(2), F.lit(5.0), F.lit(1), 1, "D"), cal.as_text(*n(12345, 2, 3))).first() == (1, 3600.0, True, "123450203")
    assert one.select(*cal.from_text(F.lit("123450203")), *cal.hms(F.lit(3661))).first() == (12345, 2, 3, 1, 1, 1)


def test_regrid(spark):
    src = spark.createDataFrame([(i, float(i), i + 1.0) for i in range(24)], "cell long, low double, high double")
    dst = spark.createDataFrame([(i, i * 2.4 - 1.0, i * 2.4 + 1.4) for i in range(10)], "cell long, low double, high double")
    w = overlap_weights(src, dst, 24.0)
    assert all(abs(r.s - 1) < 1e-12 for r in w.groupBy("dst").agg(F.sum("w").alias("s")).collect())
    field = src.select(F.col("cell").alias("x"), F.col("cell").cast("double").alias("v"))
    out = apply_weights(field, w, "x")
    assert abs(out.agg(F.sum(F.col("v") * 2.4)).first()[0] - 276) < 1e-9
    holes = field.withColumn("v", F.when(F.col("x") != 5, F.col("v")))
    assert apply_weights(holes, w, "x").where("v IS NULL").count() > 0 and apply_weights(holes, w, "x", normalised=True).where("v IS NULL").count() == 0
    assert jagged_order(w).where("layer = 0").count() == 10
    curve = spark.createDataFrame([(i, x, x * x) for i, x in enumerate([0.0, 1.0, 3.0, 4.0])], "i long, x double, v double").withColumn("k", F.lit(0))
    assert [r.slope for r in derivative(curve, "i", F.col("x"), ["k"]).orderBy("i").collect()] == pytest.approx([1.0, 2.0, 6.0, 7.0])


def test_compare(spark):
    r = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (0, 2, None), (0, 3, 4.0)], "rec long, x long, v double")
    t = spark.createDataFrame([(0, 0, 1.5), (0, 1, 2.0), (0, 2, 3.0), (0, 3, None)], "rec long, x long, v double")
    assert compare(r, t, ["rec", "x"], ["rec"]).first() == (0, 1.0, 1.0, 2.0, 0.5, 2.0, 1, 1)
    assert beyond(r, t, ["rec", "x"], 0.6, 0.1).count() == 1


def test_geometry(spark):
    one = spark.range(1)
    x, y = geometry.stereographic(F.lit(30.0), F.lit(60.0))
    lon, lat = geometry.stereographic_inverse(x, y)
    got = one.select(lon, lat, geometry.great_circle(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)), geometry.phase(F.lit(-30.0)), geometry.scale_factor(F.lit(90.0))).first()
    assert list(got) == pytest.approx([30, 60, math.pi / 2, 330, 1])
    assert geometry.gauss_latitudes(spark, 8).agg(F.sum("weight")).first()[0] == pytest.approx(2)
    assert geometry.longitudes(spark, 8).count() == 8


def test_rounding_of_nan_and_large_values(spark):
    values = [1e20, -1e20, float("nan"), float("inf"), -2.5, 2.5, 0.0, 4503599627370497.0, -7.25]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = {"FLOOR": math.floor, "CEIL": math.ceil, "TRUNC": math.trunc, "INT": math.trunc, "ROUND": lambda v: math.copysign(math.floor(abs(v) + 0.5), v)}
    for name, f in want.items():
        for v, r in zip(values, df.select(OPERATORS[name](df.x).alias("y")).collect()):
            exact = v if not math.isfinite(v) or abs(v) >= 2**52 else float(f(v))
            assert r.y == exact or math.isnan(v) and math.isnan(r.y), (name, v, r.y)
    pairs = [(1e20, 7.0), (-1e20, 7.0), (5.5, -2.0), (-5.5, 2.0), (6.0, 3.0), (-6.0, 3.0)]
    got = spark.createDataFrame(pairs, "a double, b double").selectExpr("a", "b")
    for (a, b), r in zip(pairs, got.select(OPERATORS["MODULO"](got.a, got.b).alias("y"), OPERATORS["IDIV"](got.a, got.b).alias("z")).collect()):
        assert r.y == math.fmod(a, b) + (b if math.fmod(a, b) and (math.fmod(a, b) < 0) != (b < 0) else 0) and r.z == float(math.trunc(a / b))


def test_text_of_files_of_unequal_size(spark, tmp_path):
    from gridloom.sources.files import read_text

    values, at = [float(i) + 0.125 for i in range(3000)], 0
    (tmp_path / "t").mkdir()
    for k, n in enumerate((2, 1500, 1, 0, 1400, 97)):
        (tmp_path / "t" / f"part-{k}.txt").write_text("".join(f"{v}\n" for v in values[at : at + n]))
        at += n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = read_text(spark, str(tmp_path / "t"), {"x": 10, "y": 5}).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.v for r in sorted(got, key=lambda r: (r.rec, r.y, r.x))] == values


def test_wrong_uses_are_refused(spark):
    field = Field.of(spark.createDataFrame([(0, 1.0)], "lon long, v double"), "v", ["lon"])
    with pytest.raises(ValueError):
        field.op("BOOL", field)
    with pytest.raises(ValueError):
        cal.date_of(F.lit(1), "lunar")
    with pytest.raises(ValueError):
        records.tuples(field, [(1, 2), (3,)])
    with pytest.raises(ValueError):
        field.op("ADD", field, names=["lat"])


def test_auto_calendar_and_durations(spark):
    days = spark.range(0, 800_000).withColumnRenamed("id", "day")
    y, m, d = cal.date_of(F.col("day"), cal.AUTO)
    got = days.select("day", y.alias("y"), m.alias("m"), d.alias("d"))
    gap = F.col("day").between(360_001, 365_000) | F.col("day").between(693_501, 693_961)
    assert got.where(gap != F.col("y").isNull()).count() == 0
    assert got.where(cal.day_number(F.col("y"), F.col("m"), F.col("d"), cal.AUTO) != F.col("day")).count() == 0
    n = lambda *x: list(map(F.lit, x))
    one = spark.range(1)
    assert one.select(cal.duration_of(F.lit(86400.0 * 58), "MO", *n(2024, 2)), cal.duration_of(F.lit(7200.0), "H", *n(2024, 2)), cal.second_of(*n(1, 1, 1))).first() == (2.0, 2.0, 3661)
    day, second = cal.day_and_second(F.lit(-1.0))
    assert one.select(day, second, cal.seconds_since(day, second)).first() == (0, 86399.0, -1.0)


def test_listed_records(spark):
    field = Field.of(spark.createDataFrame([(r, 0, float(r)) for r in range(5)], "r long, x long, v double"), "v", ["x"], rec="r")
    assert sorted((r.rec, r.v) for r in records.listed(field, [3, 0, 3, 9]).df.collect()) == [(0, 3.0), (1, 0.0), (2, 3.0)]
    assert records.listed(field, []).df.count() == 0


def test_slope_on_a_circle(spark):
    curve = spark.createDataFrame([(i, float(x), float(v)) for i, (x, v) in enumerate([(0, 1), (90, 0), (180, -1), (270, 0)])], "i long, x double, v double").withColumn("k", F.lit(0))
    got = derivative(curve, "i", F.col("x"), ["k"], period=360.0).orderBy("i").collect()
    assert [r.slope for r in got] == pytest.approx([0, -1 / 90, 0, 1 / 90])
