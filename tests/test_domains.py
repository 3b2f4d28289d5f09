"""Ranges and cells after alignment, what is known of fields, catalogues, long axes, regridding, moments, dates, axes, Gauss latitudes."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.field import Coord, Field
from gridloom.functions import calendar as cal
from gridloom.functions import geometry
from gridloom.functions.scalar import OPERATORS
from gridloom.meta import Meta, properties
from gridloom.operators import align, records
from gridloom.operators.axes import checked
from gridloom.operators.order import nearest, with_neighbours
from gridloom.operators.reduce import weighted_moments
from gridloom.operators.regrid import apply_jagged, apply_vector, apply_weights, completed, derivative, jagged
from gridloom.sources import catalogue, files

R = random.Random(5)


def box(spark, value=1.0, rec=None, **ranges):
    """A field that has every cell of a box; ``value`` may be a function of the coordinates."""
    names = list(ranges)
    cells = [(*c, float(value(*c) if callable(value) else value)) for c in itertools.product(*(range(*r) for r in ranges.values()))]
    if rec is not None:
        cells = [(*c[:-1], r, c[-1]) for r in range(rec) for c in cells]
    schema = ", ".join(f"{n} long" for n in [*names, *(["r"] if rec is not None else []), ]) + ", v double"
    return Field.of(spark.createDataFrame(cells, schema), "v", [Coord(n, *r) for n, r in ranges.items()], rec="r" if rec is not None else None)


def cells(field):
    return sorted((tuple(r[k] for k in field.keys), r.v) for r in field.df.collect())


def ranges(field):
    return {c.name: (c.begin, c.end) for c in field.coords}


def test_a_chain_sees_the_range_of_the_alignment(spark):
    x = box(spark, lon=(0, 2))
    both = x.op("LADD", x.shift("lon", 1))
    assert ranges(both) == {"lon": (0, 3)} and cells(both) == [((0,), 1.0), ((1,), 2.0), ((2,), 1.0)]
    assert both.reduce("ADD", "lon").df.first().v == 4.0
    shared = x.op("ADD", x.shift("lon", 1), mode="intersect")
    assert ranges(shared) == {"lon": (1, 2)} and shared.reduce("ADD", "lon").df.first().v == 2.0
    assert x.op("ADD", x.shift("lon", 1)).reduce("ADD", "lon").df.first().v is None
    assert ranges(x.op("ADD", x.shift("lon", 1), mode="first")) == {"lon": (0, 2)}
    assert cells(both.shift("lon", 1, cycle=3)) == [((0,), 1.0), ((1,), 1.0), ((2,), 2.0)]


def test_documented_domains(spark):
    """Five and three cells that share two: six, two and five in the result."""
    a, b = (box(spark, lambda x: 115 + x, lon=r) for r in ((0, 5), (3, 6)))
    show = lambda mode: [(r.lon, r.v0, r.v1) for r in align.aligned([a, b], mode).df.orderBy("lon").collect()]
    assert show("inclusive") == [(0, 115, None), (1, 116, None), (2, 117, None), (3, 118, 118), (4, 119, 119), (5, None, 120)]
    assert show("intersect") == [(3, 118, 118), (4, 119, 119)]
    assert show("first") == [(0, 115, None), (1, 116, None), (2, 117, None), (3, 118, 118), (4, 119, 119)]


def brute_aligned(fields, mode):
    """Cells of the domain by the definition: each operand looked up in each cell."""
    names = list(dict.fromkeys(n for f in fields for n in f.names))
    held = [dict(cells(f)) for f in fields]
    span = {}
    for n in names:
        own = [ranges(f)[n] for f in fields if n in f.names]
        own = own[:1] if mode == "first" else own
        b, e = (max, min) if mode == "intersect" else (min, max)
        span[n] = (b(x for x, _ in own), e(y for _, y in own))
    out = []
    for c in itertools.product(*(range(*span[n]) for n in names)):
        at = dict(zip(names, c))
        got = [h.get(tuple(at[n] for n in f.names), "out") for f, h in zip(fields, held)]
        outside = all(any(not ranges(f)[n][0] <= at[n] < ranges(f)[n][1] for n in f.names) for f in fields)
        if mode == "intersect" and "out" in got or set(got) == {"out"} and not outside:
            continue
        out.append((c, tuple(None if g == "out" else g for g in got), tuple(g != "out" for g in got)))
    return sorted(out)


@pytest.mark.parametrize("mode", ["inclusive", "intersect", "first"])
def test_alignment_against_brute_force(spark, mode):
    made = [
        [dict(lon=(0, 4)), dict(lon=(0, 8), lat=(0, 2))], [dict(lon=(0, 8), lat=(0, 2)), dict(lon=(0, 4))], [dict(lon=(0, 8)), dict(lon=(2, 4), lat=(0, 2))], [dict(lon=(0, 2)), dict(lon=(5, 7))],
        [dict(lon=(0, 3), lat=(0, 3)), dict(lon=(2, 5), lat=(2, 5))], [dict(lon=(0, 3), lat=(0, 2)), dict(lat=(1, 4), lev=(0, 2))], [dict(lon=(0, 3), lat=(0, 2)), dict(lon=(1, 4), lat=(0, 2)), dict(lat=(0, 3))],
        [dict(lon=(0, 3)), dict(lon=(2, 5)), dict(lon=(4, 6))],
    ]
    for shapes in made:
        fields = [box(spark, lambda *c, i=i: sum(x * 10**k for k, x in enumerate(c)) + i / 4, **s) for i, s in enumerate(shapes)]
        got = align.aligned(fields, mode)
        n = range(len(fields))
        rows = sorted((tuple(r[k] for k in got.names), tuple(r[f"v{i}"] for i in n), tuple(r[f"in{i}"] for i in n)) for r in got.df.collect())
        assert rows == brute_aligned(fields, mode), (mode, shapes)


def test_alignment_of_records_and_sparse_cells(spark):
    a, b = box(spark, rec=2, lon=(0, 2), lat=(0, 1)), box(spark, 2.0, rec=3, lon=(1, 3), lat=(0, 2))
    out = a.op("LADD", b)
    assert len(cells(out)) == 2 * 6 + 5 and out.has_rec  # record 2 is in one operand only: its four cells and the missing one that no box has
    assert [v for (r, x, y), v in cells(out) if (x, y) == (0, 1)] == [None] * 3
    holed = Field(a.df.where("lon <> 0"), a.coords, True)
    assert len(cells(holed.op("LADD", holed))) == 2 and len(cells(holed.complete())) == 4 and cells(holed.complete())[0] == ((0, 0, 0), None)


def test_folds_of_several_operands(spark):
    a = box(spark, lon=(0, 1))
    v = lambda f: f.df.first().v
    assert v(a.op("LADD", a, a)) == 3 and v(a.op("ADD", a, 5.0, a)) == 8 and v(a.op("SUB", 1.0, a)) == -1 and v(a.op("LSUB", 5.0, a)) == -5 and v(a.map("ADD", 1, 2)) == 4
    with pytest.raises(ValueError):
        a.op("BLEND", a)


def test_names(spark):
    f = lambda *names: Field.of(spark.range(0).select(*[F.col("id").alias(n) for n in names], F.col("id").alias("v")), "v", list(names))
    merged = lambda *fields, names=None: align.merged_names([f(*x) for x in fields], names)
    assert merged(["a", "b"], ["b", "c"]) == ["a", "b", "c"] and merged(["b", "c"], ["a", "b"]) == ["a", "b", "c"] and merged(["a", "b"], ["b", "a"]) == ["a", "b"]
    assert merged(["a"], ["b"], names=["*", "a"]) == ["b", "a"] and merged(["a", "b"], ["b", "c"], names=["c", "*"]) == ["c", "a", "b"]
    with pytest.raises(align.AmbiguousCoordinates):
        merged(["a"], ["b"])
    with pytest.raises(align.AmbiguousCoordinates):
        merged(["a", "b"], ["b", "c"], ["c", "a"])
    for wrong in (["a"], ["a", "b", "d"], ["a", "a", "b"], ["*", "*"]):
        with pytest.raises(ValueError):
            merged(["a"], ["b"], names=wrong)


def test_metadata_goes_through_parquet(spark, tmp_path):
    x = Field.of(box(spark, lambda a, b: a - 1, lon=(0, 4), lat=(2, 5)).df, "v", [Coord("lon", 0, 4, 4), Coord("lat", 2, 5)], item="t", title="temperature", unit="K", missing=-999.0)
    y = x.op("DIV", x.map("SUB", 1)).map("MUL", 2).map("FLOOR").permute("lat")
    assert y.meta == Meta("t t 1 SUB DIV 2 MUL FLOOR", "FLOOR(temperature/(temperature-1)*2)", "K", -999.0)
    files.write_field(y, str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).where("v = -999").count() == 3  # where the divisor is 0
    back = files.read_field(spark, str(tmp_path / "y"))
    assert (back.meta, back.coords, back.kind, cells(back)) == (y.meta, y.coords, "int", cells(y))
    assert ranges(files.read_field(spark, str(tmp_path / "y"), lat=(3, 4))) == {"lat": (3, 4), "lon": (0, 4)}
    r = properties([y, x.titled(unit="C")]).orderBy("position").collect()
    assert tuple(r[0])[1:6] == ("t t 1 SUB DIV 2 MUL FLOOR", y.meta.title, "K", "int", "[lat/2:5 lon/0:4]") and r[0].n_missing == 3 and r[1].unit == "C" and x.properties().first().high == 2.0
    z = box(spark, rec=2, lon=(0, 2))
    files.write_field(z.titled(item="z"), str(tmp_path / "z"))
    back = files.read_field(spark, str(tmp_path / "z"), rec=(1, 2))
    assert back.has_rec and back.meta.item == "z" and [k for k, _ in cells(back)] == [(1, 0), (1, 1)]


def test_formulas():
    a, b, c = (Meta(x) for x in "abc")
    assert a.after("SUB", b.after("SUB", c)).title == "a-(b-c)" and a.after("SUB", b, c).title == "a-b-c" and a.after("ADD", b).after("MUL", c).title == "(a+b)*c"
    assert a.after("SUB", b, c).item == "a b SUB c SUB" and a.after("IFELSE", b, 2.0).item == "a b 2 IFELSE" and Meta().after("ADD", 1).item == "? 1 ADD"


def test_catalogue_prunes_files(spark, tmp_path):
    made = [(g, v, r, 10.0 * r + len(g), x, float(x)) for g in ("g1", "group2") for v in ("t", "u") for r in range(20) for x in range(3)]
    catalogue.write_records(spark.createDataFrame(made, "grp string, var string, rec long, time double, x long, v double"), str(tmp_path / "c"))
    known = spark.read.parquet(str(tmp_path / "c/catalogue"))
    assert known.count() == 80 and catalogue.groups(known).where("grp = 'g1' AND var = 'u'").first()[2:] == (20, 2.0, 192.0)
    asked = spark.createDataFrame([("g1", "t", 55.0), ("g1", "t", 2.0), ("g1", "t", 1.0), ("group2", "u", 1e9), ("none", "u", 5.0)], "grp string, var string, time double")
    assert sorted((r.grp, r.time, r.rec) for r in catalogue.record_at(known, asked).collect() if r.rec is not None) == [("g1", 2.0, 0), ("g1", 55.0, 5), ("group2", 1e9, 19)]
    cells_ = catalogue.read_at(spark, str(tmp_path / "c"), asked)
    assert cells_.count() == 9 and "dynamicpruning" in cells_._jdf.queryExecution().executedPlan().toString()
    within = known.select("grp", "var").distinct().withColumn("low", F.lit(13.0)).withColumn("high", F.lit(17.0))
    assert {r.grp: r.rec for r in catalogue.record_within(known, within).collect()} == {"g1": None, "group2": 1}
    one = catalogue.read_variable(spark, str(tmp_path / "c"), "g1", "t", (3, 5))
    assert one.count() == 6 and "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("later", [False, True])
def test_nearest_against_brute_force(spark, later):
    marks = [(R.choice([1, 2, None]), R.choice([None, *range(0, 300, 7)]), i) for i in range(150)]
    asked = [(R.choice([1, 2, 3, None]), R.choice([None, *range(-5, 320)]), i) for i in range(400)]
    m, a = (spark.createDataFrame(x, f"k int, t int, {n} int") for x, n in ((marks, "i"), (asked, "id")))
    got = {r.id: r.found for r in nearest(m, a, ["k"], "t", F.col("i"), "found", later, blocks=16).collect()}
    for k, t, i in asked:
        met = [(x, j) for kk, x, j in marks if k is not None and kk == k and x is not None and t is not None and (x >= t if later else x <= t)]
        best = (min if later else max)((x for x, _ in met), default=None)
        assert got[i] == (min if later else max)((j for x, j in met if x == best), default=None)


@pytest.mark.parametrize("cyclic", [False, True])
def test_neighbours_across_blocks(spark, cyclic):
    rows = [(k, x, x * 2.0) for k in (1, None) for x in sorted(R.sample(range(1000), 120))] + [(7, 500, 1.0)]
    df = spark.createDataFrame(rows, "k int, x int, v double").repartition(3)
    got = {(r.k, r.x): (r.before and r.before.v, r.after and r.after.v) for r in with_neighbours(df, ["k"], "x", {"v": F.col("v")}, blocks=16, cyclic=cyclic).collect()}
    for k in (1, None, 7):
        line = [(x, v) for kk, x, v in rows if kk == k]
        for i, (x, _) in enumerate(line):
            before = line[i - 1][1] if i or cyclic else None
            after = line[(i + 1) % len(line)][1] if i + 1 < len(line) or cyclic else None
            assert got[k, x] == (before, after)
    assert len(got) == len(rows)


def test_no_axis_is_one_task(spark):
    df = spark.range(5000).select("id", (F.col("id") * 0.5).alias("x"), F.pow(F.col("id") * 0.5, F.lit(2.0)).alias("v"))
    out = derivative(df, "id", F.col("x"), [], degrees=True)
    worst = out.where("id > 0 AND id < 4999").agg(F.max(F.abs(F.col("slope") - 2 * F.col("x") * (180 / math.pi)))).first()[0]
    assert worst < 1e-6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__block" in plan


def weights_and_field(spark):
    w = [(d, s, R.uniform(-1, 1)) for d in range(40) for s in R.sample(range(60), R.randint(0, 6))]
    f = [(k, s, None if R.random() < 0.03 else R.uniform(-5, 5)) for k in (1, 2) for s in range(60) if R.random() < 0.9]
    return spark.createDataFrame(w, "dst long, src long, w double"), spark.createDataFrame(f, "k int, x long, v double"), w, f


@pytest.mark.parametrize("size", [1, 7, 100])
def test_jagged_apply_is_the_sparse_apply(spark, size):
    w, f, _, _ = weights_and_field(spark)
    of = lambda df: {(r.k, r.x): r.v for r in df.collect()}
    got, want = of(apply_jagged(f, jagged(w, size), "x", ["k"])), of(apply_weights(f, w, "x", ["k"]))
    assert got.keys() == want.keys() and all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) < 1e-9) for k, a in got.items())
    sizes = [[len(x.dst) for x in r.layers] for r in jagged(w, size).collect()]
    assert all(s == sorted(s, reverse=True) for s in sizes) and sum(map(sum, sizes)) == w.count()


def test_vector_apply(spark):
    w, f, raw, cells_ = weights_and_field(spark)
    two = f.withColumn("u", F.col("x") * 1.0)
    both = w.withColumn("wu", F.col("w") * F.col("src"))
    got = {(r.k, r.x): r.v for r in apply_vector(two, both, "x", {"v": "w", "u": "wu"}, ["k"], denominator="w", destinations=spark.range(45).withColumnRenamed("id", "dst"), undefined=-9.0).collect()}
    for k in (1, 2):
        held = {x: v for kk, x, v in cells_ if kk == k}
        for d in range(45):
            own = [(s, a) for dd, s, a in raw if dd == d and s in held]
            below = sum(a for dd, _, a in raw if dd == d)
            if not own:
                assert got[k, d] == -9.0
            elif any(held[s] is None for s, _ in own):
                assert got[k, d] is None
            else:
                assert got[k, d] == pytest.approx(sum(a * held[s] + a * s * s for s, a in own) / below)
    none = completed(spark.createDataFrame([], "dst long, v double"), spark.range(3).withColumnRenamed("id", "dst"), [])
    assert sorted(r.dst for r in none.where("v IS NULL").collect()) == [0, 1, 2]


def test_moments_do_not_cancel(spark):
    rows = [(g, None if R.random() < 0.1 else 1e9 + R.random(), float(R.randint(0, 5)), "é") for g in ("a", "b", None) for _ in range(3000)] + [("z", 1.0, 0.0, "é"), ("n", None, 1.0, "é")]
    df = spark.createDataFrame(rows, "g string, v double, w double, h string").repartition(5)
    got = {r.g: r for r in weighted_moments(df, ["g", "h"], "v", "w").collect()}
    for g in ("a", "b", None):
        x = [(Fraction(v), Fraction(w)) for gg, v, w, _ in rows if gg == g and v is not None]
        total = sum(w for _, w in x)
        mean = sum(v * w for v, w in x) / total
        s = sum(w * (v - mean) ** 2 for v, w in x)
        assert got[g].w == total and got[g].mean == pytest.approx(float(mean), rel=1e-15) and got[g].s == pytest.approx(float(s), rel=1e-8)
    assert (got["z"].mean, got["z"].s, got["z"].w) == (None, None, 0.0) and "n" not in got
    whole = weighted_moments(df, [], "v", "w")
    assert whole.count() == 1 and whole._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1


def test_bits_of_floats(spark):
    values = [0.0, -0.0, 1.0, -1.0, 8.0, -8.0, 0.1, 1e300, -1e300, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 * 1.5, 1.7976931348623157e308, 2.0**1023, 3.0, 1 - 2.0**-53, 1 + 2.0**-52, 2.0**-1060 * 3, *(math.ldexp(R.uniform(-1, 1), R.randint(-1070, 1023)) for _ in range(300))]
    f = lambda name, *a: OPERATORS[name](F.col("x"), *map(F.lit, a))
    df = spark.createDataFrame([(v,) for v in [*values, math.nan, math.inf, -math.inf, None]], "x double")
    got = df.select("x", f("FRACTION"), f("EXPONENT"), f("SPACING"), f("RRSP"), f("NEAREST", 1.0), f("NEAREST", -1.0), f("SETE", 3.0)).collect()
    for x, *r in got:
        if x is None:
            assert r == [None] * 7
        elif math.isnan(x) or math.isinf(x):
            assert all(map(math.isnan, (r[0], r[2], r[3], r[6]))) and r[1] == 2**31 - 1
            assert all(map(math.isnan, r[4:6])) if math.isnan(x) else (r[4], r[5]) == (math.nextafter(x, math.inf), math.nextafter(x, -math.inf))
        else:
            m, e = math.frexp(x)
            assert r[:6] == [m, float(e), max(math.ulp(x), 2.0**-1022) if x else 2.0**-1022, abs(m) * 2.0**53, math.nextafter(x, math.inf), math.nextafter(x, -math.inf)], x
            assert r[6] == m * 8


def test_passed_and_fixed_dates(spark):
    one = spark.range(1)
    day = lambda y, m, d: cal.day_number(*map(F.lit, (y, m, d)))
    zero = F.lit(0.0)
    ask = lambda now, then, n, unit, s=zero, s0=zero: cal.passed(day(*now), s, day(*then), s0, day(2000, 1, 1), n, unit)
    got = one.select(
        ask((2001, 1, 1), (2000, 1, 1), 1, "Y"), ask((2000, 12, 31), (2000, 1, 1), 1, "Y"), ask((2000, 3, 1), (2000, 2, 1), 1, "MO"), ask((2000, 2, 29), (2000, 2, 1), 1, "MO"), ask((2000, 2, 1), (2000, 2, 1), 5, "MO"),
        ask((1999, 12, 31), (1990, 1, 1), 1, "Y"), ask((2000, 1, 2), (2000, 1, 1), 1, "D"), ask((2000, 1, 1), (2000, 1, 1), 6, "H", F.lit(21600.0), F.lit(21599.0)), ask((2000, 1, 1), (2000, 1, 1), 6, "H", F.lit(21599.0), F.lit(1.0)), ask((2000, 1, 1), (2000, 1, 1), 6, "H"),
    ).first()
    assert list(got) == [True, False, True, False, True, False, True, True, False, True]
    y, m, d = cal.perpetual(day(2020, 5, 5), (1979, 3, 21))
    assert tuple(one.select(y, m, d, *cal.perpetual(day(2020, 5, 5), (1979, 3, 21), on=False)).first()) == (1979, 3, 21, 2020, 5, 5)
    size = lambda a, b, k=cal.LEAP: cal.size_of(a, b, F.lit(2024), F.lit(2), k)
    assert list(one.select(size("Y", "D"), size("MO", "S"), size("MO", "D", cal.IDEAL), size("D", "MI"), size("H", "S"), size("Y", "MO")).first()) == [366, 29 * 86400, 30, 1440, 3600, 12]
    with pytest.raises(ValueError):
        size("D", "MO")


def test_axis_checks(spark):
    axes = {"even": [-2.0, -1.0, 0.0, 1.0, 2.0], "odd": [3.0, 1.0, -1.0, -3.0], "part": [-1.0, 0.0, 1.0, 2.0], "lopsided": [-1.5, -1.0, 1.0, 2.0], "one": [4.0], "flat": [1.0, 1.0], "tenths": [0.1 * i for i in range(30)], "thirds": [0.0, 1.0, 3.0], "positive": [1.0, 2.0]}
    got = {r.axis: r for r in checked(spark.createDataFrame([(k, j, x) for k, v in axes.items() for j, x in enumerate(v)], "axis string, j long, x double")).collect()}
    show = {k: (r.monotonic, r.spacing, r.equidistant, r.symmetry, r.spans) for k, r in got.items()}
    assert show == {
        "even": (1, "strict", True, "even", True), "odd": (-1, "strict", True, "odd", True), "part": (1, "strict", True, "even", False), "lopsided": (1, "none", False, "none", False), "one": (0, "none", True, "none", False),
        "flat": (0, "none", True, "none", False), "tenths": (1, "enough", True, "none", False), "thirds": (1, "none", False, "none", False), "positive": (1, "strict", True, "none", False),
    }
    loose = checked(spark.createDataFrame([("a", j, x) for j, x in enumerate([-1.01, 0.0, 1.0])], "axis string, j long, x double"), tolerance=0.1).first()
    assert (loose.symmetry, loose.equidistant) == ("even", True) and loose.asymmetry == pytest.approx(0.01)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 335, 1000])
def test_gauss_latitudes(spark, n):
    rows = geometry.gauss_latitudes(spark, n).orderBy("j").collect()
    assert [r.j for r in rows] == list(range(n)) and abs(math.fsum(r.weight for r in rows) - 2) < 1e-14
    x, w = np.polynomial.legendre.leggauss(n)
    assert np.allclose([math.sin(math.radians(r.lat)) for r in rows], x[::-1], atol=1e-14) and np.allclose([r.weight for r in rows], w[::-1], rtol=1e-10)


def test_southern_plane_lengths_and_areas(spark):
    one = spark.range(1)
    x, y = geometry.stereographic(F.lit(30.0), F.lit(-60.0), south=True)
    lon, lat = geometry.stereographic_inverse(x, y, south=True)
    far = geometry.stereographic(F.lit(30.0), F.lit(-80.0), south=True)
    along = geometry.plane_length(x, y, *far)  # a meridian is straight
    around = geometry.cell_area(F.lit(0.0), F.lit(360.0), F.lit(-90.0), F.lit(90.0))
    got = one.select(lon, lat, along, around, geometry.scale_factor(F.lit(-90.0), south=True), geometry.plane_length(x, y, x, y)).first()
    assert list(got) == pytest.approx([30, -60, math.radians(20), 4 * math.pi, 1, 0])


def test_sequences_without_a_job(spark):
    f = lambda n, k: Field.of(spark.range(n).select(F.col("id").alias("r"), F.lit(0).alias("x"), (F.col("id") * k).alias("v")), "v", ["x"], rec="r")
    of = lambda field: {r.rec: r.v for r in field.df.collect()}
    a, b = records.in_step([f(7, 1), f(3, 10)], ["terminate", "cyclic"])
    assert of(a) == {i: i for i in range(7)} and of(b) == {i: 10 * (i % 3) for i in range(7)}
    a, b = records.in_step([f(2, 1), f(5, 10)], ["persistent", "cyclic"])
    assert of(a) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1} and of(b) == {i: 10 * i for i in range(5)}
    a, b = records.in_step([f(2, 1), f(5, 10)], ["terminate", "cyclic"])
    assert of(b) == {0: 0, 1: 10}
    with pytest.raises(records.InsufficientRecords):
        records.in_step([f(2, 1), f(5, 10)], ["terminate", "terminate"])
