"""Every query of the engine against its SQL, on the smallest tables; sources and streams."""

import glob
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.plans import catalog
from gridloom.sources import files
from gridloom.streaming.windows import windowed

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).removesuffix("+00:00")
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    rel = duck.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(rel.fetchall())


def test_float_bits(spark):
    got = catalog.QUERIES["float_bits"](spark, DATA).join(spark.read.parquet(f"{DATA}/events.parquet"), "event_id")
    assert got.where(F.abs(F.col("fraction") * F.pow(F.lit(2.0), F.col("exponent")) - F.col("value")) > 0).count() == 0


def test_text_round_trip(spark, tmp_path):
    cells = spark.range(24).select((F.col("id") / 12).cast("long").alias("rec"), (F.col("id") % 4).alias("x"), (F.col("id") % 12 / 4).cast("long").alias("y"), F.when(F.col("id") != 5, F.col("id") / 7).alias("v"))
    files.write_text(cells, str(tmp_path / "t"), ["rec", "y", "x"])
    back = files.read_text(spark, str(tmp_path / "t"), {"x": 4, "y": 3})
    assert plain(back.select("rec", "x", "y", "v").collect()) == plain(cells.collect())


def test_parquet_round_trip(spark, tmp_path):
    cells = spark.range(10).select((F.col("id") % 3).alias("rec"), F.col("id").alias("x"), F.when(F.col("id") != 5, F.col("id") * 1.0).alias("v"))
    files.write_parquet(cells, str(tmp_path / "p"), missing=-999.0)
    back = files.read_parquet(spark, str(tmp_path / "p"), rec=(0, 2), missing=-999.0, x=(0, 9))
    assert plain(back.select("rec", "x", "v").collect()) == plain(cells.where("rec < 2 AND x < 9").select("rec", "x", "v").collect())
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(rec" in plan


def test_stream_like_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    run = windowed(stream, keys=["event_type"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    got = spark.table("w").select("start", "event_type", "n").collect()
    assert plain(got) == plain(windowed(events, keys=["event_type"]).select("start", "event_type", "n").collect())
