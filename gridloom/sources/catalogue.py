"""Fields of many groups and variables in one place: a catalogue of their records and times, and reading by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import nearest

KEYS = ["grp", "var"]


def catalogue(cells: DataFrame) -> DataFrame:
    """Rows (grp, var, rec, time, n_cells, n_missing): one for each record of each variable of each group.

    ``cells`` has grp, var, rec, time and v; the time of a record is the first that its cells have.
    """
    return cells.groupBy(*KEYS, "rec").agg(F.min("time").alias("time"), F.count("*").alias("n_cells"), F.count_if(F.col("v").isNull()).alias("n_missing"))


def write_records(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The cells by group, variable and record in ``path/cells``, and their catalogue in ``path/catalogue``."""
    cells.write.mode(mode).partitionBy(*KEYS, "rec").parquet(f"{path}/cells")
    stored = cells.sparkSession.read.schema(cells.schema).parquet(f"{path}/cells")
    catalogue(stored).write.mode(mode).parquet(f"{path}/catalogue")


def groups(known: DataFrame) -> DataFrame:
    """(grp, var, n_records, first_time, last_time) of a catalogue."""
    return known.groupBy(*KEYS).agg(F.count("*").alias("n_records"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def record_at(known: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (grp, var, time, ...) with ``rec``: the last record of the variable at or before the time; NULL if none."""
    return nearest(known, asked, KEYS, "time", F.col("rec"), "rec")


def record_within(known: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (grp, var, low, high, ...) with ``rec``: the first record whose time is in [low, high); NULL if none."""
    found = nearest(known, asked.withColumn("time", F.col("low")), KEYS, "time", F.struct("rec", "time"), "__found", later=True)
    return found.withColumn("rec", F.when(F.col("__found.time") < F.col("high"), F.col("__found.rec"))).drop("__found", "time")


def read_at(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The cells of the records that ``record_at`` finds for ``asked``, each with the time that was asked for.

    Records are folders of the table, so what the catalogue finds prunes the files that are read.
    """
    found = record_at(spark.read.parquet(f"{path}/catalogue"), asked).where(F.col("rec").isNotNull())
    return spark.read.parquet(f"{path}/cells").drop("time").join(found, [*KEYS, "rec"])


def read_variable(spark: SparkSession, path: str, grp: str, var: str, records: tuple[int, int] | None = None) -> DataFrame:
    """Cells of one variable, of records [begin, end) if given: only their folders are listed and read."""
    df = spark.read.parquet(f"{path}/cells").where((F.col("grp") == grp) & (F.col("var") == var))
    return df if records is None else df.where((F.col("rec") >= records[0]) & (F.col("rec") < records[1]))
