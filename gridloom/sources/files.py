"""Reading and writing of fields: Parquet, and text with one value a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..field import Field

MISSING = -999.0


def with_missing(df: DataFrame, missing: float = MISSING, value: str = "v") -> DataFrame:
    """Cells that hold the number for missing ones become NULL."""
    return df.withColumn(value, F.nullif(F.col(value).cast("double"), F.lit(missing)))


def filled(df: DataFrame, missing: float = MISSING, value: str = "v") -> DataFrame:
    return df.withColumn(value, F.coalesce(value, F.lit(missing)))


def read_parquet(spark: SparkSession, path: str, rec: tuple[int, int] | None = None, missing: float | None = None, **ranges: tuple[int, int]) -> DataFrame:
    """Cells of a Parquet table; record and coordinate ranges are pushed to the scan."""
    df = spark.read.parquet(path)
    for name, (b, e) in (({"rec": rec} if rec else {}) | ranges).items():
        df = df.where((F.col(name) >= b) & (F.col(name) < e))
    return df if missing is None else with_missing(df, missing)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by_record: bool = True, missing: float | None = None) -> None:
    """One folder a record, so that a selection of records reads only those. Modes: errorifexists, overwrite, append."""
    out = df if missing is None else filled(df, missing)
    writer = out.write.mode(mode)
    (writer.partitionBy("rec") if by_record and "rec" in df.columns else writer).parquet(path)


def write_text(df: DataFrame, path: str, order: list[str], form: str | None = None, missing: float = MISSING, mode: str = "errorifexists") -> None:
    """One value a line in the order of ``order`` (given from the slowest coordinate to the fastest), as it is or in ``form``."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    value = F.coalesce(F.col("v"), F.lit(missing))
    text = F.format_string(form, value) if form else value.cast("string")
    sorted_.select(text.alias("value")).write.mode(mode).text(path)


def read_text(spark: SparkSession, path: str, shape: dict[str, int], missing: float = MISSING) -> DataFrame:
    """Values of one a line as cells: the first coordinate of ``shape`` runs fastest, and each full shape is a record.

    Lines are numbered in the order of file names, and of places in a file: counts of the splits that Spark reads give
    where each starts.
    """
    from pyspark.sql import Window

    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(F.col("value").cast("double").alias("v"), F.monotonically_increasing_id().alias("at"), *split)
    before = F.sum("count").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    starts = lines.groupBy("file", "block").agg(F.count("*").alias("count"), F.min("at").alias("first")).withColumn("before", F.coalesce(before, F.lit(0)))
    lines = lines.join(starts, ["file", "block"])
    flat = F.col("before") + F.col("at") - F.col("first")
    columns, stride = [], 1
    for name, n in shape.items():
        columns.append(F.pmod(F.floor(flat / stride), F.lit(n)).cast("long").alias(name))
        stride *= n
    return with_missing(lines.select(F.floor(flat / stride).cast("long").alias("rec"), *columns, "v"), missing)


def write_field(field: Field, path: str, mode: str = "errorifexists", by_record: bool = True) -> None:
    """A field with all that is known of it, in the metadata of its columns; missing cells as its missing value, if it has one."""
    df = field.frame()
    if field.meta.missing is not None:
        about = df.schema["v"].metadata
        df = df.withColumn("v", F.coalesce("v", F.lit(float(field.meta.missing))).alias("v", metadata=about))
    writer = df.write.mode(mode)
    (writer.partitionBy("rec") if by_record and field.has_rec else writer).parquet(path)


def read_field(spark: SparkSession, path: str, rec: tuple[int, int] | None = None, **ranges: tuple[int, int]) -> Field:
    """A field as ``write_field`` left it; record and coordinate ranges are pushed to the scan."""
    df = spark.read.parquet(path)
    field = Field.of_frame(df if rec is None else df.where((F.col("rec") >= rec[0]) & (F.col("rec") < rec[1])))
    if field.meta.missing is not None:
        field = Field(with_missing(field.df, field.meta.missing), field.coords, field.has_rec, field.kind, field.meta)
    return field.select(**ranges) if ranges else field
