"""What the operators share: tables, the shared folder, staged tables, byte helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a query are removed when it ends; rows that go to Python at once.
WHILE_STAGED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}
#: Bytes of the rows that go to a Python worker, and come back, at once, one row at least.
BATCH_BYTES = 8 << 20
#: Of what a Python worker keeps from task to task, and so from stage to stage: functions that forget it.
FORGET: list[Callable[[], None]] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; a new local one only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, is computed once and outlives executors.

    Spark removes the shuffle files of the write when the write is done. Arrow batches are kept small.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in WHILE_STAGED}
    for k, v in WHILE_STAGED.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have about ``BATCH_BYTES``, so memory doesn't grow with the length of texts.

    Spark reads the setting when a plan runs, so it can't be part of a DataFrame that others write. One that is set stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unburdened(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, in a worker that first forgets what other stages keep there, and gives freed memory back in the end.

    Spark hands the same workers on from stage to stage, so what they keep would add up over a pipeline.
    """

    def task(batches):
        for forget in FORGET:
            forget()
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    """Freed memory of this process goes back to the system: that of Arrow, and that of the C library."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def kept(docs: DataFrame, text_col: str, keep: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are, whatever they are called.

    ``keep`` is called once in a task and gives a function from texts to what is kept.
    """
    at, plain = docs.columns.index(text_col), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        judge = keep()
        for batch in pieces(batches, f"c{at}"):
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(unburdened(run), plain.schema).toDF(*docs.columns)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        size = np.cumsum([0] + [x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
