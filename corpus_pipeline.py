"""A corpus pipeline of five stages, each one of the operators of gridloom.llm; each reads what the one before wrote.

Every stage takes further columns of any name, repeated rows (which stay or go together, but that one of equal texts stays
in near_duplicates), null ids, and empty tables; what it does with null and empty texts its docstring says.
A stage bounds the bytes of the batches that go to Python, for the session, unless they are set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, staged, table
from gridloom.llm.op2_decontaminate import without_contaminated
from gridloom.llm.op3_packing import pack
from gridloom.llm.op5_jaccard import one_of_each
from gridloom.llm.op8_secrets import redact
from gridloom.llm.op10_language import accepted, fit

#: Stretches of text that a worker keeps the ids of while packing, as executors have grown in the stages before: 200 bytes each.
STRETCHES = 400_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; texts that are null, empty or without a letter go, and narrow margins."""
    bounded_batches(spark)
    return accepted(docs, fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: that of the smallest id.

    Documents without words, null texts among them, are linked with nothing and stay."""
    bounded_batches(spark)
    return one_of_each(docs, n=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten consecutive words of any benchmark item; null and empty texts have none and stay."""
    bounded_batches(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars as it is then (null of a null text)."""
    bounded_batches(spark)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; null and empty texts are their end id alone."""
    bounded_batches(spark)
    return pack(docs, most_kept=STRETCHES)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: Compression sizes, tokenizers and automata can't be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
