"""Audit of how filters interact: what each removes in any order, and its Shapley value from a multilinear extension."""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, staged, table

WORD_GAP = r"[\x20\x09-\x0D]+"
#: The letter of the filter that looks for copies in the whole table.
COPIES = "E"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
OUT_ARROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])


def conditions(text: Column) -> dict[str, Column]:
    """When a text fails: few words, repeated words, capitals, markup."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": (F.length(text) - F.length(F.translate(text, UPPER, ""))) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


class Removal:
    """The polynomial of one part: how many documents the filters remove, filter i being on with a share x[i].

    A document that fails the set m is removed with 1 - prod(1 - x[i] for i in m), so the coefficient of the product of
    T is the count of those that fail all of T, with the sign of an odd T.
    """

    def __init__(self, counts: list[int], n: int):
        self.n = n
        self.size = [bin(t).count("1") for t in range(1 << n)]
        self.coefficient = [0] + [(1 if self.size[t] % 2 else -1) * sum(c for m, c in enumerate(counts) if m & t == t) for t in range(1, 1 << n)]

    def corner(self, on: int) -> int:
        """Its value where the filters of ``on`` are on and the others off: the documents removed."""
        return sum(c for t, c in enumerate(self.coefficient) if t & on == t)

    def shapley(self, i: int) -> Fraction:
        """The integral from 0 to 1 of the derivative by x[i] along the diagonal."""
        by_degree = [0] * self.n
        for t, c in enumerate(self.coefficient):
            if t >> i & 1:
                by_degree[self.size[t] - 1] += c
        return sum((Fraction(c, k + 1) for k, c in enumerate(by_degree)), Fraction(0))


def audited(part: str, names: str, masks: list[dict]) -> list[tuple]:
    """The rows of one part from its counts by mask (fails, n, good, toxic)."""
    n = len(names)
    counts = {c: [0] * (1 << n) for c in ("n", "good", "toxic")}
    for m in masks:
        for c, held in counts.items():
            held[m["fails"]] += m[c]
    polynomial = {c: Removal(held, n) for c, held in counts.items()}
    removed = {c: [p.corner(s) for s in range(1 << n)] for c, p in polynomial.items()}
    total, everything = sum(counts["n"]), (1 << n) - 1
    value = [polynomial["n"].shapley(i) * factorial(n) for i in range(n)]
    out = []
    for order in permutations(range(n)):
        before, called = 0, "".join(names[i] for i in order)
        for step, i in enumerate(order, 1):
            now = before | 1 << i
            here = {c: r[now] - r[before] for c, r in removed.items()}
            unique = removed["n"][everything] - removed["n"][everything ^ 1 << i]
            out.append((part, called, step, total - removed["n"][now], here["n"], removed["n"][1 << i] - here["n"], unique, here["good"], here["toxic"], int(value[i])))
            before = now
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict[str, Column] | None = None, copies: str | None = COPIES) -> DataFrame:
    """Rows (part, filter_order, step, ...) for each part, each order of the filters and each step of it.

    ``filters`` has conditions over the columns of ``docs`` under which a row fails, by one-letter names (default:
    ``conditions``); a null condition counts as false. ``copies`` names one more filter, which a row fails if a smaller
    id has the same text anywhere in the table. Null texts are empty, null parts the empty string; a row without id is no copy and has no
    label. Repeated rows count each, labels that repeat count as 1 where any of them is 1, an empty table has no parts.

    Texts go no further than the scan: what is shuffled is a digest, an id and a set of failed filters for each row.
    Hot parts and hot texts are counted before they are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), *(c.alias(f"fails_{k}") for k, c in (filters or {}).items()))
    failing = {k: F.col(f"fails_{k}") for k in filters} if filters is not None else conditions(text)
    names = "".join(failing) + (copies or "")
    fails = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failing.values())), F.lit(0))
    rows = named.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), fails.alias("fails"))
    rows = staged(rows.groupBy("digest", "doc_id", "part", "fails").agg(F.count("*").alias("n")), "audit")
    if copies:
        first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        rows = rows.join(first, ["digest", "doc_id"], "left")
        rows = rows.withColumn("fails", F.col("fails") + F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << len(failing)).otherwise(0))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("long").alias(c)
    known = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    rows = rows.join(known, "doc_id", "left")
    masks = rows.groupBy("part", "fails").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("quality")), F.lit(0)).alias("good"), F.coalesce(F.sum(F.col("n") * F.col("toxic")), F.lit(0)).alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("masks"))  # 2 to the power of the filters at most

    def run(batches):
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*audited(part, names, found)), OUT_ARROW)], schema=OUT_ARROW)

    return parts.mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
    SELECT t, min(doc_id) AS first FROM d GROUP BY t
), failed AS (
    SELECT part, doc_id,
        CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS fails
    FROM d JOIN firsts USING (t)
), known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, fails
), letters AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
    SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0) AS before FROM orders, unnest(generate_series(1, 5)) t(s)
), counted AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN (fails & (before + bit)::INT) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN (fails & before::INT) = 0 AND (fails & bit) <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN (fails & before::INT) <> 0 AND (fails & bit) <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN (fails & before::INT) = 0 AND (fails & bit) <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN (fails & before::INT) = 0 AND (fails & bit) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
