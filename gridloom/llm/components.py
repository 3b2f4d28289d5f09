"""Connected components of links: forests within tasks, then alternating star contractions; links never leave the executors."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import staged, unburdened

#: Links that one task joins on its own, about; with more, several tasks do, and rounds join what these leave.
AT_ONCE = 1 << 18


def _forests(edges: DataFrame, tasks: int) -> DataFrame:
    """The links as far as ``tasks`` tasks join them: each node points to the least that the links of its task lead to."""

    def run(batches):
        root: dict[int, int] = {}

        def least(x: int) -> int:
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = sorted((least(a), least(b)))
                if x != y:
                    root[y] = x
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array([least(x) for x in root], pa.int64())], names=["a", "b"])

    return edges.coalesce(tasks).mapInArrow(unburdened(run), "a long, b long")


def _star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, and the node, point to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "links")  # so that the join can be split where skewed
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of those; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``links`` (a, b) but the smallest of each component, which is ``component``.

    Null ends and loops are dropped. Links of long nodes are first joined within tasks of ``AT_ONCE`` links; one task's are
    joined for good. Otherwise rounds follow, each staged, as many as grow with the logarithm of the longest path.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "links")
    digest = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    last = digest(edges)
    if last[0] and isinstance(edges.schema["a"].dataType, LongType):
        tasks = math.ceil(last[0] / AT_ONCE)
        edges = staged(_forests(edges, tasks), "links")
        last = digest(edges) if tasks > 1 else (0, None)
    while last[0]:
        edges = staged(_small_star(_star(edges)).distinct(), "links")
        now = digest(edges)
        if now == last:
            break
        last = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
