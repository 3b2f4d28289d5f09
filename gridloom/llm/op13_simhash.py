"""SimHash near-duplicates: fingerprints of word shingles, linked through an inverted index of their positional bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, pieces, staged, table
from .components import components

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16
#: A fingerprint has eight positional bytes, taken in pairs by the index: a term is two of the four pairs with their bytes.
PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
MOST_BITS = 2
#: A posting list of more fingerprints is split by two more positional bytes; such a list has 65,536 at most.
LONG_LIST = 4096
#: Stands for an id that is null, so that it is the smallest of nothing.
NO_ID = (1 << 63) - 1


def fingerprint(text: str | None, n: int = 3) -> int:
    """Each bit is that of more than half of the shingles' XXH64; fewer words than ``n`` are one shingle, without words it is 0."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    size = min(n, len(words))
    start, end = start[: len(words) - size + 1].tolist(), end[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(start), AT_ONCE):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[k : k + AT_ONCE], end[k : k + AT_ONCE])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """Rows (doc_id, fp): one for each row of ``docs``, ``fp`` being the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in pieces(batches, "text"):
            found = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def spanning_links(fp: np.ndarray, shared: int, bits: int) -> list[tuple[int, int]]:
    """Links between places of ``fp`` that join what fingerprints of one posting list join, each place reached once.

    All of the list agree in ``shared`` bytes at least. The bytes that a reached fingerprint has in common with each
    one not yet reached are tallied; those with 8 - ``bits`` or more are verified by their differing bits.
    """
    by_byte = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
    left, out = np.arange(1, len(fp)), []
    todo = [0] if len(fp) else []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        i = todo.pop()
        if shared < 8 - bits:
            tally = (by_byte[left] == by_byte[i]).sum(axis=1)
            met = left[tally >= 8 - bits]
        else:
            met = left
        met = met[np.bitwise_count(fp[met] ^ fp[i]) <= bits]
        if len(met):
            out += [(i, int(j)) for j in met]
            todo += met.tolist()
            left = np.setdiff1d(left, met, assume_unique=True)
    return out


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by their first one, ``term``, term by term."""
    kept = None
    for batch in batches:
        new = [np.asarray(c) for c in batch.columns]
        kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
        edge = [0, *(np.flatnonzero(kept[0][1:] != kept[0][:-1]) + 1).tolist()]
        for a, b in zip(edge, edge[1:]):
            yield [c[a:b] for c in kept]
        kept = [c[edge[-1] :] for c in kept]
    if kept is not None and len(kept[0]):
        yield kept


def _index(prints: DataFrame, long_list: int) -> DataFrame:
    """Rows (term, shared, fp, first): the inverted index of ``prints`` (fp, first), without the lists of one fingerprint.

    Who differs in two bits at most has six of eight positional bytes in common, so two of four pairs of them at least.
    A list over ``long_list`` is split by two of the four other bytes; by the same reckoning no pair is lost.
    """
    pair = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    both = lambda i, j: pair[i] * 65536 + pair[j]
    terms = F.array(*(F.struct(both(*p).alias("value"), both(*(i for i in range(4) if i not in p)).alias("rest")) for p in PAIRS))
    rows = prints.select("fp", "first", F.posexplode(terms).alias("which", "t")).select("fp", "first", "which", "t.*")
    rows = rows.withColumn("term", F.col("which").cast("long") * (1 << 48) + F.col("value"))
    rows = rows.join(rows.groupBy("term").agg(F.count("*").alias("n")).where("n > 1"), "term")
    byte = [F.shiftrightunsigned("rest", 8 * i).bitwiseAND(0xFF) for i in range(4)]
    longer = F.array(*(F.col("which").cast("long") * 6 + k for k in range(6))), F.array(*(byte[i] * 256 + byte[j] for i, j in PAIRS))
    split = rows.where(F.col("n") > long_list).select("fp", "first", "value", F.explode(F.arrays_zip(longer[0].alias("w"), longer[1].alias("v"))).alias("z"))
    split = split.select((F.col("z.w") * (1 << 48) + F.col("value") * 65536 + F.col("z.v") + (1 << 61)).alias("term"), F.lit(6).alias("shared"), "fp", "first")
    return rows.where(F.col("n") <= long_list).select("term", F.lit(4).alias("shared"), "fp", "first").union(split)


def _links(prints: DataFrame, bits: int, long_list: int) -> DataFrame:
    """Links (a, b) of fingerprints as structs (first, fp), enough to join what is linked."""

    def run(batches):
        for _, shared, fp, first in posting_lists(batches):
            if len(fp) > 1:
                links = spanning_links(fp.view(np.uint64), int(shared[0]), bits)
                if links:
                    i, j = np.array(links).T
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (first[i], fp[i], first[j], fp[j])], names=["a0", "a1", "b0", "b1"])

    dealt = _index(prints, long_list).repartition("term").sortWithinPartitions("term")
    found = dealt.mapInArrow(run, "a0 long, a1 long, b0 long, b1 long")
    node = lambda x: F.struct(F.col(f"{x}0").alias("first"), F.col(f"{x}1").alias("fp")).alias(x)
    return found.select(node("a"), node("b"))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, bits: int = MOST_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """Rows (doc_id, fp, component_id): texts whose fingerprints differ in ``bits`` bits at most are linked.

    ``component_id`` is the smallest id reachable. Each row of ``docs`` gives one row, repeated rows too; null, empty
    and wordless texts have fingerprint 0 and are linked like any others; a null id is never a component's id unless
    the component has no other. Further columns are ignored.

    Equal fingerprints are one from the start, so the index holds different ones only: a term's list is what fits a
    bounded buffer (65,536 fingerprints at most), and copies, however many, cost one entry.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be 0 to {MOST_BITS}")
    each = staged(fingerprints(docs, id_col, text_col, n), "simhash")
    prints = staged(each.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first"), F.count("*").alias("n")), "simhash")
    if bits:
        joined = components(_links(prints, bits, long_list)).select(F.col("node.fp").alias("fp"), F.col("component.first").alias("linked"))
        prints = prints.join(joined, "fp", "left").select("fp", F.coalesce("linked", "first").alias("least"), (F.col("linked").isNotNull() | (F.col("n") > 1)).alias("joint"))
    else:
        prints = prints.select("fp", F.col("first").alias("least"), (F.col("n") > 1).alias("joint"))
    wanted = staged(prints.where("joint").select("fp", "least"), "simhash")  # what is alone is its own component
    found = each.join(wanted, "fp", "left")
    return found.select("doc_id", "fp", F.coalesce(F.nullif("least", F.lit(NO_ID)), "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component; all columns stay."""
    name = fresh(docs, "component_id")
    found = simhash(docs, id_col, text_col, n, bits).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    quoted = "`" + id_col.replace("`", "``") + "`"
    return docs.join(found, F.col(quoted).cast("long") == F.col(name), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
