"""Alignment of two tokenizers: which tokens of one overlap which of the other, and where both end a token."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, staged, table
from .tokens import BYTES

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids as one number: A's id times this plus B's.
FACTOR = 1 << 20
#: Bytes of text that are encoded at once, and that are one chunk for the counts of its pairs.
PIECE, CHUNK = 1 << 18, 32 << 20
#: Stretches that a worker keeps, and the longest that is kept.
MOST_KEPT, LONGEST_KEPT = 500_000, 40
#: Different pairs of the corpus up to which their counts are broadcast (16 bytes each); beyond, they are joined to chunks.
MOST_SENT = 1 << 22
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WORD_SPACE = "▁"


class IntervalIndex:
    """Tokens as intervals of bytes that follow one another, sorted as they are; stabbed by bisection."""

    def __init__(self, sizes: np.ndarray):
        self.ends = np.cumsum(sizes)

    def stab(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last token that overlap the bytes from each ``start`` to its ``end``."""
        return np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, end, "left")


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first and the last token of B that each token of A overlaps, and the ends (exclusive) of groups in A and in B.

    A group ends where no token of A or B spans the gap. Both arrays of sizes (all above 0) have the same sum.
    """
    index, end = IntervalIndex(b_sizes), np.cumsum(a_sizes)
    first, last = index.stab(end - a_sizes, end)
    cut = np.flatnonzero(index.ends[last] == end)
    return first, last, cut + 1, last[cut] + 1


class Aligner:
    """Two tokenizers: byte-level BPE of the tokenizers library (A) and a sentencepiece model (B).

    A text gets a space in front. Both tokenizers cut before a single space between characters that aren't white
    space: A's pre-tokenizer does, and no piece of B has a space behind other characters (checked; else texts are
    taken whole). So a text is aligned by stretches between such spaces, and stretches that recur are aligned once.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {chr(c): bytes([b]) for b, c in BYTES.items()}
        self.a_bytes = [b"".join(byte.get(c, c.encode()) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces_of_b = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_WORD_SPACE, " ").encode() for i, p in enumerate(pieces_of_b)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        #: Ids as they are written, before another of the same side, as the last of A and as the last of B.
        self.written = np.array([[f"{i}{mark}" for i in range(most)] for mark in ",|;"], object)
        self.by_stretch = not any(_WORD_SPACE in p.lstrip(_WORD_SPACE) for p in pieces_of_b)
        self.kept: dict[str, tuple | None] = {}

    def _aligned(self, stretches: list[str]) -> list[tuple | None]:
        """For each stretch, which has a space in front that isn't written here: n_a, n_b, n_groups, n_links, groups, keys of links.

        None for those that aren't given back. All are laid end to end, so that one index serves all of them.
        """
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]
        b_ids = self.b.encode(stretches, num_threads=1)
        right = [True] * len(stretches)
        for ids, known in ((a_ids, self.a_bytes), (b_ids, self.b_bytes)):
            if b"".join([known[i] for x in ids for i in x]) != "".join([" " + s for s in stretches]).encode():
                right = [r and b"".join([known[i] for i in x]) == (" " + s).encode() for r, x, s in zip(right, ids, stretches)]
        out: list[tuple | None] = [None] * len(stretches)
        places = [k for k, r in enumerate(right) if r]
        if not places:
            return out
        a, b = (np.fromiter((i for k in places for i in ids[k]), np.int64) for ids in (a_ids, b_ids))
        first, last, a_ends, b_ends = overlaps(self.a_sizes[a], self.b_sizes[b])
        n = last - first + 1
        link_end = np.concatenate(([0], np.cumsum(n)))
        of_a = np.repeat(np.arange(len(a)), n)
        keys = (a[of_a] * FACTOR + b[np.arange(len(of_a)) - (link_end[:-1] - first)[of_a]]).astype("<u8").tobytes()
        # A group is written as its tokens of A and then those of B, each with what follows it.
        a_group, b_group = (np.searchsorted(e, np.arange(len(x)), "right") for e, x in ((a_ends, a), (b_ends, b)))
        written = np.empty(len(a) + len(b), object)
        written[np.arange(len(a)) + np.concatenate(([0], b_ends))[a_group]] = self.written[np.isin(np.arange(len(a)), a_ends - 1) * 1, a]
        written[np.arange(len(b)) + a_ends[b_group]] = self.written[np.isin(np.arange(len(b)), b_ends - 1) * 2, b]
        written = written.tolist()
        i = j = g = 0
        group = np.searchsorted(a_ends, np.cumsum([len(a_ids[k]) for k in places]), "left").tolist()
        link = link_end.tolist()
        for k, g_last in zip(places, group):
            i_end, j_end = i + len(a_ids[k]), j + len(b_ids[k])
            out[k] = (i_end - i, j_end - j, g_last + 1 - g, link[i_end] - link[i], "".join(written[i + j : i_end + j_end])[:-1], keys[8 * link[i] : 8 * link[i_end]])
            i, j, g = i_end, j_end, g_last + 1
        return out

    def rows(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """For each text its aligned stretches; None for texts without tokens: null, empty, or not given back by both."""
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        cut = [(_CUT.split(t) if self.by_stretch else [t]) if t else [] for t in texts]
        kept = self.kept
        missing = list({s for row in cut for s in row if s not in kept})
        kept.update(zip(missing, self._aligned(missing)))
        out = []
        for row in cut:
            found = [kept[s] for s in row]
            out.append(None if not found or None in found else found)
        for s in missing:
            if len(s) > LONGEST_KEPT:
                del kept[s]
        return out


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def packed(keys: bytes | list[bytes]) -> tuple[bytes, bytes]:
    """The different keys of links, ascending, as steps from one to the next, and how often each stands, in few bytes."""
    different, n = np.unique(np.frombuffer(b"".join(keys), "<u8"), return_counts=True)
    return np.diff(different, prepend=np.uint64(0)).astype("<u8").tobytes(), n.astype("<u4").tobytes()


def unpacked(steps: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(steps, "<u8"), dtype=np.uint64).view(np.int64), np.frombuffer(n, "<u4").astype(np.int64)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, chunk long, steps binary, times binary"
DIGESTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """One row for each row of ``docs``: token, group and link counts, the groups (only if ``with_groups``) and their
    digest, and the different pairs of linked ids with how often each is linked.

    Texts that are null, empty or not given back by both tokenizers have no tokens: zeros and empty strings. ``chunk``
    numbers stretches of rows of about 32 MB of text that a task reads together.
    """
    import public_tokenizers

    paths = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)

    def run(batches):
        tool, size = aligner(*paths), 0
        chunk = TaskContext.get().partitionId() << 24
        for batch in pieces(batches, "text", PIECE):
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), tool.rows(batch.column(1).to_pylist())):
                if found is None:
                    rows.append((doc_id, 0, 0, 0, 0, "", "" if with_groups else None, chunk, b"", b""))
                    continue
                n_a, n_b, n_groups, n_links, groups, keys = zip(*found)
                text = ";".join(groups)
                rows.append((doc_id, sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(text.encode()).hexdigest(), text if with_groups else None, chunk, *packed(keys)))
            size += batch.nbytes
            if size > CHUNK:
                size, chunk = 0, chunk + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.binary(), pa.binary()])], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows (pair, n, best): how many links of the corpus hold each pair of ids, and whether no pair of its B id has more."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = zip(*(unpacked(s, t) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            different, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, np.concatenate(n), len(different)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(different), pa.array(sums)], names=["pair", "n"])

    pairs = staged(rows.where("n_links > 0").select("steps", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "alignment")
    of_b = F.pmod("pair", F.lit(FACTOR)).alias("b")
    highest = pairs.groupBy(of_b).agg(F.max("n").alias("highest"))  # as many rows as B has ids
    return pairs.withColumn("b", of_b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _scored(keys: np.ndarray, times: np.ndarray, pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[int, int]:
    at = np.searchsorted(pair, keys)
    return int(times[best[at]].sum()), int((times * n[at]).sum())


def _score_batch(batch: pa.RecordBatch, known: tuple) -> pa.RecordBatch:
    cols = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
    scores = [_scored(*unpacked(s, t), *known) if s else (0, 0) for s, t in zip(cols["steps"].to_pylist(), cols["times"].to_pylist())]
    n_best, total = zip(*scores) if scores else ((), ())
    return pa.RecordBatch.from_arrays([*(cols[c] for c in DIGESTS), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), cols["groups_sha256"]], names=[*DIGESTS, "n_best", "count_sum", "groups_sha256"])


SCORED = ", ".join(f"{c} long" for c in [*DIGESTS, "n_best", "count_sum"]) + ", groups_sha256 string"


def scored(rows: DataFrame, pairs: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of ``aligned`` with n_best and count_sum, from the counts of all pairs.

    Up to ``most_sent`` different pairs, all counts are broadcast. Beyond, each chunk of rows asks for its own
    different pairs, and the answers come to the chunk, so neither a row nor a task ever holds the counts of all.
    """
    spark = rows.sparkSession
    if pairs.count() <= most_sent:
        at = pairs.toArrow()
        pair = at["pair"].to_numpy()
        order = np.argsort(pair)
        known = spark.sparkContext.broadcast((pair[order], at["n"].to_numpy()[order], np.asarray(at["best"].to_numpy(zero_copy_only=False), bool)[order]))

        def run(batches):
            for batch in batches:
                yield _score_batch(batch, known.value)

        return rows.mapInArrow(run, SCORED)

    def ask(batches):
        for batch in batches:
            chunk = np.asarray(batch.column(0))
            for c in np.unique(chunk):
                keys = [unpacked(s, t)[0] for s, t in zip(batch.column(1).filter(pa.array(chunk == c)).to_pylist(), batch.column(2).filter(pa.array(chunk == c)).to_pylist())]
                different = np.unique(np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(different), c)), pa.array(different)], names=["chunk", "pair"])

    def answer(left, right):
        pair, n, best = (right.column(c).combine_chunks() for c in ("pair", "n", "best"))
        order = np.argsort(np.asarray(pair))
        known = np.asarray(pair)[order], np.asarray(n)[order], np.asarray(best.to_numpy(zero_copy_only=False), bool)[order]
        return pa.Table.from_batches([_score_batch(b, known) for b in left.to_batches()])

    linked = rows.where("n_links > 0")
    asked = linked.select("chunk", "steps", "times").mapInArrow(ask, "chunk long, pair long").distinct().join(pairs, "pair")
    answered = linked.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(answer, SCORED)
    return answered.union(rows.where("n_links = 0").select(*DIGESTS, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """Rows doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one for each row of ``docs``.

    Documents without tokens (null, empty, not given back) have zeros and an empty digest; repeated rows count each in
    the corpus-wide counts; an empty table gives no row. Further columns are ignored.
    """
    rows = staged(aligned(docs, id_col, text_col, a_path, b_path), "alignment")
    return scored(rows, staged(pair_counts(rows), "alignment"), most_sent)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
