"""Sum-of-squares online packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, pieces, table
from .tokens import MOST_KEPT, PIECE, default_path, encoder

LENGTH = 1024
#: Windows that a task keeps open at most; beyond, those open are filled by cutting, so memory stays bounded.
MOST_OPEN = 4096
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
OUT = ", ".join(f"{f} long" for f in FIELDS)
OUT_ARROW = pa.schema([(f, pa.int64()) for f in FIELDS])
#: Sequence ids of one task; a task's ids start at its partition's number times this.
IDS_A_TASK = 1 << 36


class Packer:
    """Windows of ``length`` tokens, open ones by fill level; ``count`` has how many are at each level.

    A piece that fills no window by itself goes to the level for which the sum of the squared counts becomes
    smallest, a new window being level 0 and a full one no level; of equal ones, the fullest.
    """

    def __init__(self, length: int = LENGTH, most_open: int = MOST_OPEN, first_id: int = 0):
        self.length, self.most_open, self.next_id = length, most_open, first_id
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(length + 1)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """Placing in level h takes one from count[h] and adds one to count[h + size]: the change of the sum of squares."""
        last = self.length - size
        change = 2 * self.count[size : self.length + 1] + 1
        change[last] = 0
        change[1:] += 1 - 2 * self.count[1 : last + 1]
        change[1:][self.count[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        """The pieces of windows that this document makes full."""
        total = len(ids) // 4
        out: list[tuple] = []
        whole = total - total % self.length
        for at in range(0, whole, self.length):
            out += self.closed([(doc_id, at, self.length, ids[4 * at : 4 * (at + self.length)], total)])
        if size := total - whole:
            piece = (doc_id, whole, size, ids[4 * whole :], total)
            level = self.level_for(size)
            window = self.open[level].pop() if level else []
            window.append(piece)
            if level:
                self.count[level] -= 1
                self.n_open -= 1
            if level + size == self.length:
                out += self.closed(window)
            else:
                self.open[level + size].append(window)
                self.count[level + size] += 1
                self.n_open += 1
                if self.n_open > self.most_open:
                    out += self.drain()
        return out

    def closed(self, window: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, size, ids, total in window:
            out.append((doc_id, start, size, zlib.crc32(ids), total, self.next_id, offset))
            offset += size
        self.next_id += 1
        return out

    def drain(self) -> list[tuple]:
        """Close all open windows: the emptiest are taken apart and cut to fill the fullest; one at most stays short."""
        windows = [w for level in self.open for w in level]  # by fill, ascending
        fill = [sum(p[2] for p in w) for w in windows]
        self.open, self.n_open = [[] for _ in range(self.length + 1)], 0
        self.count[:] = 0
        out, low, high = [], 0, len(windows) - 1
        while low < high:
            need = self.length - fill[high]
            doc_id, start, size, ids, total = windows[low].pop()
            take = min(need, size)
            windows[high].append((doc_id, start + size - take, take, ids[4 * (size - take) :], total))
            if take < size:
                windows[low].append((doc_id, start, size - take, ids[: 4 * (size - take)], total))
            fill[high] += take
            fill[low] -= take
            if fill[high] == self.length:
                out += self.closed(windows[high])
                high -= 1
            if low <= high and not windows[low]:
                low += 1
        for w in windows[low : high + 1]:
            if w:
                out += self.closed(w)
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, length: int = LENGTH, most_open: int = MOST_OPEN, most_kept: int = MOST_KEPT) -> DataFrame:
    """Rows doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one for each piece of a document.

    Each row of ``docs`` is tokenized whole and gets ``end_id`` at its end (so null and empty texts are that one id);
    repeated rows and ids are packed as they come. What fills a window goes out at once; the rest of each document is
    placed by the sum-of-squares rule. Each task packs what it reads as a stream, so no shuffle is needed and tasks
    can be lost and repeated; it leaves one sequence at most that isn't full. Ids lie in exactly one piece each. A worker keeps the ids of ``most_kept``
    stretches of text, about, which changes speed and memory only.
    """
    path = tokenizer or default_path()

    def run(batches):
        codes = encoder(path, most_kept)
        packer = Packer(length, most_open, TaskContext.get().partitionId() * IDS_A_TASK)
        end = np.array([end_id], "<u4").tobytes()

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=OUT_ARROW)

        for batch in pieces(batches, "text", PIECE):
            rows = [p for d, ids in zip(batch.column(0).to_pylist(), codes.ids(batch.column(1).to_pylist())) for p in packer.add(d, ids + end)]
            if rows:
                yield made(rows)
        if rows := packer.drain():
            yield made(rows)
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
