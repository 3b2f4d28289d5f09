"""Token files: an independent zstandard frame for each document, checksums, and a seek table at the end.

Layout of a file (little endian):

* for each document a zstandard frame with its content checksum; content: the ids, 2 bytes each if the vocabulary
  allows it, else 4;
* a skippable frame (magic 0x184D2A50) with ``GLTK``, a version byte, the bytes of an id, 6 bytes of zero, the number
  of documents (8 bytes) and the document ids (8 bytes each, null as -2**63);
* the seek table, a skippable frame (magic 0x184D2A5E): for each frame above its compressed size, its size and the
  low 32 bits of the XXH64 of its content, as the frame itself ends in (4 bytes each; size and checksum 0 for the
  skippable frame), then the
  number of frames (4 bytes), a byte 0x80 (checksums are there) and 0x8F92EAB1.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, pieces, staged, table
from .tokens import PIECE, default_path, encoder

SKIPPABLE, TABLE, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)
LEVEL = 1
MANIFEST = "part long, file string, n_docs long, n_ids long"
MANIFEST_ARROW = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class TokenFileWriter:
    """Writes frames as they come; what it keeps is 20 bytes a document."""

    def __init__(self, out, width: int):
        self.out, self.width, self.ids, self.entries = out, width, [], []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.zstd.compress(ids.astype(f"<u{self.width}"))
        self.out.write(frame)
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.entries.append((len(frame), len(ids) * self.width, int.from_bytes(frame[-4:], "little")))

    def close(self) -> None:
        body = b"GLTK" + bytes([1, self.width]) + bytes(6) + struct.pack("<Q", len(self.ids)) + np.array(self.ids, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        entries = np.array([*self.entries, (len(body) + 8, 0, 0)], "<u4").tobytes()
        self.out.write(struct.pack("<II", TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.ids) + 1, 0x80, FOOTER))
        self.out.close()


class TokenFile:
    """Reads the seek table and the document ids of a file, and then only the frames asked for."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER or flags != 0x80:
            raise ValueError(f"{uri} has no seek table")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        body = self._at(int(self.offset[n - 1]) + 8, int(self.table[n - 1, 0]) - 8)
        if body[:4] != b"GLTK":
            raise ValueError(f"{uri} has no document ids")
        self.width = body[5]
        self.doc_ids = np.frombuffer(body[20:], "<i8")
        self.sizes = self.table[: n - 1, 1] // self.width
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def ids(self, frame: int) -> np.ndarray:
        held = self._at(int(self.offset[frame]), int(self.table[frame, 0]))
        raw = self.zstd.decompress(held)  # checks the checksum that the frame ends in
        if len(raw) != self.table[frame, 1] or int.from_bytes(held[-4:], "little") != self.table[frame, 2]:
            raise ValueError(f"frame {frame} is damaged")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, ids before it in this file, ids) of the documents ``wanted``, or of all."""
        starts = np.concatenate(([0], np.cumsum(self.sizes)))
        frames = range(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)))
        for k in frames:
            yield None if self.doc_ids[k] == NULL_ID else int(self.doc_ids[k]), int(starts[k]), self.ids(k)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Tokenize each whole text, append ``end_id`` and write token files into ``folder``, in ascending order of the id.

    Null ids come first, null texts count as empty; rows with one id stand in the order of their texts; without rows
    there are no files. Returns the manifest (part, file, n_docs, n_ids, start), start being the number of ids in all
    parts before. A file gets its name when it is complete, so an attempt that is lost leaves nothing that is read.
    """
    path = tokenizer or default_path()

    def run(batches):
        codes, out, docs_in, ids_in = encoder(path), None, 0, 0
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.zst"
        fs, target = pafs.FileSystem.from_uri(name)
        for batch in pieces(batches, "text", PIECE):
            for d, raw in zip(batch.column(0).to_pylist(), codes.ids(batch.column(1).to_pylist())):
                if out is None:
                    fs.create_dir(target.rpartition("/")[0], recursive=True)
                    out = TokenFileWriter(fs.open_output_stream(target + ".part"), 2 if max(codes.vocabulary, end_id + 1) <= 1 << 16 else 4)
                ids = np.frombuffer(raw + end, "<u4")
                out.add(d, ids)
                docs_in, ids_in = docs_in + 1, ids_in + len(ids)
        if out is not None:
            out.close()
            fs.move(target + ".part", target)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, docs_in, ids_in)], schema=MANIFEST_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    manifest = staged(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST), "tokens-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 from the files of ``manifest``, each read by one task."""

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(d, start + at, len(ids), zlib.crc32(ids.tobytes())) for d, at, ids in TokenFile(file).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=OUT_ARROW)

    files = manifest.select("file", "start")
    return files.repartition(max(1, files.count())).mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    return read_tokens(manifest)
