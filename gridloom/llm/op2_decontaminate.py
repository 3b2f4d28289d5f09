"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, each text read once."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, pieces, runs, table

#: Maps each UTF-8 byte: A-Z to a-z, ASCII other than 0-9 and a-z to a space. Lengths stay, so offsets do too.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 122 and c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of item text that one automaton holds, and that are broadcast at once; more items make more automata.
BLOCK_BYTES = 4 << 20
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: long, end: long>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


_built: dict[str, tuple] = {}


def automaton(items: list[tuple[str | None, str | None]], window: int, key: str):
    """(automaton, for each pattern its item ids and number of words); kept in the worker."""
    if key not in _built:
        found: dict[str, tuple[set, int]] = {}
        for item, text in items:
            if item is not None and (w := words(text)):
                size = min(window, len(w))
                for i in range(len(w) - size + 1):
                    found.setdefault((b" " + b" ".join(w[i : i + size]) + b" ").decode("latin-1"), (set(), size))[0].add(item)
        machine = ahocorasick.Automaton()
        for i, pattern in enumerate(found):
            machine.add_word(pattern, i)
        if found:
            machine.make_automaton()
        _built.clear()
        _built[key] = (machine if found else None, [len(p) for p in found], list(found.values()))
    return _built[key]


def scan(text: str | None, built) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, the word ranges of all window occurrences (last word included), and the items they are of."""
    machine, lengths, patterns = built
    w = words(text)
    if not w or machine is None:
        return len(w), [], set()
    joined = b" " + b" ".join(w) + b" "
    ends = list(machine.iter(joined.decode("latin-1")))
    if not ends:
        return len(w), [], set()
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    first = np.searchsorted(spaces, [e + 1 - lengths[p] for e, p in ends])
    size = np.array([patterns[p][1] for _, p in ends])
    items: set[str] = set().union(*(patterns[p][0] for p in {p for _, p in ends}))
    hit = np.zeros(len(w) + 1, np.int64)
    np.add.at(hit, first, 1)
    np.add.at(hit, first + size, -1)
    at, end = runs(np.cumsum(hit[:-1]) > 0)
    return len(w), [(int(a), int(b) - 1) for a, b in zip(at, end)], items


def original_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point offsets of the original text, end exclusive."""
    raw = text.encode()
    at, end = runs(np.frombuffer(raw.translate(TO_WORDS), np.uint8) != 32)
    point = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(point[at[a]]), int(point[end[b]])) for a, b in ranges]


def finished(doc_id, text, n, ranges, items) -> tuple:
    """A row of the result, from the ranges of one block or of all blocks together."""
    hit = np.zeros(n + 1, np.int64)
    for a, b in ranges:
        hit[a] += 1
        hit[b + 1] -= 1
    at, end = runs(np.cumsum(hit[:-1]) > 0)
    merged = [(int(a), int(b) - 1) for a, b in zip(at, end)]
    names = sorted(set(items))
    spans = [{"start": a, "end": b} for a, b in original_offsets(text, merged)] if merged else []
    return doc_id, n, int((end - at).sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(merged), names, spans


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _finder(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int):
    """A function for the executors: of each text the number of words, word ranges and items, from all blocks of items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("words"))
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = int(size // block_bytes) + 1
    blocks = []
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == b).distinct().collect()
        blocks.append((f"{b}/{hash(tuple(sorted(map(str, rows))))}/{window}", spark.sparkContext.broadcast([tuple(r) for r in rows])))

    def find(texts: list[str | None]) -> list[tuple[int, list, set]]:
        found = [(0, [], set())] * len(texts)
        for key, block in blocks:
            built = automaton(block.value, window, key)
            for i, text in enumerate(texts):
                n, ranges, names = scan(text, built)
                found[i] = (n, found[i][1] + ranges, found[i][2] | names)
        return found

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark the words of each document that lie inside any ``window`` consecutive words of a benchmark item.

    Rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, and spans: the hit runs as code-point
    offsets of the text as it was. Null and empty texts have no words; items without words or id match nothing; items
    that repeat count once by id. Each row of ``docs`` gives one row, repeated ids and null ids too.

    The items are dealt into blocks of at most about ``block_bytes``, a block being what is broadcast and built into
    one automaton. All blocks are carried through the same scan, so a text is read and normalised once; blocks are
    rebuilt in turn by a worker, for each batch of documents, if there are several.
    """
    find = _finder(benchmark, item_col, item_text_col, window, block_bytes)

    def run(batches):
        for batch in pieces(batches, "text"):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield _batch([finished(d, t, *f) for d, t, f in zip(ids, texts, find(texts))], OUT_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no window of a benchmark item occurs."""
    find = _finder(benchmark, item_col, item_text_col, window, block_bytes)
    return kept(docs, text_col, lambda: lambda texts: [not ranges for _, ranges, _ in find(texts)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
    FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) t(k) WHERE len(w) > 0
), docs AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), places AS (
    SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS s
    FROM docs, (SELECT DISTINCT size FROM windows), unnest(generate_series(1, len(w) - size + 1)) t(k)
), met AS (
    SELECT doc_id, k, size, item FROM places JOIN windows USING (size, s)
), hits AS (
    SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM (SELECT DISTINCT doc_id, k, size FROM met), unnest(generate_series(0, size - 1)) t(o) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM met GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
