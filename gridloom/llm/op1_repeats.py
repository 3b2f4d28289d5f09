"""Removal of long repeated strings by a run-length index: run-compressed BWT, sampled run ends, matching statistics."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, runs, staged, table
from .rlindex import RunLengthIndex
from .shingles import mix

#: Bytes hashed together to find which stretches can hold repeats; a repeat of ``length`` bytes holds many such.
GRAM = 32
#: Windows that one stretch has at most, and bytes of text hashed at once.
STRETCH, PIECE = 1024, 1 << 20
#: Bytes of stretches in one index, as counted before equal ones of different batches meet. Where one hash alone has
#: more, its windows are dealt one by one instead, by a hash of all their bytes.
MOST_BYTES = 2 << 20
NULL_ID = -(1 << 63)

ANCHOR = np.dtype([("h", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("n", "<u2"), ("known", "u1"), ("more", "<u4")])
PLACE = np.dtype([("h", "<u8"), ("start", "<u4"), ("n", "<u2")])
SEGMENT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("size", "<u4")])
WINDOW = np.dtype([("h", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4")])
MARK = np.dtype([("start", "<u4"), ("end", "<u4")])

BLOB = "bucket int, payload binary, doc_id long, tag long, places binary"
BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("places", pa.binary())])
BY_DOC = "doc_id long, tag long, places binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _blob_rows(bucket, payload) -> pa.RecordBatch:
    k = len(payload)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(payload, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], schema=BLOB_ARROW)


def _by_doc(doc: np.ndarray, tag: np.ndarray, body: np.ndarray) -> tuple[list, list, list]:
    """``body`` in one piece of bytes for each (doc, tag)."""
    order = np.lexsort((tag, doc))
    doc, tag, body = doc[order], tag[order], body[order]
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))) if len(doc) else np.zeros(0, np.int64)
    return doc[cut].tolist(), tag[cut].astype(np.int64).tolist(), [x.tobytes() for x in np.split(body, cut[1:])] if len(cut) else []


def _doc_rows(doc, tag, body, buckets: int) -> pa.RecordBatch:
    """What is already known of documents goes along with the payloads of any bucket, dealt by document."""
    d, t, p = _by_doc(doc, tag, body)
    return pa.RecordBatch.from_arrays([pa.array([x % buckets for x in d], pa.int32()), pa.nulls(len(d), pa.binary()), pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(p, pa.binary())], schema=BLOB_ARROW)


def _known(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(batch.column("payload").is_null()).select(["doc_id", "tag", "places"])


def _doc_only(doc, tag, body) -> pa.RecordBatch:
    d, t, p = _by_doc(doc, tag, body)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(p, pa.binary())], names=["doc_id", "tag", "places"])


def _over(x: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``size`` neighbours."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def _hashes(raw: bytes, size: int, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    with np.errstate(over="ignore"):
        h, have = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), 1
        while have < size:  # of twice the bytes, or of what is still wanting, by laying two over each other
            step = min(have, size - have)
            left = h[: len(h) - step] * np.uint64(by)
            left ^= left >> np.uint64(29)
            left += h[step:] * np.uint64(0xBF58476D1CE4E5B9)
            h, have = left, have + step
        return mix(h)


def stretches(raws: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Cut the windows of ``length`` bytes of each text into runs of equal smallest gram hash.

    Returns hash, text, first window, number of windows, whether that gram occurs twice in the run, and a sum over all
    grams, by which runs of different bytes can be told apart. Equal windows have equal hashes, wherever they are;
    those of one run hold the gram at two places.
    """
    raw = b"".join(raws)
    n = len(raw)
    gram = min(GRAM, length)
    if n < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64))
    h = _hashes(raw, gram)
    grams = length - gram + 1
    g, h = h, _over(h, grams, np.minimum)
    edge = np.zeros(grams - 1, np.uint64)
    least = np.flatnonzero(_over(np.concatenate((edge, h, edge)), grams, np.maximum) == g)  # the smallest of some window
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(raws)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
    value = h[first[text] + at]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (text[1:] != text[:-1]))) if len(value) else np.zeros(0, bool)
    place = np.arange(len(value))
    into = place - np.maximum.accumulate(np.where(new, place, 0))
    new |= into % STRETCH == 0
    cut = np.flatnonzero(new)
    value, count = value[cut], np.diff(np.append(cut, len(value)))
    known, which = np.unique(g[least], return_inverse=True)
    spots = np.sort((which.astype(np.int64) << 32) | least)
    begin = (np.searchsorted(known, value) << 32) | (first[text[cut]] + at[cut])
    twice = np.searchsorted(spots, begin + count + grams - 1) - np.searchsorted(spots, begin) > 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(g, dtype=np.uint64)))
    begin = first[text[cut]] + at[cut]
    return value, text[cut], at[cut], count, twice, total[begin + count + grams - 1] - total[begin]


def _bucketed(e: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    b = (e["h"] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    e, b = e[order], b[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    return b[cut], np.split(e, cut[1:])


def _columns(e: np.ndarray) -> bytes:
    """Field after field, which compresses better in a shuffle than entry after entry."""
    return len(e).to_bytes(4, "little") + b"".join(np.ascontiguousarray(e[f]).tobytes() for f in e.dtype.names)


def _entries(raw: bytes, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    n, at = int.from_bytes(raw[:4], "little"), 4
    e = np.empty(n, kind)
    for f in kind.names:
        size = kind[f].itemsize * n
        e[f] = np.frombuffer(raw[at : at + size], kind[f])
        at += size
    return e, raw[at:]


def _raws(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids (null as NULL_ID), texts as bytes, and checksums that tell texts of one id apart."""
    ids = np.array([NULL_ID if d is None else d for d in batch.column(0).to_pylist()], np.int64)
    raws = [(t or "").encode() for t in batch.column(1).to_pylist()]
    return ids, raws, np.array([zlib.crc32(r) for r in raws], np.int64)


def _different(e: np.ndarray, whole: np.ndarray, new: np.ndarray, length: int) -> np.ndarray:
    """For each hash of ``e``, which is in its order: the bytes of its different stretches but one."""
    group = np.cumsum(new) - 1
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    many = many[np.lexsort((e["n"][many], whole[many], group[many]))]
    a, b = many[1:], many[:-1]
    other = a[(group[a] == group[b]) & ((whole[a] != whole[b]) | (e["n"][a] != e["n"][b]))]
    size = np.bincount(group[other], e["n"][other].astype(np.int64) + length - 1, group[-1] + 1)
    return np.minimum(size, 0xFFFFFFFF).astype(np.uint32)


def anchors(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Of each stretch its hash and place. Of a batch's stretches of one hash, the first goes to the hash's bucket, with
    the bytes that the different ones among the others have; those, which are known to recur, go straight to their documents."""

    def run(batches):
        for batch in batches:
            found, sums = [], []
            for part in pieces([batch], "text", PIECE):
                ids, raws, tags = _raws(part)
                h, text, at, n, twice, whole = stretches(raws, length)
                e = np.zeros(len(h), ANCHOR)
                e["h"], e["doc"], e["tag"], e["start"], e["n"], e["known"] = h, ids[text], tags[text], at, n, twice
                found.append(e)
                sums.append(whole)
            e = np.concatenate(found) if found else np.zeros(0, ANCHOR)
            if not len(e):
                continue
            order = np.argsort(e["h"], kind="stable")
            e, whole = e[order], np.concatenate(sums)[order]
            new = np.concatenate(([True], e["h"][1:] != e["h"][:-1]))
            lead = np.flatnonzero(new)
            e["known"][lead] |= np.diff(np.append(lead, len(e))) > 1
            if len(lead) < len(e):
                e["more"][lead] = _different(e, whole, new, length)
                more = e[~new]
                yield _doc_rows(more["doc"], more["tag"], _places(more), buckets)
            b, parts = _bucketed(e[lead], buckets)
            yield _blob_rows(b, [_columns(x) for x in parts])

    return rows.mapInArrow(run, BLOB)


def _places(e: np.ndarray) -> np.ndarray:
    out = np.empty(len(e), PLACE)
    for f in PLACE.names:
        out[f] = e[f]
    return out


def recurring(found: DataFrame, partitions: int, length: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows (doc_id, places): the stretches whose hash occurs elsewhere too; under a null doc_id, the hashes whose
    stretches have more than ``most_bytes``."""

    def run(batches):
        e = []
        for batch in batches:
            e += [_entries(raw, ANCHOR)[0] for raw in batch.column("payload").drop_null().to_pylist()]
            yield _known(batch)
        e = np.concatenate(e) if e else np.zeros(0, ANCHOR)
        e = e[np.argsort(e["h"], kind="stable")]
        new = np.concatenate(([True], e["h"][1:] != e["h"][:-1])) if len(e) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        again = (np.bincount(group)[group] > 1) | (e["known"] > 0) if len(e) else new
        if again.any():
            yield _doc_only(e["doc"][again], e["tag"][again], _places(e[again]))
        size = np.bincount(group, e["n"] + (e["more"] + (length - 1.0))) if len(e) else np.zeros(0)
        if (size > most_bytes).any():
            hot = np.ascontiguousarray(e["h"][new][size > most_bytes]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([hot], pa.binary())], names=["doc_id", "tag", "places"])

    met = found.repartition(partitions, "bucket").mapInArrow(run, BY_DOC)
    return staged(met.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "places")).alias("places")), "repeats-places")


def segments(rows: DataFrame, places: DataFrame, length: int, buckets: int) -> DataFrame:
    """The bytes of the recurring stretches by bucket of their hash; of equal ones of a batch only the first.

    All windows of an equal stretch that comes later are copies, so those are marked at once. Hashes with too many
    bytes for an index (eight bytes are broadcast for each, and each stands for ``MOST_BYTES`` of text) give no
    stretches but their windows, by bucket of the hash of the window, from ``buckets`` on; those of a batch are
    treated alike.
    """
    hot = [x["places"] for r in places.where("doc_id IS NULL").select("places").collect() for x in r["places"]]
    held = rows.sparkSession.sparkContext.broadcast(np.unique(np.frombuffer(b"".join(hot), "<u8")))
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    joined = keyed.join(places.withColumnRenamed("doc_id", "key"), "key").select("doc_id", "text", "places")

    def run(batches):
        for batch in batches:
            for part in pieces([batch], "text", 8 * PIECE):
                ids, raws, tags = _raws(part)
                found, bodies = [], []
                for d, raw, tag, lists in zip(ids, raws, tags, part.column(2).to_pylist()):
                    own = [np.frombuffer(x["places"], PLACE) for x in lists if x["tag"] == tag]
                    if not own:
                        continue
                    p = np.concatenate(own)
                    e = np.empty(len(p), SEGMENT)
                    e["h"], e["doc"], e["tag"], e["start"] = p["h"], d, tag, p["start"]
                    e["size"] = p["n"].astype(np.int64) + length - 1
                    found.append(e)
                    bodies += [raw[a : a + s] for a, s in zip(p["start"].tolist(), e["size"].tolist())]
                if not found:
                    continue
                e = np.concatenate(found)
                many = np.isin(e["h"], held.value) if len(held.value) else np.zeros(len(e), bool)
                if many.any():
                    yield from _first_windows(e[many], [bodies[i] for i in np.flatnonzero(many).tolist()], length, buckets)
                    e, bodies = e[~many], [bodies[i] for i in np.flatnonzero(~many).tolist()]
                if len(e):
                    yield from _first_ones(e, bodies, buckets)

    return joined.mapInArrow(run, BLOB)


def _split(e: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Entries in the order of their places, the first of each equal (hash, bytes), and the others."""
    order = np.lexsort((e["start"], e["tag"], e["doc"]))
    seen: dict[bytes, int] = {}
    first = np.zeros(len(e), bool)
    same = np.zeros(len(e), bool)
    for i in order.tolist():
        j = seen.setdefault(bodies[i], i)
        first[i] = i == j
        same[i] = i != j and (e["doc"][i], e["tag"][i], e["start"][i]) != (e["doc"][j], e["tag"][j], e["start"][j])
    keep = order[first[order]]
    return e[keep], [bodies[i] for i in keep.tolist()], e[same]


def _whole(e: np.ndarray) -> np.ndarray:
    m = np.empty(len(e), MARK)
    m["start"], m["end"] = e["start"], e["start"] + e["size"]
    return m


def _first_ones(e: np.ndarray, bodies: list[bytes], buckets: int):
    e, bodies, later = _split(e, bodies)
    if len(later):
        yield _doc_rows(later["doc"], later["tag"], _whole(later), buckets)
    b = (e["h"] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    e, b, bodies = e[order], b[order], [bodies[i] for i in order.tolist()]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    ends = np.append(cut[1:], len(e))
    yield _blob_rows(b[cut], [_columns(e[x:y]) + b"".join(bodies[x:y]) for x, y in zip(cut.tolist(), ends.tolist())])


def _windows(e: np.ndarray, bodies: list[bytes], length: int) -> np.ndarray:
    """All windows of the stretches, with 96 bits by which different ones are told apart."""
    raw = b"".join(bodies)
    size = e["size"].astype(np.int64)
    count = size - length + 1
    of = np.repeat(np.arange(len(e)), count)
    on = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[of] + on
    w = np.empty(len(of), WINDOW)
    w["h"] = _hashes(raw, length)[at]
    w["check"] = _hashes(raw, length, 0xD6E8FEB86659FD93)[at] >> np.uint64(32)
    w["doc"], w["tag"], w["start"] = e["doc"][of], e["tag"][of], e["start"][of] + on
    return w


def _apart(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each window, and the other places."""
    w = w[np.lexsort((w["start"], w["tag"], w["doc"], w["check"], w["h"]))]
    new = np.concatenate(([True], (w["h"][1:] != w["h"][:-1]) | (w["check"][1:] != w["check"][:-1]))) if len(w) else np.zeros(0, bool)
    first = w[new]
    lead = first[np.cumsum(new) - 1]
    return first, w[(w["doc"] != lead["doc"]) | (w["tag"] != lead["tag"]) | (w["start"] != lead["start"])]


def _joined(w: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, checksum and mark of each row of neighbouring windows."""
    w = w[np.lexsort((w["start"], w["tag"], w["doc"]))]
    at = np.flatnonzero(np.concatenate(([True], (w["doc"][1:] != w["doc"][:-1]) | (w["tag"][1:] != w["tag"][:-1]) | (w["start"][1:] > w["start"][:-1] + np.uint32(1)))))
    m = np.empty(len(at), MARK)
    m["start"] = w["start"][at]
    m["end"] = w["start"][np.append(at[1:], len(w)) - 1] + np.uint32(length)
    return w["doc"][at], w["tag"][at], m


def _first_windows(e: np.ndarray, bodies: list[bytes], length: int, buckets: int):
    """As _first_ones, window by window, in steps of about ``PIECE`` bytes."""
    held, size = np.zeros(0, WINDOW), np.cumsum(e["size"].astype(np.int64))
    for part in np.split(np.arange(len(e)), np.flatnonzero(np.diff(size // PIECE)) + 1):
        held, later = _apart(np.concatenate((held, _windows(e[part], [bodies[i] for i in part.tolist()], length))))
        if len(later):
            yield _doc_rows(*_joined(later, length), buckets)
    b, parts = _bucketed(held, buckets)
    yield _blob_rows(b + buckets, [_columns(x) for x in parts])


def blocks(e: np.ndarray, most_bytes: int) -> list[np.ndarray]:
    """Numbers of the entries in groups of about ``most_bytes``; those of one hash stay together, in their order."""
    order = np.argsort(e["h"], kind="stable")
    h, size = e["h"][order], e["size"][order].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    cut, held = [], 0
    for at, n in zip(new.tolist(), np.add.reduceat(size, new).tolist()):
        if held and held + n > most_bytes:
            cut.append(at)
            held = 0
        held += n
    return [np.sort(x) for x in np.split(order, cut)]


def indexed(found: DataFrame, partitions: int, length: int, buckets: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Marks (doc_id, tag, places) of the windows that occur at an earlier place.

    Each bucket's stretches, in the order of their places, make run-length indexes of about ``most_bytes``, those of one
    hash in one; its matching statistics link the places of each repeated string. Buckets from ``buckets`` on hold
    windows, of which all but the first of equal ones are marked.
    """

    def windows(blobs: list[bytes]):
        later = _apart(np.concatenate([_entries(raw, WINDOW)[0] for raw in blobs]))[1]
        return [_doc_only(*_joined(later, length))] if len(later) else []

    def one(blobs: list[bytes]):
        es, bodies = [], []
        for raw in blobs:
            e, rest = _entries(raw, SEGMENT)
            ends = np.cumsum(e["size"].astype(np.int64)).tolist()
            bodies += [rest[a:b] for a, b in zip([0, *ends], ends)]
            es.append(e)
        e, bodies, later = _split(np.concatenate(es), bodies)
        out = [_doc_only(later["doc"], later["tag"], _whole(later))] if len(later) else []
        for block in blocks(e, most_bytes) if bodies else []:
            index, own = RunLengthIndex([bodies[i] for i in block.tolist()]), e[block]
            copy = index.later_copies(length)
            at, end = runs(copy)
            if len(at):
                s = np.searchsorted(index.start, at, "right") - 1
                m = np.empty(len(at), MARK)
                m["start"] = own["start"][s] + (at - index.start[s])
                m["end"] = own["start"][s] + (end - 1 - index.start[s]) + length
                out.append(_doc_only(own["doc"][s], own["tag"][s], m))
        return out

    def made(bucket: int, blobs: list[bytes]):
        return one(blobs) if bucket < buckets else windows(blobs)

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            yield _known(batch)
            batch = batch.filter(batch.column("payload").is_valid())
            for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
                if held and b != bucket:
                    yield from made(bucket, held)
                    held = []
                bucket = b
                held.append(raw)
        if held:
            yield from made(bucket, held)

    return staged(found.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, BY_DOC), "repeats-marks")


def cleaned(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Each document without the bytes that its marks cover."""
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "places")).alias("marks")).withColumnRenamed("doc_id", "key")
    joined = rows.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID))).join(marks, "key", "left").select("doc_id", "text", "marks")

    def run(batches):
        for batch in batches:
            out = []
            for d, t, lists in zip(*(x.to_pylist() for x in batch.columns)):
                raw = (t or "").encode()
                gone = np.zeros(len(raw) + 1, np.int64)
                tag = zlib.crc32(raw) if lists else 0
                for x in lists or []:
                    if x["tag"] == tag:
                        m = np.frombuffer(x["places"], MARK)
                        np.add.at(gone, m["start"].astype(np.int64), 1)
                        np.add.at(gone, m["end"].astype(np.int64), -1)
                hit = np.cumsum(gone[:-1]) > 0
                at, end = runs(hit)
                kept = np.frombuffer(raw, np.uint8)[~hit].tobytes() if len(at) else raw
                out.append((d, len(raw), int(hit.sum()), len(at), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(at, end)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT_ARROW)] if out else [pa.nulls(0, f.type) for f in OUT_ARROW], schema=OUT_ARROW)

    return joined.mapInArrow(run, OUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of the UTF-8 bytes): what is left of each document.

    A byte goes if a string of ``length`` bytes that covers it also starts at an earlier place: in a document of a
    smaller id, or in the same one before. Null texts count as empty, null ids come first and are one id; texts that
    share an id are told apart by their checksums and come in its order; rows that repeat both id and text are one
    document, so they don't remove each other and give the same row each.

    All windows of ``length`` bytes are dealt by a hash that equal windows share, in stretches; those whose hash occurs
    once hold no repeat and stay where they are. What is left is indexed bucket by bucket, so no text is ever whole
    in one place, and a string in a third of all documents comes once from each batch of them. A hash whose different
    stretches have more than ``most_bytes``, as those around a common phrase, isn't indexed: its windows are dealt by
    a hash of all their bytes, so no task gets more of them than of others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = anchors(rows, length, 4 * partitions)
    places = recurring(found, partitions, length, most_bytes)
    cut = segments(rows, places, length, 16 * partitions)
    return cleaned(rows, indexed(cut, partitions, length, 16 * partitions, most_bytes))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
