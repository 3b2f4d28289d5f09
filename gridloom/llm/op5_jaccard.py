"""N-gram Jaccard join: prefix n-grams find candidates, tries of globally ordered sets are traversed to count overlaps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, pieces, staged, table, unburdened
from .components import components
from .shingles import shingle_sets

#: Frequent shingles that come last in the global order (8 bytes each are broadcast). It is only an order: any number is right.
MOST_FREQUENT = 1 << 17
#: Shingles of texts that are counted at once to find the frequent ones.
COUNTED = 1 << 21
#: Bytes of text that are made sets at once.
PIECE = 512 << 10
#: Members, and shingles of members, that a block of a class has about; classes with more are dealt into several.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Pairs for each document up to which a block gives out pairs; beyond, it gives out its documents.
DENSE = 128
#: Prefix shingles that linked sets share at least go up with their size to one more than this; longer prefixes pay for it.
MOST_SHARED = 127
#: Classes of a document that go along with its rows of blocks; more would only find out more pairs that are given twice.
CLASSES_KEPT = 16
#: Rows of ids (32 bytes at most) up to which they are broadcast to find their texts; beyond, texts are shuffled to them.
BROADCAST_IDS = 1 << 20


def needed(nx, ny, num: int, den: int):
    """The least overlap of linked sets of these sizes: den * i >= num * (nx + ny - i)."""
    return -(-num * (nx + ny) // (num + den))


class Trie:
    """Ordered sets as a prefix tree: what several sets begin with is one node.

    A node stands for the places ``low`` to ``high`` of the sorted sets. It has the shingles that these share beyond
    its parent (depths ``above`` to ``depth``) and their least and greatest size.
    """

    STEP = 64

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        shared = np.array([self._shared(a, b) for a, b in zip(self.sets, self.sets[1:])], np.int64)
        self.nodes: list[tuple[int, int, int, int, int, int, list[int]]] = []
        todo = [(0, len(sets), 0, None)] if sets else []
        while todo:
            low, high, above, siblings = todo.pop()
            depth = int(shared[low : high - 1].min()) if high - low > 1 else int(self.size[low])
            children: list[int] = []
            if siblings is not None:
                siblings.append(len(self.nodes))
            part = self.size[low:high]
            self.nodes.append((low, high, above, depth, int(part.min()), int(part.max()), children))
            if high - low > 1:
                cuts = [low, *(np.flatnonzero(shared[low : high - 1] == depth) + low + 1).tolist(), high]
                todo += [(a, b, depth, children) for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        return int(differ[0]) if len(differ) else k

    def linked(self, probe: np.ndarray, wanted: np.ndarray, num: int, den: int) -> list[int]:
        """Places (as given) of the sets that ``probe`` links with, of those for which ``wanted`` holds.

        Overlaps are counted along the paths, once for what paths share. Below a node at depth d with o shared so far,
        no set shares more than o + min(greatest size - d, probe's shingles beyond); where that is less than its
        smallest set needs, or no set below is wanted or near enough in size, the whole subtree is left.
        """
        nx, out = len(probe), []
        if not nx or not self.nodes:
            return out
        rank = np.concatenate(([0], np.cumsum(wanted[self.order])))
        todo = [(0, 0, 0)]
        while todo:
            node, both, beyond = todo.pop()
            low, high, above, depth, least, greatest, children = self.nodes[node]
            if rank[high] == rank[low] or greatest * den < num * nx or nx * den < num * least:
                continue
            enough = needed(nx, least, num, den)
            label, at = self.sets[low], above
            while True:
                if both + min(greatest - at, nx - beyond) < enough:
                    break
                if at == depth:
                    if children:
                        todo += [(c, both, beyond) for c in children]
                    elif both >= enough:
                        out.append(self.order[low])
                    break
                part = label[at : min(at + self.STEP, depth)]
                place = np.searchsorted(probe, part)
                hit = probe[np.minimum(place, nx - 1)] == part
                both += int(np.count_nonzero(hit))
                beyond = int(place[-1]) + int(hit[-1])
                at += len(part)
        return out


def shared_prefix(n):
    """How many prefix shingles linked sets share at least, the smaller of theirs: prefixes are longer by one less."""
    return 1 + np.minimum(MOST_SHARED, np.asarray(n) // 16)


def _shared_prefix(n):
    """The same of the smallest set that one of ``n`` shingles can link with, as a column."""
    return lambda num, den: 1 + F.least(F.lit(MOST_SHARED), F.floor(F.ceil(F.col(n) * num / den) / 16))


def prefixes(sets: list[np.ndarray], frequent: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set its first n - ceil(t n) + shared_prefix(n) shingles in the global order, and the place of their set.

    The order: rare shingles by hash, then the frequent ones by how often they occur.
    """
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), size)
    if len(frequent) and len(every):
        place = np.minimum(np.searchsorted(frequent, every), len(frequent) - 1)
        late = np.where(frequent[place] == every, rank[place] + 1, 0)
        order = np.argsort(of * (len(frequent) + 1) + late, kind="stable")
        every = every[order]
    first = np.cumsum(size) - size
    keep = np.arange(len(every)) - first[of] < (size + -(num * size // den) + shared_prefix(size))[of]
    return every[keep], of[keep]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def frequent_shingles(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur within parts of batches (of all documents), and their ranks by count; MOST_FREQUENT at most."""

    def run(batches):
        for batch in batches:
            sets: dict[bytes, np.ndarray] = {}
            held = 0

            def counted():
                every = np.sort(np.concatenate(list(sets.values())))
                first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
                h, c = every[first], np.diff(first, append=len(every))
                keep = c >= max(4, len(sets) // 400)
                return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep])], names=["h", "c"])

            for part in pieces([batch], "text", PIECE):
                for s in shingle_sets(part.column(1).to_pylist(), n):
                    if sets.setdefault(xxhash.xxh3_128_digest(s), s) is s:
                        held += len(s)
                if held >= COUNTED:
                    yield counted()
                    sets, held = {}, 0
            if sets:
                yield counted()

    top = rows.mapInArrow(unburdened(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - 1 - np.arange(len(h)))[order]  # most frequent last


POSTED = "doc_id long, n long, twin long, bucket int, payload binary, h long, ref long, ref_n long"
POSTED_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("twin", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("h", pa.int64()), ("ref", pa.int64()), ("ref_n", pa.int64())])
ENTRY = np.dtype([("h", "<u8"), ("ref", "<i8"), ("n", "<i4"), ("more", "u1")])


def _posted(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in POSTED_ARROW], schema=POSTED_ARROW)


def _grouped(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by (h, ref) without repeats; for each the place of its group's first, and how many the group has."""
    e = e[np.lexsort((e["ref"], e["h"]))]
    h, ref = np.ascontiguousarray(e["h"]), np.ascontiguousarray(e["ref"])
    e = e[np.concatenate(([True], (h[1:] != h[:-1]) | (ref[1:] != ref[:-1])))] if len(e) else e
    h = e["h"]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(e) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    return e, np.flatnonzero(new)[group] if len(e) else group, np.bincount(group)[group] if len(e) else group


def _members(e: np.ndarray) -> dict:
    return {"h": pa.array(np.ascontiguousarray(e["h"]).view(np.int64)), "ref": pa.array(np.ascontiguousarray(e["ref"])), "ref_n": pa.array(e["n"].astype(np.int64))}


def post(rows: DataFrame, frequent, rank, n: int, num: int, den: int, buckets: int) -> DataFrame:
    """One pass over the texts: a row for each document (doc_id, n, twin: an equal set of its batch), and prefix entries.

    Of several documents of a batch with one prefix shingle, only the first goes to the shingle's bucket; the others
    are given out as members at once. So a shingle that a third of all documents share sends one entry a batch.
    """

    def run(batches):
        for batch in batches:
            twins: dict[bytes, int] = {}
            found = []
            for part in pieces([batch], "text", PIECE):
                ids, sets = part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), n)
                twin = [None if d is None else twins.setdefault(xxhash.xxh3_128_digest(s), d) if len(s) else d for d, s in zip(ids, sets)]
                yield _posted({"doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "twin": pa.array(twin, pa.int64())}, len(ids))
                own = [i for i, (d, t, s) in enumerate(zip(ids, twin, sets)) if d is not None and t == d and len(s)]
                if own:
                    h, of = prefixes([sets[i] for i in own], frequent.value, rank.value, num, den)
                    e = np.zeros(len(h), ENTRY)
                    e["h"], e["ref"], e["n"] = h, np.array([ids[i] for i in own], np.int64)[of], np.array([len(sets[i]) for i in own])[of]
                    found.append(e)
            if not found:
                continue
            e, first, count = _grouped(np.concatenate(found))
            is_first = first == np.arange(len(e))
            if not is_first.all():
                yield _posted(_members(e[~is_first]), int((~is_first).sum()))
            lead = e[is_first]
            lead["more"] = count[is_first] > 1
            bucket = (lead["h"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            lead, bucket = lead[order], bucket[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            yield _posted({"bucket": pa.array(bucket[cut]), "payload": pa.array([x.tobytes() for x in np.split(lead, cut[1:])], pa.binary())}, len(cut))

    return staged(rows.mapInArrow(unburdened(run), POSTED), "jaccard-postings")


def members(posted: DataFrame, partitions: int, num: int, den: int) -> DataFrame:
    """(h, ref, ref_n) of the prefix shingles that several documents have, of documents that have as many as linked ones share."""

    def run(batches):
        blobs = [x for batch in batches for x in batch.column(0).to_pylist()]
        e, _, count = _grouped(np.frombuffer(b"".join(blobs), ENTRY))
        met = (count > 1) | (e["more"] > 0)
        if met.any():
            got = _members(e[met])
            yield pa.RecordBatch.from_arrays(list(got.values()), names=list(got))

    met = posted.where("bucket IS NOT NULL").repartition(partitions, "bucket").select("payload").mapInArrow(unburdened(run), "h long, ref long, ref_n long")
    every = met.union(posted.where("h IS NOT NULL").select("h", "ref", "ref_n"))
    every = every.withColumn("k", F.count("*").over(Window.partitionBy("ref")))
    return staged(every.where(F.col("k") >= _shared_prefix("ref_n")(num, den)).drop("k"), "jaccard-members")


def classes(met: DataFrame) -> DataFrame:
    """(c, ref, ref_n, weight): shingles with the same members are one class, of as much weight as it has shingles."""
    low = F.lit((1 << 32) - 1)
    mark = [F.sum(F.xxhash64("ref", F.lit(i)).bitwiseAND(low)).alias(f"m{i}") for i in range(3)]
    groups = met.groupBy("h").agg(F.count("*").alias("k"), *mark).where("k > 1")
    kept = groups.groupBy("k", "m0", "m1", "m2").agg(F.min("h").alias("c"), F.count("*").alias("weight")).select("c", "weight")
    return staged(met.join(kept, met["h"] == kept["c"]).select("c", "ref", "ref_n", "weight"), "jaccard-classes")


def _near(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles in 64 * 2**k places, half to all as many as shingles; folding halves gives smaller ones."""
    places = 1 << max(6, len(s).bit_length() - 1)
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def sketches(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(ref, sketch) of the documents of ``ids`` (ref), made once and staged."""

    def run(batches):
        for batch in batches:
            for part in pieces([batch], "text", PIECE):
                made = map(_sketch, shingle_sets(part.column(1).to_pylist(), n))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["ref", "sketch"])

    wanted = _near(staged(ids.select(F.col("ref").alias("doc_id")).distinct(), "jaccard-wanted"))
    return staged(rows.join(wanted, "doc_id", "left_semi").mapInArrow(unburdened(run), "ref long, sketch binary"), "jaccard-sketches")


KEY = ["c", "own", "other"]


def _by_key(rows):
    """Lists of the rows of one key (their first three columns) after the other, without the key; rows are sorted by key."""
    key, held = None, []
    for row in rows:
        if row[:3] != key:
            if held:
                yield key, held
            key, held = row[:3], []
        held.append(row[3:])
    if held:
        yield key, held


def trie_links(dealt: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the documents (KEY, ref, component, probe) of each key.

    The documents of a key make a trie, which those marked ``probe`` are held against. Links within what links
    already join, here or in earlier rounds (``component``), aren't looked for; so there are less of them than documents.
    """
    near = _near(staged(dealt.withColumnRenamed("ref", "doc_id"), "jaccard-dealt"))
    found = rows.join(near, "doc_id").select(*KEY, "probe", "doc_id", "component", "text")

    def sets(batches):
        for batch in batches:
            for part in pieces([batch], "text", PIECE):
                *known, texts = (x.to_pylist() for x in part.columns)
                yield from zip(*known, shingle_sets(texts, n))

    def run(batches):
        for _, held in _by_key(sets(batches)):
            trie = Trie([x[3] for x in held])
            joined = np.unique([x[2] for x in held], return_inverse=True)[1]
            out = []
            for i, (probe, ref, _, own) in enumerate(held):
                if not probe:
                    continue
                for j in trie.linked(own, joined != joined[i], num, den):
                    if joined[j] != joined[i]:
                        joined[joined == joined[j]] = joined[i]
                        out.append((ref, held[j][1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return staged(found.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(unburdened(run), "a long, b long"), "jaccard-links")


def by_center(pairs: DataFrame) -> DataFrame:
    """(KEY, ref, component, probe) of ``pairs`` (center, ref, n, component, center_component): a center asks its partners, in chunks."""
    chunks = pairs.groupBy(F.col("center").alias("c")).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("chunks"), F.first("center_component").alias("component"))
    dealt = pairs.join(chunks.select("c", "chunks"), pairs["center"] == chunks["c"]).select("c", F.pmod(F.xxhash64("ref"), "chunks").cast("int").alias("own"), F.lit(0).alias("other"), "ref", "component", F.lit(False).alias("probe"))
    return dealt.union(chunks.select("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), F.lit(0), "c", "component", F.lit(True)))


def star_pairs(grouped: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of the smallest document of each class and those members that share enough with it in such classes."""
    center = grouped.groupBy("c").agg(F.min(F.struct("ref", "ref_n")).alias("center"))
    met = grouped.join(center, "c").select("ref", "ref_n", "weight", F.col("center.ref").alias("center"), F.col("center.ref_n").alias("n")).where("ref <> center")
    met = met.where(F.least("ref_n", "n") * den >= F.greatest("ref_n", "n") * num).withColumn("least", F.least("ref_n", "n"))
    met = met.groupBy("center", "ref").agg(F.sum("weight").alias("k"), F.max("ref_n").alias("n"), F.min("least").alias("least"))
    met = met.where(F.col("k") >= 1 + F.least(F.lit(MOST_SHARED), F.floor(F.col("least") / 16)))
    return staged(met.select("center", "ref", "n", F.col("ref").alias("component"), F.col("center").alias("center_component")), "jaccard-pairs")


def in_reach(known: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``known`` (c, ref_n, component, ..) whose class has a member of another component and of a size that could link.

    Sizes are looked at in bins as wide as the threshold lets linked sets differ, so those of one lie in neighbouring bins.
    """
    width = max(math.log(den / num) * (1 + 1e-9), 1e-9)
    binned = known.withColumn("bin", F.floor(F.ln("ref_n") / width).cast("long"))
    near = Window.partitionBy("c").orderBy("bin").rangeBetween(-1, 1)  # a row for each bin of a class
    bins = binned.groupBy("c", "bin").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    bins = bins.select("c", "bin", F.min("low").over(near).alias("low"), F.max("high").over(near).alias("high")).where("low < high")
    return binned.join(bins.select("c", "bin"), ["c", "bin"]).drop("bin")


def open_blocks(grouped: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """(KEY, ref, ref_n, component, asks, copy) of the classes that still have members of several components.

    Of a class, only members stay that could link with one of another component by their sizes, of documents that have
    as many shingles in such classes as linked ones share. Members of a class's largest component aren't held against
    each other: those of other components ask. A class of several blocks has each member in one of them, and copies of
    those who ask in all of them, by blocks of these.
    """
    known = grouped.join(labels.select(F.col("node").alias("ref"), "component"), "ref", "left").withColumn("component", F.coalesce("component", "ref"))
    some = in_reach(staged(known, "jaccard-open"), num, den).withColumn("k", F.sum("weight").over(Window.partitionBy("ref")))
    some = staged(some.where(F.col("k") >= _shared_prefix("ref_n")(num, den)).drop("k", "weight"), "jaccard-open")
    some = staged(in_reach(some, num, den), "jaccard-open")
    parts = some.groupBy("c", "component").agg(F.count("*").alias("k"), F.sum("ref_n").alias("n"))
    blocks = lambda k, n: F.ceil(F.greatest(k / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    shape = parts.groupBy("c").agg(F.max_by("component", F.struct("k", "component")).alias("most"), F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "n")).alias("m"))
    shape = shape.where("parts > 1").select("c", "most", blocks(F.col("k"), F.col("n")).alias("blocks"), blocks(F.col("k") - F.col("m.k"), F.col("n") - F.col("m.n")).alias("asking"))
    at = some.join(shape, "c").withColumn("asks", F.col("component") != F.col("most"))
    at = at.withColumn("asking", F.when(F.col("blocks") == 1, 1).otherwise(F.col("asking")))
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda n: F.array(F.pmod(F.xxhash64("ref"), n).cast("int"))
    own = at.select("c", F.explode(deal("blocks")).alias("own"), "asking", "ref", "ref_n", "component", "asks").select("c", "own", F.explode(spread("asking")).alias("other"), "ref", "ref_n", "component", "asks", F.lit(False).alias("copy"))
    copies = at.where("asks AND blocks > 1").select("c", F.explode(spread("blocks")).alias("own"), "asking", "ref", "ref_n", "component", "asks")
    copies = copies.select("c", "own", F.explode(deal("asking")).alias("other"), "ref", "ref_n", "component", "asks", F.lit(True).alias("copy"))
    return staged(own.union(copies), "jaccard-blocks")


def possible(blocks: DataFrame, sketched: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """What the sketches of the documents of blocks allow to link, of different components: pairs, and dense blocks.

    Two sets differ in at least as many shingles as their parity sketches differ in places, which refutes nearly all
    pairs that aren't links. A pair of which both ends know a class before doesn't count again. The pairs that are left of a
    block go out as pairs (as ``by_center`` takes them; a pair that several classes have counts once) if they are at most DENSE for each document, else those documents do, as rows
    (KEY, ref, component, probe). So rows grow with the members of blocks, not with pairs.
    """
    first = blocks.groupBy("ref").agg(F.slice(F.array_sort(F.collect_set("c")), 1, CLASSES_KEPT).alias("in"))
    dealt = blocks.join(sketched.join(first, "ref"), "ref").select(*KEY, "ref", "ref_n", "component", "asks", "copy", "sketch", F.filter("in", lambda x: x < F.col("c")).alias("in"))
    shape = pa.schema([("c", pa.int64()), ("own", pa.int32()), ("other", pa.int32()), ("ref", pa.int64()), ("component", pa.int64()), ("probe", pa.bool_()), ("n", pa.int64()), ("center", pa.int64()), ("center_component", pa.int64())])

    def met(key: tuple, held: list[tuple]) -> list[tuple]:
        size, comp = np.array([x[1] for x in held]), np.array([x[2] for x in held])
        asks, copy = np.array([x[3] for x in held]), np.array([x[4] for x in held])
        width = np.array([len(x[5]) for x in held])
        folded = {}
        for w in set(width.tolist()):
            wide = np.flatnonzero(width >= w)
            folded[w] = np.zeros((len(held), w), np.uint8)
            for v in set(width[wide].tolist()):
                of = wide[width[wide] == v]
                folded[w][of] = _folded(np.frombuffer(b"".join(held[i][5] for i in of), np.uint8).reshape(len(of), v), w)
        by_copies = copy.any()
        pairs: list[tuple[int, int]] | None = []
        seen = np.zeros(len(held), bool)
        within = [set(x[6]) for x in held]
        for x in np.flatnonzero(copy if by_copies else asks):
            y = (comp != comp[x]) & ~copy & (np.minimum(size, size[x]) * den >= np.maximum(size, size[x]) * num)
            for w in {int(width[x]), *width[y & (width < width[x])].tolist()}:
                z = np.flatnonzero(y & (width == w if w < width[x] else width >= w))
                apart = np.bitwise_count(folded[w][z] ^ folded[w][x]).sum(axis=1)
                z = z[apart <= size[x] + size[z] - 2 * needed(size[x], size[z], num, den)]
                z = [i for i in z.tolist() if within[x].isdisjoint(within[i])]  # others have a class before
                if z:
                    seen[x] = True
                    seen[z] = True
                    if pairs is not None:
                        pairs += [(x, i) for i in z]
                        pairs = pairs if len(pairs) <= 2 * DENSE * len(held) else None  # each pair may be met from both ends
        ends = {tuple(sorted((held[x][0], held[z][0]))): (x, z) for x, z in pairs or ()}
        if pairs is not None and len(ends) <= DENSE * int(seen.sum()):
            chosen = [sorted((held[i][0], held[i][2], held[i][1]) for i in xz) for xz in ends.values()]
            return [(None, None, None, b[0], b[1], None, b[2], a[0], a[1]) for a, b in chosen]
        return [(*key, held[i][0], held[i][2], held[i][3], None, None, None) for i in np.flatnonzero(seen)]

    def run(batches):
        out: list[tuple] = []
        parts = (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256))
        for key, held in _by_key(row for part in parts for row in zip(*(x.to_pylist() for x in part.columns))):
            if len(held) > 1:
                out += met(key, held)
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), shape)], schema=shape)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), shape)], schema=shape)

    sorted_ = dealt.repartition(*KEY).sortWithinPartitions(*KEY)
    found = staged(sorted_.mapInArrow(unburdened(run), "c long, own int, other int, ref long, component long, probe boolean, n long, center long, center_component long"), "jaccard-possible")
    pairs = found.where("center IS NOT NULL").groupBy("center", "ref").agg(F.max("n").alias("n"), F.first("component").alias("component"), F.first("center_component").alias("center_component"))
    return pairs, found.where("center IS NULL").select(*KEY, "ref", "component", "probe")


def linked(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of all rows, and (node, component) of the documents that link with a smaller one."""
    if 8 * num < den:
        raise ValueError("thresholds under 1/8 would make prefixes of nearly whole sets")
    rows = _rows(docs, id_col, text_col)
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent, rank = (spark.sparkContext.broadcast(x) for x in frequent_shingles(rows, n))
    posted = post(rows, frequent, rank, n, num, den, 4 * partitions)
    grouped = classes(members(posted, partitions, num, den))
    rows = rows.where("doc_id IS NOT NULL")
    twins = posted.where("doc_id IS NOT NULL AND twin <> doc_id").select(F.col("doc_id").alias("a"), F.col("twin").alias("b"))
    links = twins.union(trie_links(by_center(star_pairs(grouped, num, den)), rows, n, num, den))
    labels = components(links)
    pairs, dense = possible(open_blocks(grouped, labels, num, den), sketches(rows, grouped, n), num, den)
    more = trie_links(by_center(pairs).union(dense), rows, n, num, den)
    if not more.isEmpty():
        labels = components(labels.toDF("a", "b").union(more))
    return posted.where("n IS NOT NULL").select("doc_id", F.col("n").alias("n_shingles")), labels


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, the smallest id that links lead to.

    Documents link when the Jaccard similarity of their sets of ``n``-word shingles (A-Z lower-cased, words between
    white space) is at least ``num / den``. A text of fewer words is one shingle; null texts and texts without words
    have none and link with nothing, as do null ids, whose component is null. Repeated rows each give a row; rows that
    share an id are one node of the links.

    Linked sets share k of the first n - ceil(t n) + k shingles of a global order. Shingles with the same members are
    one class. (1) The smallest document of each class is held against a trie of those members that share enough with
    it, so families of copies come together by as many pairs as members. (2) Where a class still joins different
    components, those are compared, first by sketches that bound the overlap, then by tries of what these leave.
    Nothing that the bounds allow is skipped, so no link between components is lost.
    """
    shown, labels = linked(docs, id_col, text_col, n, num, den)
    return shown.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs`` without those that link, directly or by others, with a row of a smaller id (null ids last).

    Rows count by id and text: rows that share an id stay unless their texts link, and of rows equal in both, with a
    word in the text, one stays. Rows without words all stay. Columns may have any names.
    """
    node, least, times = fresh(docs, "node"), fresh(docs, "least"), fresh(docs, "times")
    keyed = docs.withColumn(node, F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")))
    _, labels = linked(keyed, node, f"`{text_col}`", n, num, den)
    labels = staged(labels.union(labels.select("component", "component").distinct()), "jaccard-labels")
    ids = keyed.select(F.col(node).alias("node"), F.col(f"`{id_col}`").cast("long").alias("id"))
    known = ids.join(_near(labels), "node").withColumn("order", F.struct(F.col("id").isNull(), "id", "node"))
    first = known.groupBy("component").agg(F.min("order").getField("node").alias("node"))
    gone = staged(labels.join(first, "node", "left_anti").select(F.col("node").alias(node)), "jaccard-gone")
    left = keyed.join(_near(gone), node, "left_anti")
    again = staged(left.where(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]")).groupBy(node).agg(F.count("*").alias(times)).where(F.col(times) > 1).select(F.col(node)), "jaccard-again")
    if not again.isEmpty():
        repeated = left.join(again, node, "left_semi")
        left = left.join(again, node, "left_anti").union(repeated.dropDuplicates([node]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g
    FROM words, unnest(generate_series(1, greatest(len(w) - 3, 1))) t(k) WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)
), either AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN either e ON e.a = r.other
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""
