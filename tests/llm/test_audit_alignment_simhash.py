"""Operators 11 to 13 against brute-force versions, and on rows that are null, empty, long, repeated or absent."""

import collections
import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import op11_audit, op12_alignment, op13_simhash, queries

R = random.Random(11)
SRC = "/root/testdata/sf0.001"
WORDS = "the quick brown fox JUMPS over lazy dog und der Straße niño α x1 2024 end. (so) token #tag a&b".split()


def prose(n):
    return " ".join(R.choice(WORDS) + (R.choice(WORDS) if R.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    made = [prose(R.randint(1, 120)) for _ in range(40)]
    made += [made[0], made[1] + " more", made[2].replace("fox", "cat", 1), "q" * 700, "AB" * 600, made[3] * 3, "  spaced   out\n\nlines\t", "!!! ###", "one two", "one  TWO", prose(4000), made[4].upper()]
    made += ["<|endoftext|> and <s> </s> <0x41> 😀 ﬁ １\x00zero", "has ▁ in it", " ", "\n", "a ", " a", "trailing  ", "x y　z  w"]
    return [*enumerate(made), (900, None), (901, ""), (None, "no id"), (None, made[0]), (None, None), (0, made[0]), (1, "another text of id one")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, f"s{i % 3}" if i % 5 else None, 1, 2, 3.0, 4) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, part string, n int, first double, `a.b` int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, d % 2, d % 3 % 2) for d in range(0, 40)] + [(4, 1, 1), (5, None, None), (None, 1, 1), (777, 1, 1)], "doc_id long, quality int, toxic int")


# 11


def brute_failed(t, earlier):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), earlier]


def brute_audit(rows, labels):
    """Each order applied row by row."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    by_part, out = collections.defaultdict(list), {}
    for d, t, part in rows:
        by_part[part or ""].append((d, brute_failed(t or "", d is not None and first[t or ""] < d)))
    for part, held in by_part.items():
        removed_by = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            here = held
            for step, letter in enumerate(order, 1):
                i = "ABCDE".index(letter)
                gone = [(d, f) for d, f in here if f[i]]
                here = [(d, f) for d, f in here if not f[i]]
                removed_by[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(here), len(gone), sum(f[i] for _, f in held) - len(gone), sum(f[i] and sum(f) == 1 for _, f in held), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def as_audit(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in op11_audit.COUNTS] for r in df.collect()}


def test_audit(docs, labels):
    got = as_audit(op11_audit.audit(docs, labels))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert got == brute_audit(rows, [tuple(r) for r in labels.collect()])
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_audit_of_own_filters(spark, docs, labels):
    """Two conditions, one of them null for some rows, without a look for copies."""
    got = as_audit(op11_audit.audit(docs, labels, filters={"X": F.length("text") > 100, "Y": F.col("source") == "s1"}, copies=None))
    rows = [(len(t) > 100 if t is not None else False, s == "s1", s or "") for _, t, s in ((r.doc_id, r.text, r.source) for r in docs.collect())]
    for part in {p for *_, p in rows}:
        own = [r for r in rows if r[2] == part]
        assert got[part, "XY", 1][:2] == [sum(not x for x, *_ in own), sum(x for x, *_ in own)]
        assert got[part, "XY", 2][:3] == [sum(not x and not y for x, y, _ in own), sum(y and not x for x, y, _ in own), sum(x and y for x, y, _ in own)]
        assert got[part, "YX", 1][6] == sum(y for _, y, _ in own) + sum(y and not x for x, y, _ in own)


def test_removal_polynomial():
    """Shapley values as means over all orders, corners by counting."""
    for n in (1, 2, 3, 4):
        counts = [R.randint(0, 20) for _ in range(1 << n)]
        f = op11_audit.Removal(counts, n)
        removed = [sum(c for m, c in enumerate(counts) if m & s) for s in range(1 << n)]
        assert [f.corner(s) for s in range(1 << n)] == removed
        for i in range(n):
            gains = [removed[sum(1 << j for j in o[: o.index(i) + 1])] - removed[sum(1 << j for j in o[: o.index(i)])] for o in itertools.permutations(range(n))]
            assert f.shapley(i) == Fraction(sum(gains), len(gains))
        assert sum(f.shapley(i) for i in range(n)) == f.corner((1 << n) - 1)


def test_audit_of_nothing(none, labels, docs):
    assert op11_audit.audit(none, labels).collect() == []
    got = as_audit(op11_audit.audit(docs, labels.where("false")))
    assert got and not any(v[4] or v[5] for v in got.values())


def test_op11_registered(spark):
    documents, labels = (pq.read_table(f"{SRC}/{t}.parquet").to_pydict() for t in ("documents", "labels"))
    want = brute_audit(list(zip(documents["doc_id"], documents["text"], documents["source"])), list(zip(labels["doc_id"], labels["quality"], labels["toxic"])))
    assert as_audit(queries.QUERIES["op11_audit"](spark, SRC)) == want


# 12


def brute_tokens():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def tokens(text):
        """(id, start, end) by both, or None."""
        if not text:
            return None
        out = []
        for ids, raw in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in a.id_to_token(i))), (b.encode(text), piece)):
            parts = [raw(i) for i in ids]
            if b"".join(parts) != (" " + text).encode():
                return None
            ends = list(itertools.accumulate(map(len, parts)))
            out.append(list(zip(ids, [0, *ends], ends)))
        return out

    return tokens


def brute_alignment(rows):
    tokens, per_doc, count = brute_tokens(), [], collections.Counter()
    for d, t in rows:
        found = tokens(t)
        if found is None:
            per_doc.append((d, None))
            continue
        a, b = found
        links, low = [], 0
        for i, s, e in a:
            while b[low][2] <= s:
                low += 1
            links += [(i, j) for j, s2, e2 in itertools.takewhile(lambda x: x[1] < e, b[low:]) if s2 < e and s < e2]
        count.update(links)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        group = {c: k for k, c in enumerate(cuts)}
        both = [[[] for _ in cuts] for _ in range(2)]
        for side, held in enumerate(found):
            at = 0
            for i, s, e in held:
                while cuts[at] < e:
                    at += 1
                both[side][at].append(str(i))
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in zip(*both))
        per_doc.append((d, (len(a), len(b), len(group), links, hashlib.sha256(text.encode()).hexdigest())))
    highest = collections.defaultdict(int)
    for (_, j), n in count.items():
        highest[j] = max(highest[j], n)
    return [(d, *((0,) * 6), "") if x is None else (d, x[0], x[1], x[2], len(x[3]), sum(count[p] == highest[p[1]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) for d, x in per_doc]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("most_sent", [op12_alignment.MOST_SENT, 0])
def test_alignment(docs, texts, most_sent, monkeypatch):
    """With all counts broadcast, and with those asked for by chunks."""
    got = op12_alignment.align(docs, most_sent=most_sent).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_alignment(texts), key=key)


def test_overlaps():
    for _ in range(200):
        a, b = ([R.randint(1, 4) for _ in range(R.randint(1, 12))] for _ in range(2))
        (a if sum(a) < sum(b) else b).append(abs(sum(a) - sum(b)) or 1)
        if sum(a) != sum(b):
            (a if sum(a) < sum(b) else b).append(1)
        spans = [[(e - s, e) for s, e in zip(x, itertools.accumulate(x))] for x in (a, b)]
        first, last, *ends = op12_alignment.overlaps(np.array(a), np.array(b))
        assert [list(range(x, y + 1)) for x, y in zip(first, last)] == [[j for j, (s2, e2) in enumerate(spans[1]) if s2 < e and s < e2] for s, e in spans[0]]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        assert list(zip(*ends)) == [(sum(e <= c for _, e in spans[0]), sum(e <= c for _, e in spans[1])) for c in cuts]


def test_groups_are_given(spark):
    (row,) = op12_alignment.aligned(spark.createDataFrame([(1, "hello Straße")], "doc_id long, text string"), with_groups=True).collect()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1


def test_alignment_of_nothing(none):
    assert op12_alignment.align(none).collect() == [] and op12_alignment.align(none, most_sent=-1).collect() == []


def test_op12_registered(spark):
    table = pq.read_table(f"{SRC}/documents.parquet").to_pydict()
    want = brute_alignment(list(zip(table["doc_id"], table["text"])))
    assert sorted(map(tuple, queries.QUERIES["op12_alignment"](spark, SRC).collect())) == sorted(want)


# 13


def brute_fingerprint(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in ([w[i : i + n] for i in range(len(w) - n + 1)] or ([w] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows, bits=2, prints=None):
    """Sorted (doc_id, fingerprint, component) by comparing all fingerprints with all."""
    fp = prints or [brute_fingerprint(t) for _, t in rows]
    different = np.array(sorted(set(fp)), np.uint64)
    root = {int(f): int(f) for f in different}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for f in different:
        for g in different[np.bitwise_count(different ^ f) <= bits]:
            root[find(int(f))] = find(int(g))
    least = {}
    for (d, _), f in zip(rows, fp):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for (d, _), f in zip(rows, fp)), key=key)


def shown(df):
    return sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in df.collect()), key=key)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_simhash(docs, texts, bits):
    assert shown(op13_simhash.simhash(docs, bits=bits)) == brute_simhash(texts, bits)


def test_a_fingerprint_of_every_length():
    for n in (1, 2, 3, 4, 70_000):
        t = prose(n)
        assert op13_simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("long_list", [4096, 3])
def test_dense_fingerprints_are_linked(spark, monkeypatch, long_list):
    """Chains of fingerprints two bits apart, dense and sparse, in posting lists that are whole and split."""
    prints = []
    for _ in range(30):
        f = R.getrandbits(64)
        for _ in range(R.randint(1, 25)):
            prints.append(f)
            for _ in range(R.choice([1, 2, 2, 3, 4])):
                f ^= 1 << R.randint(0, 63)
    base = R.getrandbits(64)
    prints += [base ^ R.getrandbits(10) << 3 for _ in range(150)] + [base] * 20
    R.shuffle(prints)
    rows = [(i * 7 % 10_007, None) for i in range(len(prints))]
    frame = spark.createDataFrame([(d, f - 2**64 if f >= 2**63 else f) for (d, _), f in zip(rows, prints)], "doc_id long, fp long")
    monkeypatch.setattr(op13_simhash, "fingerprints", lambda *_: frame)
    assert shown(op13_simhash.simhash(frame, long_list=long_list)) == brute_simhash(rows, 2, prints)


def test_near_copies_go(spark, docs, texts):
    kept = op13_simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({d for d, _, c in brute_simhash(texts) if d is not None and d == c})


def test_simhash_of_nothing(none):
    assert op13_simhash.simhash(none).collect() == []
    with pytest.raises(ValueError):
        op13_simhash.simhash(none, bits=3)


def test_op13_registered(spark):
    table = pq.read_table(f"{SRC}/documents.parquet").to_pydict()
    want = brute_simhash(list(zip(table["doc_id"], table["text"])))
    assert sorted(map(tuple, queries.QUERIES["op13_simhash"](spark, SRC).collect()), key=key) == want
