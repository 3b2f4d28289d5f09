"""The registered queries over whole tables against plain Python versions."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard

from gridloom.llm import op6_quality, op10_language, queries
from tests.llm.test_operators import brute_components, brute_ratios, brute_repeats, brute_samples, brute_spans, reference_ids
from gridloom.llm import op8_secrets

SRC = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return [(d, t or "", lang) for d, t, lang in zip(*(pq.read_table(f"{SRC}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text", "lang")))]


def result(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SRC).collect()}


def fold(d, n):
    return zlib.crc32(str(d).encode()) % n


def test_op1(spark, rows):
    got = result(spark, "op1_repeats")
    want = brute_repeats([(d, t) for d, t, _ in rows], 100)
    assert {d: tuple(r)[1:5] for d, r in got.items()} == want


def test_op3(spark, rows):
    pieces = queries.QUERIES["op3_packing"](spark, SRC).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d for d, _, _ in rows}
    for d, t, _ in rows:
        ids, at = np.array([*reference_ids(t), 0], "<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))] and sum(r.length for r in held) <= 1024


def test_op4(spark, rows):
    got, at = result(spark, "op4_frames"), 0
    for d, t, _ in sorted(rows):
        ids = np.array([*reference_ids(t), 2], "<u4")
        assert tuple(got[d]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_op5(spark, rows):
    assert sorted(map(tuple, result(spark, "op5_jaccard").values())) == brute_components([(d, t) for d, t, _ in rows], 4, 85, 100)


def test_op6(spark, rows):
    """Densities from inverses and determinants of covariances that are written out anew."""
    got = result(spark, "op6_quality")
    labels = [(d, q) for d, q in zip(*(pq.read_table(f"{SRC}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "quality")))]
    x = {d: np.array(op6_quality.statistics(t)) for d, t, _ in rows}
    learned = {k: np.array([x[d] for d, q in labels if q == k and fold(d, 5) != 0 and d in x]) for k in (0, 1)}
    n = {k: len(v) for k, v in learned.items()}
    prior = {k: (n[k] + 1) / (n[0] + n[1] + 2) for k in n}
    spread = {k: np.cov(v.T, bias=True) for k, v in learned.items()}
    pooled = prior[0] * spread[0] + prior[1] * spread[1]
    log = {}
    for k in (0, 1):
        c = 0.9 * spread[k] + 0.1 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        inverse, size = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        log[k] = lambda v, k=k, inverse=inverse, size=size: np.log(prior[k]) - 0.5 * size - 0.5 * (v - learned[k].mean(axis=0)) @ inverse @ (v - learned[k].mean(axis=0))
    for d, v in x.items():
        want = 1 / (1 + np.exp(np.clip(log[0](v) - log[1](v), -50, 50)))
        assert abs(got[d].score - want) < 1e-6 and got[d].held_out == (fold(d, 5) == 0) and got[d].predicted == int(got[d].score >= 0.3)
    assert len(got) == len(rows)


def test_op8(spark, rows):
    got = result(spark, "op8_secrets")
    random = {}
    for d, a, b, x in brute_ratios([(d, t) for d, t, _ in rows]):
        if x >= op8_secrets.MIN_TOTAL and x >= op8_secrets.MIN_MEAN * (b - a - 1):
            random.setdefault(d, []).append((a, 3, b))
    for d, t, _ in rows:
        base, r = brute_spans(t), got[d]
        written = lambda spans: ",".join(f"{op8_secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest() and r.spans == written(sorted(base + random.get(d, [])))
    assert len(got) == len(rows)


def test_op9(spark, rows):
    got = result(spark, "op9_fingerprints")
    order = sorted(rows, key=lambda r: -r[0])
    for i, (d, t, _) in enumerate(order[:60]):
        after, half = order[i + 1][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other, following = map(brute_samples, (t, edited, after))
        assert (got[d].near_edited, got[d].near_next) == tuple(float(np.mean(np.isclose(own, x, rtol=1e-9, atol=0))) for x in (other, following))
    assert len(got) == len(rows) and len({r.fingerprint for r in got.values()}) == len({brute_samples(t).tobytes() for _, t, _ in rows})


def test_op10(spark, rows):
    """Sizes by the library alone, of whole texts in stretches of 4096 bytes of their letters."""
    got = result(spark, "op10_language")
    docs = spark.read.parquet(f"{SRC}/documents.parquet")
    learned = op10_language.fit(docs.where(op10_language.crc_of_id(docs.doc_id) % 3 != 1))
    assert any(len(t) > 3 * 4096 for _, t, _ in rows)
    for d, t, _ in rows:
        letters = " ".join(re.findall(r"[^\W\d_]+", t.lower())).encode()
        size = {}
        for lang, raw in learned.items():
            c = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            size[lang] = sum(len(c.compress(letters[i : i + 4096])) for i in range(0, len(letters), 4096))
        best = sorted(size, key=lambda lang: (size[lang], lang))
        want = (best[0], 1 - size[best[0]] / size[best[1]]) if letters else ("und", 0.0)
        assert got[d].lang_pred == want[0] and abs(got[d].score - want[1]) < 1e-9 and got[d].held_out == (fold(d, 3) == 1)
    held = [(d, lang) for d, _, lang in rows if fold(d, 3) == 1 and lang]
    assert sum(got[d].lang_pred == lang for d, lang in held) >= 0.9 * len(held) and len(got) == len(rows)
