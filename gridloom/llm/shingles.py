"""Sets of word shingles as 64-bit hashes, made for many texts at once with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = np.ones(256, np.int8)
_WORD[[0x20, 9, 10, 11, 12, 13]] = 0
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Masks that leave the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes beyond which a word is hashed by itself.
LONG_WORD = 128


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased ``raw`` and where they start."""
    raw = raw.translate(_LOWER)
    b = np.frombuffer(raw + bytes(8), np.uint8)
    word = _WORD[b[: len(raw)]]
    edge = np.flatnonzero(np.diff(word, prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.lib.stride_tricks.sliding_window_view(b, 8)
    out = mix(eight[start].view("<u8")[:, 0] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _FACTOR
    more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        part = eight[start[more] + at].view("<u8")[:, 0] & _FIRST[np.minimum(size[more] - at, 8)]
        out[more] = mix(out[more] * _FACTOR + part)
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return mix(out), start


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text its distinct ``n``-word shingles, ascending; a text of fewer words has one, of none none."""
    raws = [(t or "").encode() for t in texts]
    hashes, start = word_hashes(b" ".join(raws) + b" ")
    ends = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws])).tolist()
    factor = mix(np.arange(1, n + 2, dtype=np.uint64)) | np.uint64(1)
    together = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        together += hashes[i : len(hashes) - n + 1 + i] * factor[i]
    together = mix(together)
    out, a = [], 0
    for b in ends:
        if b - a >= n:
            s = np.sort(together[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:  # as one, apart from shingles of n words by how many there are
            out.append(mix((hashes[a:b] * factor[: b - a]).sum(keepdims=True) + factor[n] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out
