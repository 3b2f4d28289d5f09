"""A run-length index of many byte strings: run-compressed Burrows-Wheeler transform with sampled run ends."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of ``symbols`` (0 to 510) by prefix doubling; only what is still tied is sorted again."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    padded = np.concatenate((symbols.astype(np.int64) + 1, np.zeros(7, np.int64)))  # what follows the end is least
    for i in range(7):
        key = (key << 9) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    depth = 7
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied = np.flatnonzero(np.repeat(size > 1, size))
    while len(tied):
        at = order[tied]
        later = rank[np.minimum(at + depth, n)] + 1
        again = np.argsort((rank[at] << 32) | later, kind="stable")
        at, later, was = at[again], later[again], rank[at][again]
        order[tied] = at
        new = np.concatenate(([True], (was[1:] != was[:-1]) | (later[1:] != later[:-1])))
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        tied = tied[np.repeat(size > 1, size)]
        depth *= 2
    return order


class RunLengthIndex:
    """What is kept of the transform: its runs, and the text places at the start of each run and at the end of the one before.

    Two neighbouring rows of one run are preceded by the same character, so their predecessors are neighbouring rows
    as well. The row above a text place is therefore known wherever it is known at the nearest sample before, that
    many characters further on, and the length that the two share is as much shorter. The places where strings start
    are sampled too, so that no sample is carried from one string into the next.
    """

    def __init__(self, strings: list[bytes]):
        self.raw = b"".join(strings)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.concatenate(([0], np.cumsum(size)))[:-1]
        self.end = self.start + size
        k = len(strings)
        spaced = np.zeros(len(self.raw) + k, np.int16)
        inner = np.arange(len(self.raw)) + np.repeat(np.arange(k), size)  # a terminator stands after each string
        spaced[inner] = np.frombuffer(self.raw, np.uint8).astype(np.int16) + 1
        order = suffix_order(spaced)
        before = spaced[order - 1]  # row 0's wraps around to the last terminator
        head = np.concatenate(([True], before[1:] != before[:-1]))
        self.run_symbol, self.run_start = before[head], np.flatnonzero(head)
        string_start = np.zeros(len(spaced), bool)
        string_start[self.start + np.arange(k)] = True
        rows = np.flatnonzero(head | string_start[order])
        above = np.where(rows > 0, order[np.maximum(rows, 1) - 1], -1)
        here = order[rows]
        real = spaced[here] > 0  # terminators need no sample
        here, above = here[real], above[real]
        above_real = (above >= 0) & (spaced[np.maximum(above, 0)] > 0)
        terminators = np.cumsum(spaced == 0)
        flat = lambda x: x - terminators[x]  # noqa: E731  places without terminators
        above = np.where(above_real, flat(np.maximum(above, 0)), -1)
        here = flat(here)
        by_place = np.argsort(here)
        self.sample, self.sample_above = here[by_place], above[by_place]

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes agree from a and from b on, up to ``most``."""
        words = np.lib.stride_tricks.as_strided(np.frombuffer(self.raw + bytes(8), np.uint8)[:8].view("<u8"), (len(self.raw) + 1,), (1,))
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            at = out[live]
            x = words[a[live] + at] ^ words[b[live] + at]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            out[live] = np.minimum(at + same, most[live])
            live = live[(same == 8) & (out[live] < most[live])]
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the text, in its order: the place in the row above, and how long the match with it is.

        The row above is the text's own best match among smaller suffixes (-1 and 0 where there is none); matches end
        with their strings. Places that share the same long string are linked row by row.
        """
        n = len(self.raw)
        string = np.repeat(np.arange(len(self.start)), self.end - self.start)
        has = self.sample_above >= 0
        other = np.where(has, self.sample_above, 0)
        most = np.where(has, np.minimum(self.end[string[self.sample]] - self.sample, self.end[string[other]] - other), 0)
        length = self._shared(self.sample, other, most)
        place = np.arange(n)
        last = np.searchsorted(self.sample, place, "right") - 1
        on = place - self.sample[last]
        match = np.maximum(length[last] - on, 0)
        return np.where(match > 0, other[last] + on, -1), match

    def later_copies(self, length: int) -> np.ndarray:
        """True at the places whose next ``length`` bytes also start at a smaller place (all within one string)."""
        above, match = self.matching_statistics()
        n = len(self.raw)
        long = match >= length
        root = np.where(long, above, np.arange(n))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        first = np.arange(n)
        at = np.flatnonzero(long)
        np.minimum.at(first, root[at], at)
        return first[root] != np.arange(n)
