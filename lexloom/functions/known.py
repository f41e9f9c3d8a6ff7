"""Where the words of a given set stand in texts, by numpy over whole slices of a table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Characters of texts that are looked through at once; a longer text is a slice of its own.
SLICE = 1 << 18


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is part of a word, as in ``text.words``."""
    inside = np.zeros(0x110000, bool)
    for run in re.finditer(r"[\wঀ-৿]+", "".join(map(chr, range(0x110000)))):
        inside[run.start() : run.end()] = True
    return inside


_powers = np.ones((2, 1), U64)


def _up_down(n: int) -> np.ndarray:
    """Powers below n of an odd base and of its inverse, modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        steps = np.ones((2, max(n, SLICE + 2)), U64)
        steps[0, 1:], steps[1, 1:] = U64(_BASE), U64(pow(_BASE, -1, 1 << 64))
        _powers = np.multiply.accumulate(steps, axis=1)
    return _powers


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the code points from each start to its end; where a word stands in ``data`` doesn't matter."""
    up, down = _up_down(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data + U64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> U64(32)
    return h * U64(0xBF58476D1CE4E5B9)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first text, texts) with ``SLICE`` characters at most, or one text."""
    lo, size, held = 0, 0, []
    for at in range(0, len(texts), 256):
        for text in texts[at : at + 256].to_pylist():
            n = len(text) + 1 if text else 1
            if held and size + n > SLICE:
                yield lo, held
                lo, size, held = lo + len(held), 0, []
            held.append(text)
            size += n
    if held:
        yield lo, held


class Known:
    """The distinct ``names``, by their number; ``find`` compares hashes first and then the characters, so it is exact."""

    def __init__(self, names: list[str]) -> None:
        self.size = np.array([len(n) for n in names], np.int64)
        self.at = np.cumsum(self.size + 1) - self.size - 1
        self.chars = _codes(names)
        self.hash = _hashes(self.chars, self.at, self.at + self.size)
        bits = len(names).bit_length() + 4
        self.shift = U64(64 - bits)
        bucket = (self.hash >> self.shift).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.first = np.searchsorted(bucket[self.order], np.arange((1 << bits) + 1))

    def _same(self, data: np.ndarray, starts: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Whether the characters from each start are those of the name, whose length is right."""
        same, at, left, on = np.ones(len(name), bool), self.at[name], self.size[name], np.arange(len(name))
        for j in range(int(left.max(initial=0))):
            on = on[left[on] > j]
            same[on[data[starts[on] + j] != self.chars[at[on] + j]]] = False
        return same

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, text of each known word in order, its number)."""
        lower = [t.lower() if t else "" for t in texts]
        data = _codes(lower)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _letters()[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in lower)]))
        length, h = np.diff(first), _hashes(data, starts, ends)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        code, on = np.full(len(h), -1), np.flatnonzero(at < end)
        while len(on):
            name = self.order[at[on]]
            hit = np.flatnonzero((self.hash[name] == h[on]) & (self.size[name] == ends[on] - starts[on]))
            hit = hit[self._same(data, starts[on[hit]], name[hit])]
            code[on[hit]] = name[hit]
            at[on] += 1
            on = on[(code[on] < 0) & (at[on] < end[on])]
        known = np.flatnonzero(code >= 0)
        return length, np.repeat(np.arange(len(texts)), length)[known], code[known]

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, text, number, times): each known word of a text once, by text and number."""
        length, row, code = self.find(texts)
        key = np.sort(row * len(self.size) + code)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        row, code = np.divmod(key[new], len(self.size)) if len(key) else (row, code)
        return length, row, code, np.diff(np.append(new, len(key)))
