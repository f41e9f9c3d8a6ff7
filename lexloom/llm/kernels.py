"""Vectorised text kernels over Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole Arrow batch at once, so an Arrow function pays
a few numpy passes per byte and no Python call per row or per token.

Two token definitions are used; both treat every byte >= 0x80 as part of a token:

* ``SPACE``: maximal runs of bytes that are not ASCII white space;
* ``WORD``:  maximal runs of ASCII letters and digits (and bytes >= 0x80).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
#: A second odd base, for hashes of token sequences.
_SEQ = U64(0xD6E8FEB86659FD93)
_SEQ_INV = U64(pow(int(_SEQ), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.ones(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False
WORD = np.zeros(256, dtype=bool)
WORD[ord("0") : ord("9") + 1] = True
WORD[ord("a") : ord("z") + 1] = True
WORD[ord("A") : ord("Z") + 1] = True
WORD[128:] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        up = np.full(m, U64(base), dtype=U64)
        down = np.full(m, U64(pow(base, -1, 1 << 64)), dtype=U64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64; a bijection."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Tokens:
    """Tokens of a batch: byte spans in ``data``, 64-bit hashes, and for row r the token range first[r]:first[r+1]."""

    data: np.ndarray
    row_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def tokenise(texts: pa.Array, kind: np.ndarray = WORD) -> Tokens:
    data, at = buffers(texts)
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = kind[data]
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1] if n else True
    heads = at[:-1][at[:-1] < n]
    begin[heads] = inside[heads]
    finish = inside[:n] & ~inside[1:]
    tails = at[1:][at[1:] > 0] - 1
    finish[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    up, down = powers(int(_BASE), n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return Tokens(data, at, starts, ends, np.searchsorted(starts, at), hashes)


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes and 2**16 - 1 rows each, or of one row."""
    _, at = buffers(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        hi = min(hi, n, lo + (1 << 16) - 1)
        yield lo, hi
        lo = hi


def windows(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start token, Rabin-Karp hash) of every window of ``width`` tokens that lies in one row."""
    h = tokens.hashes
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = powers(int(_SEQ), n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(h * up[:n], out=sums[1:])
    last = np.repeat(tokens.first[1:], tokens.counts)
    at = np.flatnonzero(np.arange(n) + width <= last)
    return at, mix((sums[at + width] - sums[at]) * down[at])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i with a whole window, by doubling."""
    if len(x) < width:
        return x[:0]
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def shingles(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every n-gram. A row of 1..n-1 tokens has one: all its tokens."""
    counts = tokens.counts
    at, h = windows(tokens, n)
    rows = tokens.rows()[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        up, _ = powers(int(_SEQ), n + 1)
        own = np.zeros(len(short), U64)
        for k in range(n - 1):
            has = counts[short] > k
            own[has] += tokens.hashes[tokens.first[short[has]] + k] * up[k]
        rows, h = np.concatenate([rows, short]), np.concatenate([h, mix(own)])
    return rows, h


def shingle_sets(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, ascending, as (values, row offsets). For batches of fewer than 2**16 rows."""
    rows, h = shingles(tokens, n)
    order = np.argsort(h)
    order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")]  # a radix sort
    rows, h = rows[order], h[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))
        rows, h = rows[new], h[new]
    return h, np.searchsorted(rows, np.arange(len(tokens.first)))


def list_array(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def binary_array(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column whose row r holds the bytes of values[at[r]:at[r+1]]."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])
