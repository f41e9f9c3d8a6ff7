"""Operator 7: benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The strings are word sequences. A CGK random walk copies the current word to the output and goes on to
the next one or stays, by a random bit of (step, word); a pair at small edit distance gives outputs
at small Hamming distance. A repetition of the LSH samples positions of the output of one walk; windows
of the size of an item that agree with it on all sampled positions in any repetition are verified.

Embedding a window at every word of a corpus would cost hundreds of steps a word. A window within k
edits of an item of n words contains one of the item's k+1 disjoint pieces unchanged, shifted by k words
at most; so only windows with such a piece are embedded, which loses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import U64, WORD, Tokens, mix, slices, tokenise, windows

_SCHEMA = "doc_id long, item_id long, start_token int, end_token int, edits int"


@dataclass
class Index:
    item_id: np.ndarray
    words: list[np.ndarray]
    edits: np.ndarray
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # piece length -> (sorted hashes, item, offset in the item)
    reps: np.ndarray  # repetitions of each item
    steps: np.ndarray  # (repetitions, samples) sampled steps as fractions of 2n
    keys: np.ndarray  # (repetition, item)


def cgk_keys(words: np.ndarray, lengths: np.ndarray, samples: np.ndarray, first: int = 0) -> np.ndarray:
    """Keys (repetition, window) of the padded word sequences (window, word): the sampled outputs of one walk a repetition, numbered from ``first``."""
    n, most = words.shape
    out = np.zeros((len(samples), n), U64)
    row = np.arange(n)
    for rep in range(len(samples)):
        at = np.zeros(n, np.int64)
        want = np.sort((samples[rep][None, :] * (2 * lengths[:, None])).astype(np.int64), axis=1)
        for step in range(int(want.max(initial=0)) + 1):
            current = np.where(at < lengths, words[row, np.minimum(at, most - 1)], U64(0))
            hit = (want == step).sum(1)
            if hit.any():
                at_hit = np.flatnonzero(hit)
                out[rep, at_hit] = mix(out[rep, at_hit] * U64(31) + current[at_hit] + U64(1))
            at += (mix(current ^ U64(((rep + first) << 32) + step * 2654435761 + 97)) & U64(1)).astype(np.int64)
    return out


def repetitions(n: int, k: int, recall: float, samples: int, rng: np.random.Generator, copies: int = 96, walks: int = 24) -> int:
    """Repetitions at which sequences of ``n`` distinct words and copies at ``k`` edits agree in one with ``recall``, measured on random copies.

    Half of the copies have substitutions only, half as many deletions as insertions besides, which keep
    the length. Distinct words are the worst case: repeated ones can only help walks to agree.
    """
    if not k:
        return 1
    item = rng.integers(0, 1 << 63, n, dtype=np.int64)
    grid = np.tile(item, (copies, 1))
    for c in range(copies):
        moved = k // 2 if c % 2 else 0  # pairs of a deletion and an insertion
        w = item.copy()
        swap = rng.choice(n, k - 2 * moved, replace=False)
        w[swap] = rng.integers(0, 1 << 63, len(swap), dtype=np.int64)
        if moved:
            w = np.delete(w, rng.choice(n, moved, replace=False))
            w = np.insert(w, rng.integers(0, len(w) + 1, moved), rng.integers(0, 1 << 63, moved, dtype=np.int64))
        grid[c] = w
    words, row = np.vstack([item[None, :], grid]).view(U64), np.arange(copies + 1)
    p = np.zeros(copies)
    for walk in range(walks):
        salt, at, same = U64(rng.integers(0, 1 << 63)), np.zeros(copies + 1, np.int64), np.zeros(copies)
        for step in range(2 * n):
            current = np.where(at < n, words[row, np.minimum(at, n - 1)], U64(0))
            same += current[1:] == current[0]
            at += (mix(current ^ (salt + U64(step * 2654435761))) & U64(1)).astype(np.int64)
        p += (same / (2 * n)) ** samples / walks
    p = np.clip(p, 1e-9, 1 - 1e-9)
    most = 1
    while np.mean((1 - p) ** most) > 1 - recall:
        most += max(1, most // 16)
    return most


def build_index(ids: list[int], texts: list[str], rate: float, recall: float, match: float, samples: int, seed: int) -> Index:
    """The repetitions of an item are those by which ``recall`` of random copies at its largest distance agree once, and never fewer than follow from ``match``, a share of equal output positions."""
    least = max(1, math.ceil(math.log(1 - recall) / math.log(1 - match**samples)))
    tok = tokenise(pa.array(texts, pa.string()), WORD)
    words = [tok.hashes[a:b] for a, b in zip(tok.first, tok.first[1:])]
    edits = np.array([int(rate * len(w)) for w in words], np.int64)
    pieces: dict[int, list[tuple[int, int, int]]] = {}
    for i, (w, k) in enumerate(zip(words, edits)):
        if len(w):
            n = len(w) // (int(k) + 1)
            one = tokenise(pa.array([texts[i]], pa.string()), WORD)
            at, h = windows(one, n)
            for p in range(0, n * (int(k) + 1), n):
                pieces.setdefault(n, []).append((int(h[p]), i, p))
    rng = np.random.default_rng(seed)
    lengths = np.array([len(w) for w in words], np.int64)
    # Measured at steps of an eighth in length, rounded up, so that many items need few measurements; half the permitted loss is left for the spread.
    at = np.random.default_rng(seed + 1)
    known: dict[int, int] = {}
    reps = np.full(len(words), least, np.int64)
    for i, (n, k) in enumerate(zip(lengths.tolist(), edits.tolist())):
        if k:
            unit = max(1, (1 << n.bit_length()) // 16)
            up = -(-n // unit) * unit
            if up not in known:
                known[up] = repetitions(up, max(k, int(rate * up)), 1 - (1 - recall) / 2, samples, at)
            reps[i] = max(least, known[up])
    steps = rng.random((int(reps.max(initial=least)), samples))
    grid = np.zeros((len(words), max(1, int(lengths.max(initial=0)))), U64)
    for i, w in enumerate(words):
        grid[i, : len(w)] = w
    keys = cgk_keys(grid, lengths, steps)
    table = {}
    for n, found in pieces.items():
        found.sort()
        table[n] = (np.array([f[0] for f in found], U64), np.array([f[1] for f in found]), np.array([f[2] for f in found]))
    return Index(np.array(ids, np.int64), words, edits, table, reps, steps, keys)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Levenshtein distance of word sequences by bit vectors; any number over ``most`` if it is larger."""
    m = len(a)
    if not m:
        return len(b)
    peq: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        peq[x] = peq.get(x, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for x in b.tolist():
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv
    return score


def candidates(tok: Tokens, index: Index) -> np.ndarray:
    """(row, item, start, votes) of the windows that may be within the item's edits, by the pieces in them; votes: how many pieces put the window there."""
    rows = None
    cand: list[np.ndarray] = []
    for n, (hashes, item, offset) in index.pieces.items():
        at, h = windows(tok, n)
        table = np.zeros(1 << 18, bool)
        table[(hashes & U64((1 << 18) - 1)).astype(np.int64)] = True
        near = np.flatnonzero(table[(h & U64((1 << 18) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(hashes, h[near]), np.searchsorted(hashes, h[near], side="right")
        near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(near):
            continue
        rows = tok.rows() if rows is None else rows
        many = hi - lo
        which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pos = np.repeat(at[near], many)
        it, row, base = item[which], rows[pos], pos - offset[which]
        for shift in range(-int(index.edits.max(initial=0)), int(index.edits.max(initial=0)) + 1):
            ok = abs(shift) <= index.edits[it]
            start = np.clip(base[ok] + shift, tok.first[:-1][row[ok]], None)
            cand.append(np.stack([row[ok], it[ok], start, np.full(len(start), shift == 0)], axis=1))
    if not cand:
        return np.zeros((0, 4), np.int64)
    c = np.concatenate(cand)
    found, where = np.unique(c[:, :3], axis=0, return_inverse=True)
    return np.column_stack([found, np.bincount(where.ravel(), c[:, 3], len(found)).astype(np.int64)])


def scan(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of the closest window of each row and item within the item's edits."""
    size = np.array([len(w) for w in index.words], np.int64)
    most = int(size.max(initial=0))
    meta, hashes, before = [], [], 0
    for lo, hi in slices(texts):
        tok = tokenise(texts.slice(lo, hi - lo), WORD)
        c = candidates(tok, index)
        if not len(c):
            continue
        row, it, start, votes = c.T
        length = np.minimum(size[it], tok.first[1:][row] - start)
        meta.append(np.column_stack([row + lo, it, start - tok.first[:-1][row], length, votes, start + before]))
        hashes.append(tok.hashes)
        before += len(tok.hashes)
    if not meta:
        return
    m, flat = np.concatenate(meta), np.concatenate(hashes)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    # First the window of each row and item that most pieces point to; where it is an exact copy, nothing can be closer.
    order = np.lexsort((m[:, 2], -m[:, 4], m[:, 1], m[:, 0]))
    m = m[order]
    chunk = max(1, min(1 << 15, (1 << 22) // max(1, most)))
    lead = np.append(True, (m[1:, 0] != m[:-1, 0]) | (m[1:, 1] != m[:-1, 1]))
    for part in (np.flatnonzero(lead), np.flatnonzero(~lead)):
        done = np.array([best.get((r, i), (1,))[0] == 0 for r, i in m[part, :2].tolist()], bool)
        left = part[~done] if len(part) else part
        for rep in range(len(index.steps)):
            left = left[index.reps[m[left, 1]] > rep]
            for at in range(0, len(left), chunk):
                some = left[at : at + chunk]
                it, length = m[some, 1], m[some, 3]
                wide = np.arange(int(size[it].max()))[None, :]
                words = np.where(wide < length[:, None], flat[np.minimum(m[some, 5][:, None] + wide, len(flat) - 1)], U64(0))
                hit = np.flatnonzero(cgk_keys(words, size[it], index.steps[rep : rep + 1], rep)[0] == index.keys[rep][it])
                for (r, i, s, n), w in zip(m[some[hit], :4].tolist(), hit.tolist()):
                    d = edit_distance(index.words[i], words[w, :n], int(index.edits[i]))
                    if d <= index.edits[i]:
                        best[r, i] = min(best.get((r, i), (d, s, n)), (d, s, n))
                left[at : at + len(some)][hit] = -1  # verified
            left = left[left >= 0]
    for (r, i), (d, s, n) in sorted(best.items()):
        yield r, i, s, s + n, d


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.99, match: float = 0.45, samples: int = 2, seed: int = 7, most_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, item_id, start_token, end_token, edits): windows of documents within ``rate`` edits a word of a benchmark item.

    Words are runs of letters and digits, in lower case. Of each document and item the closest window is
    given, the first of equal ones. Null ids and null texts, and items without a word, take no part; rows
    that repeat an id or an item are each compared and equal results given once. The items are broadcast;
    over ``most_bytes`` of their text this raises, and the benchmark is to be split.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of benchmark items; leaks() broadcasts {most_bytes} at most: split the benchmark")
    got = sorted((r["item_id"], r["text"]) for r in items.collect())
    shared = spark.sparkContext.broadcast(build_index([g[0] for g in got], [g[1] for g in got], rate, recall, match, samples, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            ids = batch.column(0).to_numpy()
            for r, i, s, e, d in scan(batch.column(1), index):
                for col, x in zip(out, (int(ids[r]), int(index.item_id[i]), s, e, d)):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "item_id", "start_token", "end_token", "edits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, _SCHEMA).distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds nothing, with their own columns."""
    found = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_lexloom_id")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == F.col("_lexloom_id"), "left_anti")
