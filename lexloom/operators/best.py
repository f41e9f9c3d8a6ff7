"""The k best rows of each of a block of queries, kept in numpy while rows go by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LAST = np.iinfo(np.int64).max


class Best:
    """For each of n queries k (score, seq), by score from the greatest and then by seq; rows whose score isn't finite are left out."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.seq = k, np.full((n, k), -np.inf), np.full((n, k), _LAST)
        self.raw = np.full((n, k), -np.inf)

    @property
    def least(self) -> np.ndarray:
        """The score that a row must reach, -inf where there are fewer than k yet."""
        return self.score[:, -1]

    def add(self, j: np.ndarray, seq: np.ndarray, score: np.ndarray, raw: np.ndarray | None = None) -> None:
        """Rows ``seq`` for the queries numbered ``j``; ``raw`` are the scores before they were rounded."""
        raw = score if raw is None else raw
        real = np.isfinite(score) & (score >= self.least[j])
        j, seq, score, raw = j[real], seq[real], score[real], raw[real]
        if not len(j):
            return
        hit = np.unique(j)
        all_j = np.concatenate([np.repeat(hit, self.k), j])
        parts = [np.concatenate([kept[hit].ravel(), new]) for kept, new in ((self.score, score), (self.seq, seq), (self.raw, raw))]
        order = np.lexsort((parts[1], -parts[0], all_j))
        first = np.searchsorted(all_j[order], hit)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        top = order[place < self.k]
        for kept, part in zip((self.score, self.seq, self.raw), parts):
            kept[hit] = part[top].reshape(-1, self.k)

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        """(qid, seq, score), with the scores as they were before they were rounded."""
        real = np.isfinite(self.score)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1))), pa.array(self.seq[real]), pa.array(self.raw[real])], names=["qid", "seq", "score"])
