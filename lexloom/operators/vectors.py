"""Exact vector search: blocks of queries against blocks of rows, by matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import VectorStoreError
from .best import Best
from .keyword import top_k

#: Queries whose vectors are broadcast; more are taken in blocks of QUERIES, each against partitions of about ROWS_BYTES of rows.
BLOCK = 4096
QUERIES = 8192
ROWS_BYTES = 64 << 20
#: Rows scored at once, against a sixteenth as many queries.
TILE = 8192


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine (with 1e-12 added to each length), dot, or euclidean as 1 / (1 + distance)."""
    if metric == "cosine":
        return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return 1 / (1 + norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))))
    raise VectorStoreError(f"unknown metric {metric!r}")


class _Asked:
    """A block of queries and the k best rows of each so far.

    A tile of rows is scored by one product, in single precision where the numbers allow it. What may be among the k best by
    the bound of that product's error is scored again in double precision, so results are those of double precision.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, digits: int | None, skip_self: bool) -> None:
        if metric not in ("cosine", "dot", "euclidean"):
            raise VectorStoreError(f"unknown metric {metric!r}")
        self.metric, self.digits, self.skip_self = metric, digits, skip_self
        real = np.isfinite(q).all(1)
        self.ids, q = ids[real], q[real].astype(np.float64)
        self.q = self._unit(q)
        self.norm = np.linalg.norm(self.q, axis=1)
        self.best = Best(len(self.ids), k)

    def _unit(self, v: np.ndarray) -> np.ndarray:
        return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12) if self.metric == "cosine" else v

    def add(self, seq: np.ndarray, x: np.ndarray) -> None:
        if not len(self.ids) or not len(seq):
            return
        if x.shape[1] != self.q.shape[1]:
            raise VectorStoreError(f"vectors of the rows do not have the {self.q.shape[1]} elements of the queries'")
        for at in range(0, len(seq), TILE):
            part = x[at : at + TILE]
            real = np.isfinite(part).all(1)
            self._tile(seq[at : at + TILE][real], self._unit(part[real].astype(np.float64)))

    def _tile(self, seq: np.ndarray, x: np.ndarray) -> None:
        if not len(seq):
            return
        longest = np.linalg.norm(x, axis=1).max()
        kind = np.float32 if max(longest, self.norm.max()) < 1e15 else np.float64
        flat = self.metric == "euclidean"
        rows = (np.column_stack([x, -0.5 * (x * x).sum(1)]) if flat else x).astype(kind).T
        for lo in range(0, len(self.ids), TILE // 16):
            q, norm = self.q[lo : lo + TILE // 16], self.norm[lo : lo + TILE // 16]
            g = (np.column_stack([q, np.ones(len(q))]) if flat else q).astype(kind) @ rows
            error = (x.shape[1] + 8) * (np.finfo(kind).eps * (norm * longest + longest * longest * flat) + 1e-12 * norm * norm * flat) + 1e-30
            least = self.best.least[lo : lo + len(q)].copy()
            open_ = np.flatnonzero(least == -np.inf)
            at_least = self.best.k + self.skip_self  # of which one may be the query itself
            if len(open_) and min(len(seq), TILE // 4) >= at_least:
                some = g[open_, : TILE // 4]
                some = np.where(np.isfinite(some), some, -np.inf)
                kth = np.partition(some, some.shape[1] - at_least, axis=1)[:, some.shape[1] - at_least].astype(np.float64)
                least[open_] = self._score(kth - error[open_], norm[open_]) - self._half()
            limit = self._limit(least, norm) - error
            low = np.nextafter(limit.astype(kind), kind(-np.inf))
            found = np.flatnonzero(g >= low[:, None])
            for a in range(0, len(found), 1 << 16):
                j, i = np.divmod(found[a : a + (1 << 16)], len(seq))
                self._add(j + lo, i, seq, x)

    def _half(self) -> float:
        """How far rounding may lift or lower a score."""
        return 0.0 if self.digits is None else 0.5001 * 10.0**-self.digits

    def _score(self, g: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.sqrt(np.maximum(norm * norm - 2 * g, 0))) if self.metric == "euclidean" else g

    def _limit(self, score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The least product of a row whose score, once rounded, may reach ``score``."""
        s = score - self._half() - 1e-12 * (1 + np.abs(np.where(np.isfinite(score), score, 0)))
        if self.metric != "euclidean":
            return s
        far = np.where(s > 0, 1 / np.where(s > 0, s, 1) - 1, np.inf)
        return (norm * norm - np.maximum(far, 0) ** 2) / 2

    def _add(self, j: np.ndarray, i: np.ndarray, seq: np.ndarray, x: np.ndarray) -> None:
        if self.skip_self:
            other = seq[i] != self.ids[j]
            j, i = j[other], i[other]
        if self.metric == "euclidean":
            d = x[i] - self.q[j]
            s = 1 / (1 + np.sqrt(np.einsum("ij,ij->i", d, d)))
        else:
            s = np.einsum("ij,ij->i", x[i], self.q[j])
        self.best.add(j, seq[i], s if self.digits is None else np.round(s, self.digits))

    def batch(self) -> pa.RecordBatch:
        return self.best.batch(self.ids)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dims:
        raise VectorStoreError(f"vectors of the rows do not have the {dims} elements of the queries'")
    return flat.reshape(len(column), dims)


def _pack(batches: Iterator[pa.RecordBatch], dims: int, most: int) -> Iterator[pa.RecordBatch]:
    """(id, vector) to rows (ids, vectors) of ``most`` vectors each."""
    ids, vectors, held = [], [], 0

    def take() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(ids)]), pa.array([b"".join(vectors)])], names=["ids", "vectors"])

    for batch in batches:
        m, seq = _matrix(batch.column(1), dims), batch.column(0).to_numpy()
        for at in range(0, len(seq), most):
            part = seq[at : at + most]
            if held + len(part) > most:
                yield take()
                ids, vectors, held = [], [], 0
            ids.append(part.tobytes())
            vectors.append(m[at : at + most].tobytes())
            held += len(part)
    if held:
        yield take()


def _blocks(rows: DataFrame, queries: DataFrame, make: Callable[[np.ndarray, np.ndarray], _Asked], kind: type) -> DataFrame:
    """Blocks of queries against partitions of rows: a task has one of each, so neither side is ever in one place."""
    n, (m, dims) = rows.count(), queries.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = max(1, -(-n * dims * np.dtype(kind).itemsize // ROWS_BYTES))
    blocks = max(-(-m // QUERIES), min(-(-4 * rows.sparkSession.sparkContext.defaultParallelism // parts), -(-m // 1024)))
    shape = "ids binary, vectors binary"
    right = rows.repartition(parts, "seq").mapInArrow(lambda it: _pack(it, dims, 2 * QUERIES), shape).toDF("seqs", "rows")
    left = queries.repartition(blocks, "qid").mapInArrow(lambda it: _pack(it, dims, 2 * QUERIES), shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                ids, vectors, seqs, found = (c[r].as_buffer() for c in batch.columns)
                if key is None or not key.equals(ids):
                    if asked is not None:
                        yield asked.batch()
                    key = pa.py_buffer(ids.to_pybytes())
                    asked = make(np.frombuffer(key, np.int64), np.frombuffer(vectors, kind).reshape(-1, dims))
                asked.add(np.frombuffer(seqs, np.int64), np.frombuffer(found, kind).reshape(-1, dims))
        if asked is not None:
            yield asked.batch()

    # The hint keeps a task for each block of queries; a broadcast of them would leave one for each partition of rows.
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, "qid long, seq long, score double")


def vector_search(rows: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", vector: str = "embedding", digits: int | None = None, skip_self: bool = False) -> DataFrame:
    """(qid, seq, score, rank): the k most similar of ``rows`` (seq, vector) for each of ``queries`` (qid, vector), ties by seq.

    Filter ``rows`` first to search among some. Up to ``BLOCK`` queries are broadcast and the rows go by once; more are
    packed in blocks that meet the rows block by block. A task gives k rows a query at most, so what is shuffled
    doesn't grow with the scores computed. Rows without a vector, or with an element that isn't finite, take no part.
    """
    kind = np.float32 if all(dict(df.dtypes)[vector] == "array<float>" for df in (rows, queries)) else np.float64
    cast = F.col(vector).cast("array<float>" if kind is np.float32 else "array<double>").alias("v")
    rows = rows.where(F.col(vector).isNotNull()).select(F.col("seq").cast("long").alias("seq"), cast)
    queries = queries.where(F.col(vector).isNotNull()).select(F.col("qid").cast("long").alias("qid"), cast)
    make = lambda ids, q: _Asked(ids, q, k, metric, digits, skip_self)
    asked = queries.limit(BLOCK + 1).toArrow()
    if asked.num_rows > BLOCK:
        return top_k(_blocks(rows, queries, make, kind), k)
    lists = pa.concat_arrays(asked.column("v").chunks) if asked.num_rows else None
    q = _matrix(lists, lists.value_lengths()[0].as_py()) if asked.num_rows else np.zeros((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast((asked.column("qid").to_numpy(), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        asked = make(ids, q)
        for batch in batches:
            if batch.num_rows and len(ids):
                asked.add(batch.column(0).to_numpy(), _matrix(batch.column(1), q.shape[1]))
        yield asked.batch()

    return top_k(rows.mapInArrow(run, "qid long, seq long, score double"), k)
