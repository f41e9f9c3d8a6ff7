"""Operator 2: exact top-k search by columnar branch-and-bound.

Vectors are kept in vertical layout, one contiguous block of dimensions after the other. Distances are
accumulated block by block. What the remaining dimensions can still add lies between (|q|-|x|)^2 and
(|q|+|x|)^2 of the remaining masses; candidates whose lower bound exceeds the k-th least upper bound
are dropped, and the survivors are compacted before the next block.

The queries meet the rows in blocks. One block of rows gives each query a first bound of its k-th distance,
and every block that a task has searched tightens it for the blocks after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .storage import durable

_SCHEMA = "query_id long, neighbor_id long, d2 double"


def search_block(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact k nearest rows of x (squared Euclidean, ties by id, never the query's own id) for each row of q, of those not beyond the query's ``bound``; tightens ``bound`` in place."""
    dims = q.shape[1]
    edges = [*range(0, dims, width), dims]
    blocks = [np.ascontiguousarray(x[:, a:b].T) for a, b in zip(edges, edges[1:])]
    qleft = np.sqrt(np.maximum(np.cumsum((q * q)[:, ::-1], axis=1)[:, ::-1], 0))
    xleft = np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0))
    xrest = [np.ascontiguousarray(xleft[:, b]) if b < dims else np.zeros(len(x)) for b in edges[1:]]
    xsq = [np.einsum("ij,ij->j", blk, blk) for blk in blocks]
    out_q, out_x, out_d = [], [], []
    for lo in range(0, len(q), 64):
        batch = q[lo : lo + 64]
        b = edges[1]
        first = (batch[:, :b] * batch[:, :b]).sum(1)[:, None] + xsq[0] - 2.0 * batch[:, :b] @ blocks[0]
        for r in range(len(batch)):
            v, i = batch[r], lo + r
            alive, part = None, first[r]
            for j in range(len(blocks)):
                a, b = edges[j], edges[j + 1]
                if j:
                    blk = blocks[j] if alive is None else blocks[j][:, alive]
                    part = part + (v[a:b] @ v[a:b] + (xsq[j] if alive is None else xsq[j][alive]) - 2.0 * (v[a:b] @ blk))
                rest_q = qleft[i, b] if b < dims else 0.0
                rest_x = xrest[j] if alive is None else xrest[j][alive]
                n = len(part)
                limit = bound[i]
                if n > k + 1:
                    upper = part + (rest_q + rest_x) ** 2
                    limit = min(limit, np.partition(upper, k)[k])  # of k+1, as the query itself may be among them
                if not np.isfinite(limit):
                    continue
                keep = part + (rest_q - rest_x) ** 2 <= limit + 1e-9 * (1.0 + abs(limit))
                left = int(np.count_nonzero(keep))
                if left < 0.7 * n:  # compact
                    chosen = np.flatnonzero(keep)
                    alive = chosen if alive is None else alive[chosen]
                    part = part[chosen]
            alive = np.arange(len(x)) if alive is None else alive
            alive = alive[xid[alive] != qid[i]]
            diff = x[alive] - v
            d = np.einsum("ij,ij->i", diff, diff)
            best = np.lexsort((xid[alive], d))[:k]
            if len(best) == k:
                bound[i] = min(bound[i], d[best[-1]])
            out_q.append(np.full(len(best), qid[i]))
            out_x.append(xid[alive][best])
            out_d.append(d[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(out_q, np.int64), join(out_x, np.int64), join(out_d, np.float64)


def _unpack(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float32).reshape(-1, dims).astype(np.float64)


def _seed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries (dims, ids, vectors), each beside a block of rows, to the same with the bounds that those rows give."""
    for batch in batches:
        for dims, qid, q, xid, x in zip(*(c.to_pylist() for c in batch.columns)):
            bound = np.full(len(qid) // 8, np.inf)
            search_block(*_unpack(qid, q, dims), *_unpack(xid, x, dims), k, bound)
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([qid]), pa.array([q]), pa.array([bound.tobytes()])], names=["dims", "qids", "qs", "bounds"])


def _pairs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, np.ndarray] = {}  # the bounds of the last block of queries, as this task has tightened them
    for batch in batches:
        for dims, qid, q, bounds, other, xid, x in zip(*(c.to_pylist() for c in batch.columns)):
            if dims != other:
                continue
            if qid not in held:
                held = {qid: np.frombuffer(bounds).copy()}
            found = search_block(*_unpack(qid, q, dims), *_unpack(xid, x, dims), k, held[qid])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "neighbor_id", "d2"])


def _pack(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """(block, dims, id, v) to one row for each block and length: the ids and the float32 vectors, and those of the queries. Of rows that repeat an id the least vector, by its elements in turn, stays."""
    held: dict[tuple[int, int], dict[int, bytes]] = {}
    for batch in batches:
        dims, block, ids = (batch.column(c).to_numpy() for c in (1, 0, 2))
        flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        at = np.concatenate([[0], np.cumsum(dims)])
        for r, (b, n, i) in enumerate(zip(block.tolist(), dims.tolist(), ids.tolist())):
            v, one = flat[at[r] : at[r + 1]], held.setdefault((b, n), {})
            if i not in one or v.tolist() < np.frombuffer(one[i], np.float32).tolist():
                one[i] = v.tobytes()
    for (b, n), one in held.items():
        ids = np.array(list(one), np.int64)
        asks = [i for i in one if i % every == 0]
        row = [b, n, ids.tobytes(), b"".join(one.values()), np.array(asks, np.int64).tobytes(), b"".join(one[i] for i in asks)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.int32(), *[pa.binary()] * 4])], names=["block", "dims", "ids", "vectors", "qids", "qs"])


def _gather(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Small blocks of queries to blocks of about ``most`` bytes of vectors."""
    held: dict[int, tuple[list[bytes], list[bytes]]] = {}

    def take(dims: int) -> pa.RecordBatch:
        ids, vectors = held.pop(dims)
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([b"".join(ids)]), pa.array([b"".join(vectors)])], names=["dims", "qids", "qs"])

    for batch in batches:
        for dims, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
            one = held.setdefault(dims, ([], []))
            one[0].append(ids)
            one[1].append(vectors)
            if sum(map(len, one[1])) >= most:
                yield take(dims)
    for dims in list(held):
        yield take(dims)


def topk_search(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096, every: int = 50) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the exact k nearest rows of each row whose id ``every`` divides, itself left out; 1 asks for all.

    Euclidean distance; ties go to the lower id. Ids are integers. Vectors are searched among those of their own length.
    Rows with a null id, a null or empty vector, or a null, NaN or infinite element take no part. Of rows that
    repeat an id (and a length) the least vector counts, compared element by element. A row with fewer than k
    others of its length has fewer ranks; an empty table gives an empty one. Other columns are not read.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dims"), "id", "v")
    packed = durable(rows.repartition(blocks, "block").mapInArrow(lambda it: _pack(it, every), "block int, dims int, ids binary, vectors binary, qids binary, qs binary"), "blocks")
    asked = packed.where(F.length("qids") > 0).select("dims", "qids", "qs").coalesce(max(1, blocks // every)).mapInArrow(lambda it: _gather(it, 1 << 20), "dims int, qids binary, qs binary")
    some = packed.groupBy("dims").agg(F.min_by(F.struct("ids", "vectors"), F.struct(-F.length("ids"), "block")).alias("x")).select(F.col("dims").alias("n"), "x.*")
    some = F.broadcast(some) if packed.select("dims").distinct().count() <= 64 else some  # a block of each length
    seeded = durable(asked.join(some, F.col("dims") == F.col("n")).select("dims", "qids", "qs", "ids", "vectors").mapInArrow(lambda it: _seed(it, k), "dims int, qids binary, qs binary, bounds binary"), "queries")
    # Blocks of a stated set of queries against all blocks. Lengths are compared in the task: as a join on them, one length would be one task.
    met = seeded.crossJoin(packed.select(F.col("dims").alias("n"), "ids", "vectors")).select("dims", "qids", "qs", "bounds", "n", "ids", "vectors")
    found = met.mapInArrow(lambda it: _pairs(it, k), _SCHEMA)
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("d2", "neighbor_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "neighbor_id", F.sqrt("d2").alias("distance"))
