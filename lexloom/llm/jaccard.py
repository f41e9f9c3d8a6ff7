"""Operator 9: n-gram Jaccard join by a token-group matrix.

Exact, in five steps, each over all documents:

1. A document can only have a partner if a share ``threshold`` of its n-grams stands in other documents too.
   All n-grams meet in one shuffle, packed by hash range; how many of its n-grams were met goes back to each document.
2. Documents of equal n-gram sets are a class, and one document of each class goes on.
3. Among the classes that are left the n-grams are counted, which orders them from rare to common. Of two sets
   of Jaccard index t, both have a common n-gram among their first n - ceil(t n) + 1. A class belongs to the
   group of the commonest of these first n-grams of its own.
4. The token-group matrix (n-gram, group) says which groups have which first n-grams. A class visits the groups
   that share one with it.
5. At a group, the union of its members' n-grams bounds the overlap with each visitor; for those whose bound
   reaches the threshold the group is opened, and overlaps with all members are counted. Large groups are divided.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .kernels import U64, WORD, binary_array, list_array, mix, shingle_sets, shingles, slices, tokenise
from .storage import drop, durable, side

_SHIP = "bucket long, slice long, own boolean, a binary, b binary, c binary"
_MARK = "doc_id long, k long, n long, alive boolean"
_SETS = "slice long, ks binary, sizes binary, copies binary, tokens binary"
_ASK = "bucket long, slice long, tokens binary"
_REPLY = "slice long, bucket long, codes binary"
_ALIVE = "k long, n long, copies long, gid long, firsts array<long>, shared binary"
_FOUND = "k long, links long, root long"


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(tokenise(texts, WORD), n)


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set of hashes."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U64)).view(np.int64)


def need(sizes: np.ndarray, least: float) -> np.ndarray:
    """How many n-grams a set of each size must share with a partner."""
    return np.ceil(least * sizes - 1e-9).astype(np.int64)


def _common(batches: Iterator[pa.RecordBatch], n: int, least: int) -> Iterator[pa.RecordBatch]:
    """N-grams that stand ``least`` times or more in a slice, with how often."""
    for batch in batches:
        for lo, hi in slices(batch.column(1), 4 << 20):
            _, h = shingles(tokenise(batch.column(1).slice(lo, hi - lo), WORD), n)
            h.sort()
            begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(h)))
            many = size >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[begin[many]].view(np.int64)), pa.array(size[many])], names=["token", "c"])


def common_ngrams(rows: DataFrame, n: int, least: int = 3, most: int = 1 << 16) -> np.ndarray:
    """Common n-grams, ``most`` of them at most. They are taken as met without being shuffled, which can only keep a document that has no partner: they steer the work and never the result."""
    counted = rows.mapInArrow(lambda it: _common(it, n, least), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    top = counted.orderBy(F.desc("c"), "token").limit(most).toArrow().column("token")
    return np.sort(top.to_numpy().view(U64))


class Among:
    """Membership in a sorted array, by a table of bits first."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.bits = values, np.zeros(1 << 20, bool)
        self.bits[(values & U64((1 << 20) - 1)).astype(np.int64)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.bits[(x & U64((1 << 20) - 1)).astype(np.int64)]
        near = np.flatnonzero(out)
        if len(near):
            at = np.minimum(np.searchsorted(self.values, x[near]), len(self.values) - 1)
            out[near] = self.values[at] == x[near]
        return out


def _ship(batches: Iterator[pa.RecordBatch], n: int, common: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each slice of documents (ids, set keys, sizes) and one for each hash range: the hashes and their documents in the slice.

    Documents of hashes are counts of each document where that is shorter, else numbers.
    """
    among, names = Among(common), ["bucket", "slice", "own", "a", "b", "c"]
    empty = pa.array([b""], pa.binary())
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            v, at = _sets(part.column(1), n)
            size, ids = np.diff(at), part.column(0).to_numpy()
            rows = np.repeat(np.arange(hi - lo), size)
            keys, hot = set_keys(v, at), among.has(v)
            name = int.from_bytes(blake2b(ids.tobytes() + keys.tobytes(), digest_size=8).digest(), "little", signed=True)
            v, rows = v[~hot], rows[~hot]
            bucket = (v >> U64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            v, rows, bucket = v[order], rows[order], bucket[order]
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            edges = np.append(begin, len(v))
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - (name & 0xFFFF)], pa.int64()), pa.array([name]), pa.array([True]), pa.array([ids.tobytes()]), pa.array([keys.tobytes()]), pa.array([np.concatenate([size, np.bincount(rows, minlength=hi - lo)]).astype(np.int64).tobytes()])], names=names
            )
            if not len(v):
                continue
            counts = np.zeros(0, np.uint8)
            if hi - lo < 2 * len(v) // len(begin):
                counts = np.bincount(np.repeat(np.arange(len(begin)), np.diff(edges)) * (hi - lo) + rows, minlength=len(begin) * (hi - lo))
            dense = len(counts) > 0 and counts.max() < 256
            whose = binary_array(counts.astype(np.uint8), np.arange(len(begin) + 1) * (hi - lo)) if dense else binary_array(rows.astype(np.uint16), edges)
            blank = empty.take(pa.array(np.zeros(len(begin), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[begin].astype(np.int64)), pa.array(np.full(len(begin), name)), pa.array(np.zeros(len(begin), bool)), binary_array((v >> U64(32 - bits)).astype(np.uint32), edges), whose if dense else blank, blank if dense else whose], names=names
            )


def _by(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows in the order of the given columns, a group at a time."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    yield from ((k, list(g)) for k, g in groupby(rows, key=lambda r: tuple(r[c] for c in columns)))


def _met(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Of the hashes of each range, how many of each document stand in another one; the slices' own rows pass."""
    names = ["slice", "own", "a", "b", "c"]
    held: dict[int, list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(s, False, c.astype(np.uint32).tobytes(), int(t).to_bytes(8, "little"), b"") for s, (c, t) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], names=names)

    for (bucket,), rows in _by(batches, 0):
        if bucket < 0:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in ((1, pa.int64()), (2, pa.bool_()), (3, pa.binary()), (4, pa.binary()), (5, pa.binary()))], names=names)
            continue
        hashes = np.frombuffer(b"".join(r[3] for r in rows), np.uint32)
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(hashes) + 1, bool)
        twice[1:-1] = same
        met = np.zeros(len(hashes), bool)
        met[order] = twice[1:] | twice[:-1]
        at = 0
        for _, name, _, raw, counts, numbers in rows:
            size = len(raw) // 4
            if counts:
                c = np.frombuffer(counts, np.uint8)
                owner = np.repeat(np.arange(len(c)), c)
            else:
                owner = np.frombuffer(numbers, np.uint16)
            c = np.bincount(owner[met[at : at + size]])
            at += size
            one = held.setdefault(name, [np.zeros(0, np.int64), 0])
            long, short = (one[0], c) if len(one[0]) >= len(c) else (c, one[0])
            long[: len(short)] += short
            one[0], one[1] = long, one[1] + size
        if sum(len(c) for c, _ in held.values()) > most:
            yield flush()
    yield flush()


def _mark(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, k, n, alive): whether enough of a document's n-grams were met. Where a slice's counts are not complete, all its documents stay."""
    for _, rows in _by(batches, 0):
        own = next((r for r in rows if r[1]), None)
        if own is None:
            continue
        ids, keys, (size, asked) = np.frombuffer(own[2], np.int64), np.frombuffer(own[3], np.int64), np.frombuffer(own[4], np.int64).reshape(2, -1)
        met, tested = size - asked, 0
        for r in rows:
            if not r[1]:
                c = np.frombuffer(r[2], np.uint32)
                met[: len(c)] += c
                tested += int.from_bytes(r[3], "little")
        alive = (size > 0) & ((met >= need(size, least)) | (tested != asked.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(size), pa.array(alive)], names=["doc_id", "k", "n", "alive"])


def _class_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, k, copies) to slices of classes: the keys, sizes and n-grams of those rows whose set has the key."""
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            v, at = _sets(part.column(1), n)
            right = np.flatnonzero(set_keys(v, at) == part.column(2).to_numpy())
            if not len(right):
                continue
            size = np.diff(at)[right]
            v = np.concatenate([v[at[r] : at[r + 1]] for r in right.tolist()])
            keys, copies = part.column(2).to_numpy()[right], part.column(3).to_numpy()[right]
            name = int.from_bytes(blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x.astype(np.int64).tobytes()]) for x in (keys, size, copies)), pa.array([v.tobytes()])], names=["slice", "ks", "sizes", "copies", "tokens"])


def _in_ranges(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, range of each in that order), the order in which a slice's n-grams are asked for."""
    bucket = (tokens >> U64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _ask(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for (name,), rows in _by(batches, 0):
        tokens = np.frombuffer(rows[0][1], U64)
        order, bucket = _in_ranges(tokens, bits)
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int64)), pa.array(np.full(len(begin), name)), binary_array(tokens[order], np.append(begin, len(tokens)))], names=["bucket", "slice", "tokens"])


def _reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each n-gram, in the order asked, 8 times the binary logarithm of the number of classes that have it, as a byte."""
    for (bucket,), rows in _by(batches, 0):
        rows = list({r[1]: r for r in rows}.values())
        tokens = np.frombuffer(b"".join(r[2] for r in rows), U64)
        order = np.argsort(tokens)
        new = np.flatnonzero(np.append(True, tokens[order][1:] != tokens[order][:-1]))
        many = np.diff(np.append(new, len(tokens)))
        codes = np.zeros(len(tokens), np.uint8)
        codes[order] = np.repeat(np.minimum(255, 8 * np.log2(many)).astype(np.uint8), many)
        at = np.cumsum([0, *(len(r[2]) // 8 for r in rows)])
        yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(np.full(len(rows), bucket)), binary_array(codes, at)], names=["slice", "bucket", "codes"])


def _order(batches: Iterator[pa.RecordBatch], least: float, bits: int) -> Iterator[pa.RecordBatch]:
    """Slices of classes and the replies for them to the classes that can have a partner: group, first n-grams, and those n-grams that other classes have."""
    for _, rows in _by(batches, 0):
        own = next(r for r in rows if r[1] < 0)
        keys, size, copies = (np.frombuffer(own[c], np.int64) for c in (2, 3, 4))
        tokens = np.frombuffer(own[5], U64)
        order, _ = _in_ranges(tokens, bits)
        replies = np.frombuffer(b"".join(raw for _, raw in sorted({r[1]: r[5] for r in rows if r[1] >= 0}.items())), np.uint8)
        if len(replies) != len(tokens):
            raise RuntimeError("a slice of classes has been written twice in different orders")
        codes = np.zeros(len(tokens), np.uint8)
        codes[order] = replies
        row = np.repeat(np.arange(len(keys)), size)
        shared = np.bincount(row, codes > 0, len(keys)).astype(np.int64)
        alive = shared >= need(size, least)
        use = alive[row] & (codes > 0)
        t, c, r = tokens[use], codes[use], row[use]  # still by row and hash
        by = np.lexsort((t, c, r))
        first = np.searchsorted(r, np.arange(len(keys) + 1))
        early = np.arange(len(r)) - first[r] < (size - need(size, least) + 1 - (size - shared))[r]  # n-grams that no other class has come first
        ft, fc, fr = t[by][early], c[by][early], r[by][early]
        best = np.lexsort((ft, -fc.astype(np.int64), fr))
        some, lead = np.unique(fr[best], return_index=True)
        at = np.searchsorted(fr, np.append(some, len(keys)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[some]), pa.array(size[some]), pa.array(copies[some]), pa.array(ft[best][lead].view(np.int64)), list_array(ft.view(np.int64), at, pa.int64()), binary_array(t[np.isin(r, some)], np.append(0, np.cumsum(np.diff(first)[some])))],
            names=["k", "n", "copies", "gid", "firsts", "shared"],
        )


def near_in_group(members: list[np.ndarray], visitors: list[np.ndarray], sizes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) arrays of near pairs: members and visitors are numbered through, j is a member, and of two members i > j.

    ``sizes`` are those of the whole sets; the arrays need only hold the n-grams that another set has.
    """
    m = len(members)
    union, inverse = np.unique(np.concatenate(members), return_inverse=True)
    lengths = np.array([len(x) for x in members])
    owner = np.repeat(np.arange(m), lengths)
    df = np.bincount(inverse, minlength=len(union))
    order = np.argsort(inverse, kind="stable")
    posting, edges = owner[order], np.concatenate([[0], np.cumsum(df)])
    # N-grams of many members are compared as columns of a matrix, the others by their lists.
    wide = np.flatnonzero(df >= max(16, m / 16)) if m >= 32 else np.zeros(0, np.int64)
    column = np.full(len(union), -1)
    column[wide] = np.arange(len(wide))
    matrix = np.zeros((m, len(wide)), np.float32)
    inside = column[inverse] >= 0
    matrix[owner[inside], column[inverse[inside]]] = 1
    probes = [(i, ids) for i, ids in enumerate(np.split(inverse, np.cumsum(lengths)[:-1])) if i]
    for i, q in enumerate(visitors, m):
        at = np.minimum(np.searchsorted(union, q), len(union) - 1)
        at = at[union[at] == q]
        if len(at) >= need(sizes[i : i + 1], least)[0]:  # the union bounds the overlap with any member
            probes.append((i, at))
    step = max(1, min(512, (1 << 22) // max(1, m)))
    for lo in range(0, len(probes), step):
        block = probes[lo : lo + step]
        which = np.array([i for i, _ in block])
        row = np.repeat(np.arange(len(block)), [len(ids) for _, ids in block])
        ids = np.concatenate([ids for _, ids in block])
        dense = column[ids] >= 0
        overlap = np.zeros((len(block), m))
        if len(wide):
            asked = np.zeros((len(block), len(wide)), np.float32)
            asked[row[dense], column[ids[dense]]] = 1
            overlap += asked @ matrix.T
        row, ids = row[~dense], ids[~dense]
        many = df[ids]
        hits = posting[np.repeat(edges[ids] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        overlap += np.bincount(np.repeat(row, many) * m + hits, minlength=len(block) * m).reshape(len(block), m)
        near = overlap >= least * (sizes[which][:, None] + sizes[:m][None, :] - overlap) - 1e-9
        near &= (overlap > 0) & (np.arange(m)[None, :] < which[:, None])
        i, j = np.nonzero(near)
        yield which[i], j


def _open(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(gid, part, home, k, n, copies, shared) in the order of groups to (k, links, root): how many documents of near classes each class met here, and a class that all linked ones have in common."""
    out: list[tuple] = []

    def take() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "links", "root"])

    for _, rows in _by(batches, 0, 1):
        home = {r[3]: r for r in rows if r[2]}
        visits = {r[3]: r for r in rows if not r[2] and r[3] not in home}
        if not home or len(home) + len(visits) < 2:
            continue
        every = [*home.values(), *visits.values()]
        sets = [np.frombuffer(r[6], U64) for r in every]
        keys, sizes, copies = (np.array([r[c] for r in every], np.int64) for c in (3, 4, 5))
        links, label = np.zeros(len(every), np.int64), np.arange(len(every))
        for i, j in near_in_group(sets[: len(home)], sets[len(home) :], sizes, least):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while True:  # join the trees of linked ones
                a, b = label[i], label[j]
                if (a == b).all():
                    break
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
        some = np.flatnonzero(links)
        if len(some):
            out.append((keys[some], links[some], keys[label[some]]))
        if sum(len(x[0]) for x in out) > 50_000:
            yield take()
    yield take()


def components(edges: DataFrame) -> DataFrame:
    """(k, root) of every k of ``edges`` (u, v): one and the same root for all that are linked, by alternating large-star and small-star steps until nothing changes."""
    edges = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large, "large")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        new = durable(small, "edges")
        drop(edges, large)
        edges = new
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    out = durable(edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("k"), "root"), "roots")
    drop(edges)
    return out


def _ranges(spark: SparkSession) -> int:
    """Bits of the hash ranges: eight ranges or more for each shuffle partition, so that a task holds a small part of its share at a time."""
    return min(24, max(4, math.ceil(math.log2(8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def near_classes(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: near and exact copies by the Jaccard index of their n-gram sets.

    Two documents are linked if the index is ``threshold`` or more. ``n_links`` counts the documents that one is
    linked to; documents that hang together over links are a class, named by its least id. Nothing is
    approximate but 64-bit hashes, which stand for n-grams and for sets. N-grams are of words (runs of letters and digits,
    in lower case); a text of fewer words is one n-gram.

    Ids are integers. Null ids take no part; null texts and texts without a word have no link. Rows
    that repeat an id and n-gram set are one document; an id with two texts is two documents, each with a
    row. Other columns are not read; an empty table gives an empty one. The threshold lies above 0.

    A group of more than ``part_tokens`` n-grams is divided, and its parts meet two by two.
    """
    spark, bits = docs.sparkSession, _ranges(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text")).where("doc_id IS NOT NULL")
    shared = spark.sparkContext.broadcast(common_ngrams(rows, n))  # 2**16 hashes at most
    met = rows.mapInArrow(lambda it: _ship(it, n, shared.value, bits), _SHIP).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "slice long, own boolean, a binary, b binary, c binary")
    marked = durable(met.repartition("slice").sortWithinPartitions("slice").mapInArrow(lambda it: _mark(it, threshold), _MARK), "marked")
    classes = durable(marked.where("alive").select("k", "doc_id").distinct().groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    chosen = rows.join(side(classes.select("k", "copies", F.col("rep").alias("doc_id"))), "doc_id").select("doc_id", "text", "k", "copies")
    sets = durable(chosen.mapInArrow(lambda it: _class_sets(it, n), _SETS), "sets")
    replies = sets.select("slice", "tokens").mapInArrow(lambda it: _ask(it, bits), _ASK).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_reply, _REPLY)
    none = F.lit(b"")
    own = sets.select("slice", F.lit(-1).cast("long").alias("bucket"), "ks", "sizes", "copies", "tokens").unionByName(replies.select("slice", "bucket", none.alias("ks"), none.alias("sizes"), none.alias("copies"), F.col("codes").alias("tokens")))
    alive = durable(own.repartition("slice").sortWithinPartitions("slice").mapInArrow(lambda it: _order(it, threshold, bits), _ALIVE), "alive")
    drop(sets)
    # The matrix: which groups have which first n-grams, with the sizes of those members.
    entries = alive.select("k", "n", "gid", F.explode("firsts").alias("token"))
    matrix = entries.groupBy("token", F.col("gid").alias("to")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    hits = entries.join(matrix, "token").where((F.col("gid") < F.col("to")) & (F.col("high") >= threshold * F.col("n")) & (threshold * F.col("low") <= F.col("n")))
    visits = durable(hits.select("k", "to").distinct(), "visits")
    what = ["gid", "home", "k", "n", "copies", "shared"]
    heavy = durable(alive.groupBy("gid").agg(F.sum(F.length("shared") / 8).alias("size")).where(F.col("size") > part_tokens).select("gid", F.ceil(F.col("size") / part_tokens).cast("int").alias("parts")), "heavy")
    guests = alive.join(side(visits), "k").select(F.col("to").alias("gid"), F.lit(False).alias("home"), *what[2:])
    met = alive.select("gid", F.lit(True).alias("home"), *what[2:]).unionByName(guests).join(side(heavy), "gid", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # A member is at home in one part and visits those before it; a guest visits all.
    at = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    met = met.withColumn("at", at).withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("at")).otherwise(F.col("parts") - 1))))
    met = met.withColumn("home", F.col("home") & (F.col("part") == F.col("at"))).select("gid", "part", *what[1:])
    found = durable(met.repartition("gid", "part").sortWithinPartitions("gid", "part").mapInArrow(lambda it: _open(it, threshold), _FOUND), "found")
    drop(alive, visits, heavy)
    roots = components(found.select(F.col("k").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    named = classes.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    first = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    about = durable(named.join(first, "root").join(links, "k", "left").select("k", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    drop(classes, found, roots)
    single = marked.where("NOT alive").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "k").distinct()
    return marked.where("alive").select("doc_id", "k").distinct().join(side(about), "k").select("doc_id", "class_id", "n_links").unionByName(single.drop("k"))


def one_of_each(docs: DataFrame, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """The rows of ``docs`` without those of which another document of the class has a lesser id. Of rows that repeat one id all fare alike; null ids and texts without a word stay."""
    gone = durable(near_classes(docs, threshold, n).where("class_id < doc_id").select(F.col("doc_id").alias("_lexloom_id")).distinct(), "copies")
    return docs.join(side(gone), docs["doc_id"].cast("long") == F.col("_lexloom_id"), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
c AS (SELECT row_number() OVER () AS k, * FROM (SELECT s, min(doc_id) AS rep, count(*) AS copies FROM g WHERE len(s) > 0 GROUP BY s)),
t AS (SELECT k, len(s) AS n, unnest(s) AS t FROM c),
o AS (SELECT a.k AS ka, b.k AS kb FROM t a JOIN t b ON a.t = b.t AND a.k <> b.k GROUP BY ALL HAVING count(*) * 1.0 >= 0.5 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT ka, kb FROM o UNION SELECT reach.ka, o.kb FROM reach JOIN o ON reach.kb = o.ka),
named AS (SELECT c.k, c.s, c.copies - 1 + coalesce((SELECT sum(x.copies) FROM o JOIN c x ON x.k = o.kb WHERE o.ka = c.k), 0) AS n_links, least(c.rep, coalesce((SELECT min(x.rep) FROM reach JOIN c x ON x.k = reach.kb WHERE reach.ka = c.k), c.rep)) AS class_id FROM c)
SELECT g.doc_id, coalesce(named.class_id, g.doc_id) AS class_id, CAST(coalesce(named.n_links, 0) AS BIGINT) AS n_links FROM g LEFT JOIN named ON named.s = g.s
"""
