"""Operator 3: bounded-space online packing of documents into training windows.

Each partition keeps a fixed number of open windows. A document goes where it fits best; if it fits
nowhere and all windows are in use, the fullest is emitted. The windows still open at the end of the
partitions are merged, best fit first, by a second pass that runs on as many tasks as they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

_ITEMS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
_RAW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("open", pa.bool_()), ("used", pa.int64()), ("items", _ITEMS)])
SCHEMA = "window_id string, used long, n_docs int, items array<struct<doc_id:long,start:long,length:long>>"


class OpenWindows:
    """At most ``limit`` open windows of ``capacity`` tokens; ``place`` returns the windows that this closes."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit, self.open = capacity, limit, []

    def place(self, size: int, items: list) -> list[tuple[int, list]]:
        best = None
        for k, (used, _) in enumerate(self.open):  # the oldest of the fullest that still fit
            if used + size <= self.capacity and (best is None or used > self.open[best][0]):
                best = k
        out = []
        if best is None:
            if len(self.open) >= self.limit:
                full = max(range(len(self.open)), key=lambda k: (self.open[k][0], -k))
                out.append(self.open.pop(full))
            self.open.append((size, list(items)))
            best = len(self.open) - 1
        else:
            used, old = self.open[best]
            old.extend(items)
            self.open[best] = (used + size, old)
        if self.open[best][0] == self.capacity:
            out.append(self.open.pop(best))
        return out


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "open", "used", "items"), r)) for r in rows], schema=_RAW)


def pack_stream(batches: Iterator[pa.RecordBatch], part: int, capacity: int, limit: int) -> Iterator[pa.RecordBatch]:
    bins, rows, seq = OpenWindows(capacity, limit), [], 0
    item = lambda d, s, n: {"doc_id": d, "start": s, "length": n}
    for batch in batches:
        for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = 0
            while n - at >= capacity:  # whole windows of a long document
                rows.append((part, seq, False, capacity, [item(doc, at, capacity)]))
                seq, at = seq + 1, at + capacity
            if n > at:
                for used, items in bins.place(n - at, [item(doc, at, n - at)]):
                    rows.append((part, seq, False, used, items))
                    seq += 1
            if len(rows) >= 2000:
                yield _emit(rows)
                rows = []
    for used, items in bins.open:
        rows.append((part, seq, True, used, items))
        seq += 1
    yield _emit(rows)


def merge_leftovers(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Closed windows pass; the open ones of the task are merged, the fullest first, each into the fullest that it fits into."""
    left: list[tuple[int, int, int, list]] = []
    names = ["window_id", "used", "n_docs", "items"]
    done = lambda w, u, i: {"window_id": w, "used": u, "n_docs": len(i), "items": i}
    schema = pa.schema([("window_id", pa.string()), ("used", pa.int64()), ("n_docs", pa.int32()), ("items", _ITEMS)])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["open"]:
                left.append((-r["used"], r["part"], r["seq"], r["items"]))
            else:
                out.append(done(f"{r['part']}-{r['seq']}", r["used"], r["items"]))
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    by_room: dict[int, list] = {}
    for minus, part, seq, items in sorted(left, key=lambda x: x[:3]):
        size = -minus
        room = next((n for n in range(size, capacity + 1) if by_room.get(n)), None)
        if room is None:
            entry = [f"{part}-{seq}m", size, list(items)]
        else:
            entry = by_room[room].pop()
            entry[1] += size
            entry[2].extend(items)
        by_room.setdefault(capacity - entry[1], []).append(entry)
    rest = [done(*e) for n in sorted(by_room) for e in by_room[n]]
    assert all(set(r) == set(names) for r in rest)
    yield pa.RecordBatch.from_pylist(rest, schema=schema)


def pack(docs: DataFrame, capacity: int = 2048, open_windows: int = 32, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, merge_rows: int = 4096) -> DataFrame:
    """(window_id, used, n_docs, items): windows of at most ``capacity`` tokens; items list (doc_id, start, length) in tokens.

    Lengths are ``length_col`` or else the number of runs of visible characters in the text. A longer
    document fills whole windows with its head and its rest is placed like any other. Documents of null
    or no length, or of null id, take no part; a repeated row is placed again; other columns are not
    read. The result depends on how the rows are partitioned; that every token is placed once and no
    window overfull does not.
    """
    n = F.col(length_col).cast("long") if length_col else F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n")).where("doc_id IS NOT NULL AND n > 0")
    raw = sizes.mapInArrow(lambda it: pack_stream(it, TaskContext.get().partitionId(), capacity, open_windows), "part int, seq long, open boolean, used long, items array<struct<doc_id:long,start:long,length:long>>")
    # Open windows of about merge_rows / open_windows neighbouring partitions meet in one task; closed ones spread.
    group = F.when(F.col("open"), F.floor(F.col("part") / F.lit(max(1, merge_rows // open_windows))) * -1 - 1).otherwise(F.xxhash64("part", "seq"))
    return raw.withColumn("group", group).repartition("group").drop("group").mapInArrow(lambda it: merge_leftovers(it, capacity), SCHEMA)
