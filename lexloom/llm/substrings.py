"""Operator 6: exact substring deduplication.

Every window of ``width`` tokens has a Rabin-Karp hash. Consecutive windows whose least inner
``inner``-gram hash is the same form a run; equal windows have equal inner hashes, so one shuffle of
the runs by that hash brings all equal windows together, where they are counted. Of each repeated
window the first occurrence, by (doc_id, position), stays; the tokens of the others merge into maximal
removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import SPACE, Tokens, binary_array, buffers, slices, sliding_min, tokenise, windows

_RUN = "anchor long, doc_id long, start int, codes binary"
_HIT = "doc_id long, s int, e int, first boolean"
_CUT = "doc_id long, start_token int, end_token int, action string"
_LONGEST = 4096


def _runs(batches: Iterator[pa.RecordBatch], width: int, inner: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to runs: the anchor, the first window and the 32-bit window hashes."""
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            tok = tokenise(part.column(1), SPACE)
            at, h = windows(tok, width)
            if not len(at):
                continue
            _, small = windows(Tokens(tok.data, tok.row_at, tok.starts, tok.ends, np.array([0, len(tok.hashes)]), tok.hashes), inner)
            anchor = sliding_min(small, width - inner + 1)[at]
            row = tok.rows()[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            begin = np.flatnonzero(since % _LONGEST == 0)
            edges = np.append(begin, len(at))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[begin].view(np.int64)), pa.array(ids[row[begin]]), pa.array((at - tok.first[:-1][row])[begin].astype(np.int32)), binary_array((h >> np.uint64(32)).astype(np.uint32), edges)],
                names=["anchor", "doc_id", "start", "codes"],
            )


def _count(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs in the order (anchor, doc_id, start) to spans of repeated windows, apart for first occurrences and others.

    Only the runs of one anchor are held across batches, and of those only distinct windows: the place of the
    first occurrence of each, until a second one is seen.
    """
    names = ["doc_id", "s", "e", "first"]
    anchor, seen = None, {}  # window -> (doc_id, position) of its first occurrence, or None once that was reported

    def spans(doc: np.ndarray, pos: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        """Windows to maximal spans of adjoining windows of a document."""
        order = np.lexsort((pos, doc, first))
        doc, pos, first = doc[order], pos[order], first[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (pos[1:] > pos[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(doc)) - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(pos[begin].astype(np.int32)), pa.array((pos[end[: len(begin)]] + width).astype(np.int32)), pa.array(first[begin])], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        anchors = batch.column(0).to_numpy()
        raw, at = buffers(batch.column(3).cast(pa.large_binary()))
        codes, at = np.frombuffer(np.ascontiguousarray(raw).tobytes(), np.uint32), at // 4
        lens = np.diff(at)
        group = np.zeros(len(anchors), np.int64)
        group[1:] = np.cumsum(anchors[1:] != anchors[:-1])
        docs = np.repeat(batch.column(1).to_numpy(), lens)
        pos = np.repeat(batch.column(2).to_numpy().astype(np.int64), lens) + np.arange(len(codes)) - np.repeat(at[:-1], lens)
        key = (np.repeat(group, lens).astype(np.uint64) << np.uint64(32)) | codes
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        head = np.ones(len(key), bool)
        head[1:] = sorted_key[1:] != sorted_key[:-1]
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(key)))
        repeated = np.zeros(len(key), bool)
        repeated[order] = np.repeat(size > 1, size)
        first = np.zeros(len(key), bool)
        first[order[begin]] = True
        extra: list[tuple[int, int]] = []
        # The group that began in an earlier batch: windows seen there are neither new nor single here.
        if anchors[0] == anchor:
            for i in np.flatnonzero(np.repeat(group, lens) == 0).tolist():
                c = int(codes[i])
                if c in seen:
                    if seen[c] is not None:
                        extra.append(seen[c])
                        seen[c] = None
                    repeated[i], first[i] = True, False
        else:
            seen = {}
        if anchors[0] != anchors[-1]:
            seen = {}
        # The group that may go on in the next batch.
        anchor = anchors[-1]
        last = int(group[-1])
        for i in np.flatnonzero(first & (np.repeat(group, lens) == last)).tolist():
            seen.setdefault(int(codes[i]), None if repeated[i] else (int(docs[i]), int(pos[i])))
        d = np.concatenate([docs[repeated], np.array([x[0] for x in extra], np.int64)])
        p = np.concatenate([pos[repeated], np.array([x[1] for x in extra], np.int64)])
        yield spans(d, p, np.concatenate([first[repeated], np.ones(len(extra), bool)]))


def merge_spans(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(s, e)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def subtract(whole: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, k = [], 0
    for a, b in whole:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < b:
            if taken[j][0] > a:
                out.append((a, taken[j][0]))
            a = max(a, taken[j][1])
            j += 1
        if a < b:
            out.append((a, b))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = spans.values
            s, e, first = (v.field(k).to_pylist() for k in range(3))
            keep = merge_spans([x for x, f in zip(s, first) if f], [x for x, f in zip(e, first) if f])
            drop = subtract(merge_spans([x for x, f in zip(s, first) if not f], [x for x, f in zip(e, first) if not f]), keep)
            for what, found in (("keep", keep), ("remove", drop)):
                for a, b in found:
                    for col, x in zip(out, (doc, a, b, what)):
                        col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], names=["doc_id", "start_token", "end_token", "action"])


def repeated_spans(docs: DataFrame, width: int = 50, inner: int = 12) -> DataFrame:
    """(doc_id, start_token, end_token, action): where passages of ``width`` tokens or more repeat.

    Tokens are runs of characters other than ASCII white space. A passage repeats if it stands at two
    places of one document or of two. ``keep`` marks the first occurrence, in the order of (doc_id,
    position), and ``remove`` the maximal intervals to cut; they never overlap. Rows with a null id or
    text and texts of fewer than ``width`` tokens give none. Rows that repeat an id share their
    positions, so nothing is cut of exact repeats. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = rows.mapInArrow(lambda it: _runs(it, width, inner), _RUN)
    runs = runs.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    hits = runs.mapInArrow(lambda it: _count(it, width), _HIT)
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "first")).alias("spans")).mapInArrow(_merge, _CUT)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index("text")
        texts, cuts = batch.column(k), batch.column(batch.num_columns - 1)
        out = texts.to_pylist()
        for r in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)).tolist():
            if out[r] is None:
                continue
            tok = tokenise(texts.slice(r, 1), SPACE)
            raw, parts, at = out[r].encode(), [], 0
            v = cuts[r].values
            for a, b in sorted(zip(v.field(0).to_pylist(), v.field(1).to_pylist())):
                if a >= len(tok.starts):
                    continue
                parts.append(raw[at : tok.starts[a]])
                at = int(tok.starts[b]) if b < len(tok.starts) else len(raw)
            text = b"".join([*parts, raw[at:]]).decode()
            out[r] = text if b < len(tok.starts) else text.rstrip()
        columns = [pa.array(out, batch.schema.field(k).type) if c == k else batch.column(c) for c in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(c) for c in range(batch.num_columns - 1)]))


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with the removal intervals cut from their texts, and ``n_chars`` counted anew where there is such a column.

    Documents of which only white space is left are dropped if something was cut from them; all others,
    null ids and texts too, stay as they are.
    """
    spans = repeated_spans(docs, width).where("action = 'remove'").groupBy("doc_id").agg(F.collect_list(F.struct("start_token", "end_token")).alias("_lexloom_cuts"))
    both = docs.join(spans.withColumnRenamed("doc_id", "_lexloom_id"), docs["doc_id"].cast("long") == F.col("_lexloom_id"), "left").drop("_lexloom_id")
    touched = both.withColumn("_lexloom_hit", F.col("_lexloom_cuts").isNotNull()).select(*docs.columns, "_lexloom_hit", "_lexloom_cuts")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    done = touched.mapInArrow(_cut, fields + ", _lexloom_hit boolean").where(r"NOT _lexloom_hit OR text RLIKE '[^ \\t\\n\\x0B\\f\\r]'").drop("_lexloom_hit")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), "n_chars"))
    return done


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM t WHERE len(w) >= 50)),
rep AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) = 1 AS first FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
tok AS (SELECT doc_id, q, max(first::INT) AS kept FROM (SELECT doc_id, first, unnest(range(p, p + 50)) AS q FROM rep) GROUP BY ALL),
isl AS (SELECT doc_id, kept, q, q - row_number() OVER (PARTITION BY doc_id, kept ORDER BY q) AS g FROM tok)
SELECT doc_id, CAST(min(q) - 1 AS INT) AS start_token, CAST(max(q) AS INT) AS end_token, CASE WHEN kept = 1 THEN 'keep' ELSE 'remove' END AS action FROM isl GROUP BY doc_id, kept, g
"""
