"""Operator 1: token counts by batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .kernels import buffers

#: The pre-tokenisation pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a text without white space may be cut: a run of letters or of digits ends there in any context.
_TURN = regex.compile(r"(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_encoders: dict[str, Callable[[list[str]], list[int]]] = {}


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """texts -> lengths for a ``.tiktoken`` rank file, by the encoder's call for a batch; loaded once in a worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary_batch
        _encoders[path] = lambda texts: [len(x) for x in encode(texts, num_threads=1)]  # a task has one core
    return _encoders[path]


def _after_blank(d: np.ndarray) -> np.ndarray:
    """Whether each byte ends a white space character, of those beyond ASCII too."""
    out = _BLANK[d]
    if len(d) and d.max() > 127:
        a, b = np.append(0, d[:-1]), np.concatenate([[0, 0], d[:-2]])[: len(d)]
        low = (d >= 0x80) & (d <= 0x8A)
        out |= (a == 0xC2) & ((d == 0x85) | (d == 0xA0)) | (b == 0xE1) & (a == 0x9A) & (d == 0x80) | (b == 0xE3) & (a == 0x80) & (d == 0x80)
        out |= (b == 0xE2) & ((a == 0x80) & (low | (d == 0xA8) | (d == 0xA9) | (d == 0xAF)) | (a == 0x81) & (d == 0x9F))
    return out


def safe_cuts(raw: bytes, most: int) -> list[int]:
    """Byte offsets at which a long text is cut into pieces of about ``most`` bytes without changing its tokens.

    A cut is made before white space that follows anything else, in any script: no pre-token reaches from
    a visible character into white space, and the pattern looks at nothing behind it, so the counts of the pieces add
    up to that of the text. Where no white space follows within ``most`` bytes more, the end of a run of letters or
    digits serves; where there is none of these either, the piece is longer.
    """
    data = np.frombuffer(raw, np.uint8)
    ok = np.flatnonzero(_BLANK[data[1:]] & ~_after_blank(data)[:-1]) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    cuts, at = [0], 0
    while len(raw) - at > most:
        k = int(np.searchsorted(ok, at + most))
        end = int(ok[k]) if k < len(ok) else len(raw)
        if end - at > 2 * most:
            # The text from the last whole character at or before the earliest place on.
            begin = at + most
            while begin > at and data[begin] & 0xC0 == 0x80:
                begin -= 1
            lead = begin - 1
            while lead > at and data[lead] & 0xC0 == 0x80:
                lead -= 1
            part = raw[lead:end].decode("utf-8")
            turn = next((m.start() for m in _TURN.finditer(part) if m.start()), None)
            end = lead + len(part[:turn].encode()) if turn else end
        if end >= len(raw):
            break
        at = end
        cuts.append(at)
    return [*cuts, len(raw)]


def count_texts(texts: pa.Array, path: str, batch_bytes: int = 1 << 20, split_bytes: int = 1 << 16) -> np.ndarray:
    """Lengths in tokens of a column of texts, encoded in calls of about ``batch_bytes`` bytes each; 0 for null."""
    lengths = encoder(path)
    data, at = buffers(texts)
    raw = data.tobytes()
    totals = np.zeros(len(texts), np.int64)
    pieces: list[str] = []
    owner: list[int] = []
    held = 0
    for r in range(len(texts)):
        lo, hi = int(at[r]), int(at[r + 1])
        cuts = safe_cuts(raw[lo:hi], split_bytes) if hi - lo > split_bytes else [0, hi - lo]
        for a, b in zip(cuts, cuts[1:]):
            pieces.append(raw[lo + a : lo + b].decode("utf-8"))
            owner.append(r)
            held += b - a
            if held >= batch_bytes:
                np.add.at(totals, owner, lengths(pieces))
                pieces, owner, held = [], [], 0
    if pieces:
        np.add.at(totals, owner, lengths(pieces))
    return totals


def count_batches(batches: Iterator[pa.RecordBatch], path: str, batch_bytes: int, split_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mask = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count_texts(batch.column(1), path, batch_bytes, split_bytes), pa.int64(), mask=mask)], names=["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, split_bytes: int = 1 << 16) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``.

    ``tokenizer`` is the path of a rank file that all executors can read. Ids are integers. A null text has a
    null count, an empty one 0; a null id stays null; repeated rows are counted each; other columns, whatever
    their names, are not read. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: count_batches(it, tokenizer, batch_bytes, split_bytes), "doc_id long, n_tokens long")
