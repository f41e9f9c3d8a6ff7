"""Operator 4: a Bradley-Terry quality classifier.

Preference pairs (a clean labelled document over a bad one) are scored by a linear function; logistic
loss on the feature differences is minimised, and documents under a quantile of the scores of clean
labelled documents that were not trained on are rejected. Features are shape statistics of the text and
the presence of those words that clearly more documents of one class than of the other have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import SPACE, WORD, binary_array, buffers, slices, tokenise
from .storage import durable

DENSE = 8
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = WORD & ~_DIGIT
_SIGN = ~WORD & SPACE
_LINE = np.zeros(256, bool)
_LINE[10] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense, hashed token ids, their row offsets): shape statistics and the distinct words of each text."""
    data, at = buffers(texts)
    size = np.maximum(np.diff(at).astype(float), 1.0)

    def share(kind: np.ndarray) -> np.ndarray:
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=c[1:])
        return (c[at[1:]] - c[at[:-1]]) / size

    # Words by hash of their lower-cased ASCII letters, so that shouting hides no word.
    low = tokenise(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.where(_UPPER[data], data | 32, data))]), WORD)
    n, rows = low.counts.astype(float), low.rows()
    key = (rows.astype(np.uint64) << np.uint64(32)) | (low.hashes >> np.uint64(32))
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    edges = np.searchsorted(key, np.arange(len(n) + 1).astype(np.uint64) << np.uint64(32))
    distinct = np.diff(edges).astype(float)
    repeated = np.zeros(len(low.hashes) + 2)  # a slice may have no word at all
    if len(low.hashes) > 1:
        repeated[2:-1] = np.cumsum(low.hashes[1:] == low.hashes[:-1])
    twice = repeated[np.maximum(low.first[1:], 1)] - repeated[np.minimum(low.first[:-1] + 1, len(repeated) - 1)]
    some = np.maximum(n, 1.0)
    dense = np.stack([share(_UPPER), share(_DIGIT), share(_SIGN), share(_ALPHA), share(_LINE) * 10, 1 - distinct / some, np.maximum(twice, 0) / some, np.minimum(np.log1p(n), 8) / 8], axis=1)
    return dense, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), edges


@dataclass
class Model:
    words: np.ndarray  # ascending hashes of the words that count
    weights: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float = -np.inf
    held: np.ndarray = field(default_factory=lambda: np.zeros(0))  # scores of the sample's clean rows that were not trained on

    def score(self, texts: pa.Array) -> np.ndarray:
        dense, ids, at = features(texts)
        return self.of(dense, *chosen_words(ids, at, self.words))

    def of(self, dense: np.ndarray, owner: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.bincount(owner, self.weights[which], len(dense)) + np.clip((dense - self.mean) / self.scale, -8, 8) @ self.dense


def chosen_words(ids: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index in ``words``) of the ids that are in ``words``."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = np.zeros(1 << 16, bool)
    table[words & 0xFFFF] = True
    near = np.flatnonzero(table[ids & 0xFFFF])
    which = np.minimum(np.searchsorted(words, ids[near]), len(words) - 1)
    same = words[which] == ids[near]
    return np.searchsorted(at, near[same], side="right") - 1, which[same]


def telling_words(ids: np.ndarray, at: np.ndarray, good: np.ndarray, used: np.ndarray, z: float, most: int) -> np.ndarray:
    """Words whose document shares in the two classes differ by ``z`` standard errors or more; of more than ``most``, the clearest."""
    owner = np.repeat(np.arange(len(good)), np.diff(at))
    up, up_n = np.unique(ids[(good & used)[owner]], return_counts=True)
    down, down_n = np.unique(ids[(~good & used)[owner]], return_counts=True)
    words = np.union1d(up, down)
    a, b = np.zeros(len(words)), np.zeros(len(words))
    a[np.searchsorted(words, up)] = up_n
    b[np.searchsorted(words, down)] = down_n
    n, m = max(1, (good & used).sum()), max(1, (~good & used).sum())
    p = (a + b) / (n + m)
    score = np.abs(a / n - b / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
    clear = np.flatnonzero((score >= z) & (p < 1))
    return np.sort(words[clear[np.argsort(-score[clear], kind="stable")[:most]]])


def fit(dense: np.ndarray, ids: np.ndarray, at: np.ndarray, good: np.ndarray, quantile: float, z: float = 3.5, most: int = 20_000, pairs: int = 40_000, steps: int = 400, l2: float = 1e-5, seed: int = 7) -> Model:
    """Trains on four fifths of the rows and sets the threshold on the clean rows of the rest."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(good)) < 0.2
    words = telling_words(ids, at, good, ~held, z, most)
    m = Model(words, np.zeros(len(words)), np.zeros(DENSE), dense.mean(0) if len(dense) else np.zeros(DENSE), (dense.std(0) if len(dense) else np.zeros(DENSE)) + 1e-6)
    up, down = np.flatnonzero(good & ~held), np.flatnonzero(~good & ~held)
    if not len(up) or not len(down):
        return m
    a, b = rng.choice(up, pairs), rng.choice(down, pairs)
    x = np.clip((dense - m.mean) / m.scale, -8, 8)
    owner, which = chosen_words(ids, at, words)
    params = [m.weights, m.dense]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        s = m.of(dense, owner, which)
        g = -1.0 / (1.0 + np.exp(np.clip(s[a] - s[b], -30, 30))) / pairs  # derivative of the logistic loss by the margin
        by_row = np.bincount(a, g, len(good)) - np.bincount(b, g, len(good))
        grads = [np.bincount(which, by_row[owner], len(words)) + l2 * m.weights, by_row @ x + l2 * m.dense]
        for p, d, f1, f2 in zip(params, grads, first, second):
            f1 += 0.1 * (d - f1)
            f2 += 0.01 * (d * d - f2)
            p -= 0.05 * (f1 / (1 - 0.9**t)) / (np.sqrt(f2 / (1 - 0.99**t)) + 1e-7)
    s = m.of(dense, owner, which)
    m.held = s[good & held]
    clean = m.held if len(m.held) else s[good]
    m.threshold = float(np.quantile(clean, quantile)) - 1e-9
    return m


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            dense, ids, at = features(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), binary_array(dense.reshape(-1), np.arange(hi - lo + 1) * DENSE), binary_array(ids, at)], names=["good", "dense", "ids"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, quantile: float = 0.004) -> Model:
    """Fits on a bounded sample: at most ``sample`` labelled documents of either class, the first by hash of their id.

    The threshold is the exact quantile of the scores of all clean labelled documents that were not trained on:
    the held-out ones of the sample and all outside of it.

    A label is clean where quality = 1 and toxic = 0; one with a null in either column is left out. An id
    labelled more than once is bad if any of its labels is. Without labels of both classes the model
    rejects nothing.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.bool_and("good").alias("good"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("good").orderBy(*order).limit(sample).unionByName(marks.where("NOT good").orderBy(*order).limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("good", F.coalesce("text", F.lit("")).alias("text"))  # at most 2 * sample ids
    rows = rows.mapInArrow(_rows, "good boolean, dense binary, ids binary")

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([*batches, pd.DataFrame({"good": [], "dense": [], "ids": []})])
        got = got.assign(key=[d + i for d, i in zip(got.dense, got.ids)]).sort_values(["good", "key"])  # whatever order the rows arrive in
        lists = [np.frombuffer(x, np.uint32) for x in got.ids]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        dense = np.frombuffer(b"".join(got.dense), np.float64).reshape(-1, DENSE)
        m = fit(dense, np.concatenate([*lists, np.zeros(0, np.uint32)]), at, got.good.to_numpy(bool), quantile)
        yield pd.DataFrame({"model": [np.concatenate([m.words, m.weights, m.dense, m.mean, m.scale, [m.threshold]]).astype(np.float64).tobytes()], "held": [m.held.tobytes()]})

    got = rows.repartition(1).mapInPandas(one, "model binary, held binary").first()
    flat = np.frombuffer(got["model"], np.float64)
    k = (len(flat) - 3 * DENSE - 1) // 2
    model = Model(flat[:k].astype(np.uint32), flat[k : 2 * k], *flat[2 * k : -1].reshape(3, DENSE), float(flat[-1]), np.frombuffer(got["held"], np.float64))
    if model.threshold == -np.inf:
        return model
    outside = marks.where("good").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    rest = durable(scores(docs, model).join(outside, "doc_id").select("score"), "clean_scores")
    n = rest.count()
    if n:
        at = quantile * (n + len(model.held) - 1)
        low = rest.orderBy("score").limit(int(at) + 2).toArrow().column("score").to_numpy()  # that share of them only
        low = np.sort(np.concatenate([low, model.held]))
        first, second = low[int(at)], low[min(int(at) + 1, len(low) - 1)]
        model.threshold = float(first + (at - int(at)) * (second - first)) - 1e-9
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, keep) of every row with an id; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 20,000 words at most, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = np.concatenate([np.zeros(0), *(m.score(batch.column(1).slice(lo, hi - lo)) for lo, hi in slices(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= m.threshold)], names=["doc_id", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, score double, keep boolean")


def keep_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with their own columns, that the model keeps. Rows of null id are dropped; a null text counts as empty; repeated rows fare alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = np.concatenate([np.zeros(0, bool), *(m.score(texts.slice(lo, hi - lo)) >= m.threshold for lo, hi in slices(texts))])
            yield batch.filter(pa.array(keep))

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, docs.schema)
