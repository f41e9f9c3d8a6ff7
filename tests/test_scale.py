"""Searches stay whole, and bounded in a task and on the driver, when their tables grow."""

import numpy as np
import pytest
from lexloom.operators import vectors as V
from lexloom.operators.vectors import vector_search


def _brute(x, seq, k, metric):
    x = x.astype(float)
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    s = {"cosine": unit @ unit.T, "dot": x @ x.T, "euclidean": 1 / (1 + np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)))}[metric].round(5)
    return {(int(seq[j]), int(seq[i]), r + 1) for j in range(len(x)) for r, i in enumerate([i for i in np.lexsort((seq, -s[j])) if i != j][:k])}


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_more_queries_than_a_block(spark, monkeypatch, metric):
    """Blocks of queries meet blocks of rows in tasks; before, every query came to the driver and each block was a scan of its own."""
    for name, value in {"BLOCK": 50, "QUERIES": 40, "ROWS_BYTES": 4000, "TILE": 64}.items():
        monkeypatch.setattr(V, name, value)
    r = np.random.default_rng(3)
    x, seq = r.normal(size=(300, 6)).astype(np.float32), r.permutation(300)
    x[7] = x[8] = x[250]
    x[9] = 0
    rows = spark.createDataFrame([(int(s), [float(e) for e in v]) for s, v in zip(seq, x)], "seq long, embedding array<float>")
    got = vector_search(rows, rows.withColumnRenamed("seq", "qid"), 7, metric, digits=5, skip_self=True)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Union" not in plan
    assert {(a.qid, a.seq, a.rank) for a in got.collect()} == _brute(x, seq, 7, metric)


def test_metrics_keep_no_list_of_relevant_ids(spark, tmp_path):
    """A row has its marks and a count; before, it had the ids of all rows of its label."""
    from lexloom.plans import queries as own

    r = np.random.default_rng(5)
    labels = [0] * 30 + [1] * 15 + [2] + [None] * 4
    spark.createDataFrame([(i, [float(e) for e in r.normal(size=4)], c) for i, c in enumerate(labels)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = own._ranked(spark, str(tmp_path))
    assert rows.columns == ["qid", "marks", "n"]
    assert {(a.qid, a.n, len(a.marks)) for a in rows.collect()} == {(i, 29 if i < 30 else 14, 10) for i in range(45)}

    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("metrics_hit", "metrics_recall", "metrics_mrr", "metrics_ndcg", "metrics_means"):
        got = own.queries()[name](spark, str(tmp_path))
        rel = con.sql(own.oracle_sql()[name])
        at = [rel.columns.index(c) for c in got.columns]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(row[k] for k in at)) for row in rel.fetchall())


TEXTS = [(0, "The red fox, the RED fox"), (1, "a red hen"), (2, "ঢাকা বাংলাদেশের রাজধানী"), (3, "Éen eux_1 ouan Él"), (4, None), (5, ""), (6, "a red hen"), (7, "fox " * 40 + "hen"), (8, "ΌΣΟΣ İstanbul")]
ASKED = [(0, "red fox fox"), (1, "hen ঢাকা"), (2, "él nothing"), (3, ""), (4, "όσος a")]


@pytest.mark.parametrize("digits", [6, None])
def test_scan_is_the_join_on_postings(spark, monkeypatch, digits):
    """The scan shuffles no posting; before, one row for each word of each text was shuffled. With too many words the join still does the whole job."""
    from lexloom.operators import keyword as K
    from pyspark.sql import functions as F

    chunks, asked = spark.createDataFrame(TEXTS, "seq long, text string"), spark.createDataFrame(ASKED, "qid long, query string")
    rows = lambda df: sorted((a.qid, a.seq, round(a.score, 9), a.rank) for a in df.collect())
    for keep in (None, F.col("seq") > 0):
        got = K.keyword_search(chunks, asked, 2, keep, digits)
        assert "explode" not in got._jdf.queryExecution().toString().lower()
        monkeypatch.setattr(K, "BLOCK", 4)
        monkeypatch.setattr(K, "TILE", 9)
        small = K.keyword_search(chunks, asked, 2, keep, digits)
        monkeypatch.setattr(K, "TERMS", 3)
        want = K.keyword_search(chunks, asked, 2, keep, digits)
        assert "explode" in want._jdf.queryExecution().toString().lower()
        assert rows(got) == rows(small) == rows(want) != []
        monkeypatch.undo()


@pytest.mark.parametrize("digits", [6, None])
def test_more_words_than_a_round(spark, monkeypatch, digits):
    """F14 to F18: queries of more words than ``TERMS`` take rounds of scans; before, postings and all pairs of texts and queries were shuffled."""
    from lexloom.operators import keyword as K
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame(TEXTS, "seq long, text string")
    asked = spark.createDataFrame(ASKED + [(i, f"red hen fox {i}") for i in range(5, 40)] + [(None, "fox")], "qid long, query string")
    rows = lambda df: sorted((a.qid, a.seq, round(a.score, 9), a.rank) for a in df.collect())
    for keep in (None, F.col("seq") > 0):
        want = rows(K.keyword_search(chunks, asked, 2, keep, digits))
        monkeypatch.setattr(K, "TERMS", 30)
        monkeypatch.setattr(K, "PAIRS", 9 * 41 - 1, raising=False)
        got = K.keyword_search(chunks, asked, 2, keep, digits)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan and plan.count("MapInArrow") > 3
        assert rows(got) == want != []
        monkeypatch.setattr(K, "PAIRS", 9 * 41)
        assert rows(K.keyword_search(chunks, asked, 2, keep, digits)) == want
        monkeypatch.undo()


def test_words_are_those_of_the_column(spark):
    from lexloom.functions.text import tokens, words

    df = spark.createDataFrame(TEXTS, "seq long, text string").withColumn("w", tokens("text"))
    assert all(r.w == words(r.text) for r in df.collect())


def test_texts_meet_results_without_a_shuffle(spark):
    """rerank_dice, refusal_gate and ask_answers: results are broadcast to the documents, whose texts were shuffled before."""
    from lexloom.plans import queries as own

    sf = "/root/testdata/sf0.001"
    docs, asked = own._docs(spark, sf), own._bench(spark, sf)
    plan = own._with_text(own.keyword_search(docs, asked, 3), docs, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_known_words_are_those_of_the_list(monkeypatch):
    """Words are looked up in whole slices of texts; before, every text became a list of strings, twice a search."""
    from collections import Counter

    import pyarrow as pa
    from lexloom.functions import known as N
    from lexloom.functions.text import words

    texts = [t for _, t in TEXTS] + ["x" * 300 + " fox", "\x00 fox\n_fox_ ঀfox fox‌fox 𝔘𝔫fox", "foxes fo x"]
    names = sorted({w for t in texts[1:] for w in words(t)})[::2] + ["fox", "foxe", "nowhere"]
    names, number = sorted(set(names)), {w: i for i, w in enumerate(sorted(set(names)))}
    want = [(i, c, n) for i, t in enumerate(texts) for c, n in sorted(Counter(number[w] for w in words(t) if w in number).items())]
    for hashes in (N._hashes, lambda data, starts, ends: np.zeros(len(starts), np.uint64)):  # the second time every word has the same hash
        monkeypatch.setattr(N, "_hashes", hashes)
        for size in (1, 40, 1 << 18):
            monkeypatch.setattr(N, "SLICE", size)
            known, got, lengths = N.Known(names), [], []
            for lo, some in N.slices(pa.array(texts)):
                length, row, code, tf = known.count(some)
                lengths += length.tolist()
                got += zip((row + lo).tolist(), code.tolist(), tf.tolist())
            assert got == want and lengths == [len(words(t)) for t in texts]
    assert N.Known([]).count(["a b", None])[0].tolist() == [2, 0]


def test_block_of_queries_is_sparse():
    """A block has its words and weights; before, it had matrices of all words by all queries, filled and multiplied for every text."""
    from lexloom.operators.keyword import _Block

    n, each, r = 400, 20, np.random.default_rng(2)
    at, term = np.repeat(np.arange(n), each), np.concatenate([r.choice(5000, each, replace=False) for _ in range(n)])
    weight = r.random(n * each) + 0.1
    block = _Block(np.arange(n) * 3, at, term, weight, 3, 6)
    assert sum(v.nbytes for v in vars(block).values() if isinstance(v, np.ndarray)) < 64 * n * each
    texts = np.array([r.choice(5000, 200, replace=False) for _ in range(70)])
    texts.sort(axis=1)
    texts[50] = texts[10]
    block.add(np.arange(70), np.ones(70), np.repeat(np.arange(70), 200), texts.ravel(), np.full(70 * 200, 2))
    weights = np.zeros((5000, n))
    weights[term, at] = weight
    score = np.round(np.array([weights[t].sum(0) * 2 * 2.5 / 3.5 for t in texts]) / (weights.sum(0) * 2.5), 6)
    for q in range(n):
        order = [i for i in np.lexsort((np.arange(70), -score[:, q]))[:3] if score[i, q] > 0]
        assert block.best.seq[q][: len(order)].tolist() == order
