"""The pipeline by its stages, each held against brute force on its own input."""

import corpus_pipeline
import duckdb
from lexloom.llm import decontaminate, substrings
from lexloom.llm.kernels import WORD, tokenise
from test_operators import brute_classes, brute_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {"raw": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = at[name] = spark.createDataFrame(rows := stage(spark, docs, SF).collect(), docs.schema) if name != "packing" else stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == at["raw"].columns and len(rows) > 50
    rows = lambda name: [(r["doc_id"], r["text"], "") for r in at[name].collect()]
    con = duckdb.connect()
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1 AND toxic = 0").fetchall()}
    kept = {i for i, _, _ in rows("quality_classifier")}
    assert len(clean & kept) >= 0.95 * len(clean)
    # Copies: of each class the least id stays.
    classes = brute_classes(rows("quality_classifier"), 0.5)
    assert {i for i, _, _ in rows("ngram_jaccard")} == {i for i, c, _ in classes if i == c}
    # Repeats: exactly the tokens that brute force cuts are gone.
    cut, _ = brute_spans(rows("ngram_jaccard"), 50)
    want = {i: [w for q, w in enumerate(t.split()) if (i, q) not in cut] for i, t, _ in rows("ngram_jaccard")}
    assert {i: t.split() for i, t, _ in rows("substring_dedup")} == {i: w for i, w in want.items() if w}
    # Leaks: a document with a whole benchmark item goes, and none without a window near one.
    items = con.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    seq = lambda t: tokenise(__import__("pyarrow").array([t.lower()]), WORD).hashes.tolist()
    after = {i for i, _, _ in rows("benchmark_decontamination")}
    for i, t, _ in rows("substring_dedup"):
        s = seq(t)
        near = 99.0
        for (text,) in items:
            w = seq(text)
            if set(w) & set(s):
                some = [p for p in range(max(1, len(s) - len(w) + 1)) if len(set(w) & set(s[p : p + len(w)])) >= 0.5 * len(set(w))]
                near = min([near, *(decontaminate.edit_distance(__import__("numpy").array(w), __import__("numpy").array(s[p : p + len(w)]), 99) / len(w) for p in some)])
        assert (i in after) == (near > 0.2), (i, near)
    packed = {}
    for w in at["packing"].collect():
        for x in w["items"]:
            packed[x["doc_id"]] = packed.get(x["doc_id"], 0) + x["length"]
    assert packed == {i: len(t.split()) for i, t, _ in rows("benchmark_decontamination") if t.split()}


def test_stages_take_edge_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    edge = [(None, "no id", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b " * 30000, "en", "s", None), (4, "same text here", "en", "s", 14), (4, "same text here", "en", "s", 14)]
    for rows in (edge, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
    assert substrings.remove_repeats(spark.createDataFrame(edge, schema)).count() == 6
