"""Ingest, search, answers, evaluation, streaming and the command line on small collections."""

import zipfile

import numpy as np
import pytest
from lexloom import Config, Engine
from lexloom.errors import ConfigurationError, DocumentLoadError, IndexVersionError, RAGError, RetrievalError
from lexloom.functions import answers, language, metrics as M
from lexloom.functions.chunking import split_text
from lexloom.functions.embedding import hash_vectors
from lexloom.functions.language import fold_text, phonetic_token, shorten, transliterate_text
from lexloom.operators.dedup import first_of_each
from lexloom.operators.filters import encode
from lexloom.operators.fusion import fuse
from lexloom.plans import evaluate
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    e = Engine(spark, embedding_provider="hashing", embedding_model="hashing-ngram", embedding_dimension=256, storage_path=str(tmp_path_factory.mktemp("store")))
    assert e.add_documents([(i, t, n, None, None, n, {"topic": encode(n), "year": encode(2026.0)}) for i, (n, t) in enumerate(evaluate.DOCUMENTS)]) == 8
    return e


def test_ingest_dedups_and_reopens(spark, db):
    assert db.add_many(["ঢাকা  বাংলাদেশের রাজধানী।", " "]) == 0 and db.add_many([]) == 0  # the same text but for white space
    assert db.count() == 8 and Engine(spark, db.config).count() == 8
    with pytest.raises(IndexVersionError):
        Engine(spark, db.config, embedding_dimension=128)
    with pytest.raises(ConfigurationError):
        db.add("  ")
    assert db.info()["documents"] == 8 and db.list_collections() == ["default"] and db.language_distribution().collect()[0]["language"] == "bn"


def test_search_modes_filter_and_threshold(db):
    for mode in ("semantic", "keyword", "hybrid"):
        got = db.search("Bangladesh er rajdhani kothay?", mode=mode, top_k=3).collect()
        assert got[0]["document_id"] == "capital" and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert [r["document_id"] for r in db.search("rajdhani", filter={"topic": "food", "year": 2026}, mode="semantic").collect()] == ["food"]
    assert db.search("rajdhani", filter={"topic": "food"}, mode="keyword").count() == 0
    assert all(r["score"] >= 0.9 for r in db.search("desh er rajdhani ki?", score_threshold=0.9).collect())
    assert db.search("school er chuti ache ki?", rerank_results=True).first()["document_id"] == "holiday"
    assert db.explain("desh er rajdhani ki?")["language"] == "banglish"
    with pytest.raises(ConfigurationError):
        db.search("x", mode="nearby")


def test_answers(spark, db):
    got = db.ask("বাংলাদেশের রাজধানী কী?")
    assert got["answer"] == "ঢাকা [1]" and got["citations"][0]["document_id"] == "capital" and "[1] (capital) " in got["prompt"]
    with pytest.raises(RAGError):
        db.ask(" ")
    strict = Engine(spark, db.config, rag_confidence_threshold=1.0)
    assert strict.ask("quantum chromodynamics", mode="semantic")["answer"] == answers.REFUSE_EN and strict.ask("মঙ্গল গ্রহ কত দূরে?", mode="semantic")["answer"] == answers.REFUSE_BN
    fails = Engine(spark, db.config, generator=lambda q, p: 1 / 0)
    assert fails.ask("বাংলাদেশের রাজধানী কী?")["answer"] == "ঢাকা [1]"


def test_evaluation_gate(spark, db):
    got = evaluate.means(evaluate.evaluate_retrieval(db, evaluate.benchmark_samples(spark), (1, 3, 5)))
    assert got["hit@3"] >= 0.8 and got["mrr"] >= 0.5
    assert abs(got["hit@1"] - 0.833) < 0.001 and abs(got["mrr"] - 0.875) < 0.001 and got["hit@5"] == 1.0 and abs(got["ndcg@5"] - 0.905) < 0.001  # the published figures
    assert evaluate.means(evaluate.ranking_metrics(spark.createDataFrame([], "relevant array<string>, ranked array<string>"))) == {}


def test_delete_clear_and_files(spark, tmp_path):
    e = Engine(spark, embedding_provider="hashing", embedding_model="hashing-ngram", embedding_dimension=64, storage_path=str(tmp_path / "s"))
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.TXT").write_bytes("﻿The river Padma.".encode())
    (tmp_path / "in/sub/b.md").write_text("Dhaka is the capital.")
    (tmp_path / "in/c.csv").write_text("no")
    with zipfile.ZipFile(tmp_path / "in/d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One part.</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Another.</w:t></w:r></w:p></w:body></w:document>')
    assert e.add_directory(str(tmp_path / "in"), metadata={"k": 1}) == 3
    texts = {r["title"]: r["text"] for r in e.chunks().collect()}
    assert texts == {"a": "The river Padma.", "b": "Dhaka is the capital.", "d": "One part.\n\nAnother."}
    e.delete(e.chunks().first()["chunk_id"])
    e.delete("unknown")
    assert e.count() == 2
    e.clear()
    assert e.count() == 0 and e.search("river").count() == 0
    with pytest.raises(DocumentLoadError):
        e.add_file(str(tmp_path / "in/c.csv"))
    with pytest.raises(DocumentLoadError):
        e.add_file(str(tmp_path / "none.txt"))


def test_stream_ingest(spark, tmp_path):
    from lexloom.streaming.ingest import ingest_stream

    e = Engine(spark, embedding_provider="hashing", embedding_model="hashing-ngram", embedding_dimension=64, storage_path=str(tmp_path / "s"))
    spark.createDataFrame([("a", "one text", "s"), ("b", "one text", "s"), ("c", "another", "s")], "document_id string, text string, source string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("document_id string, text string, source string").parquet(str(tmp_path / "in"))
    ingest_stream(e, docs, str(tmp_path / "cp")).awaitTermination()
    assert e.count() == 2


def test_command_line(spark, tmp_path, capsys):
    from lexloom.__main__ import parser, run

    call = lambda *a: run(parser().parse_args(["--storage", str(tmp_path), "--provider", "hashing", "--model", "hashing-ngram", *a]), spark)
    assert call("index") == 2 and call("index", "--text", "Dhaka is the capital of Bangladesh.") == 0
    assert call("search", "capital", "--json") == 0 and '"language": "en"' in capsys.readouterr().out
    assert call("ask", "what is the capital of Bangladesh?") == 0 and "Dhaka [1]" in capsys.readouterr().out


def test_settings():
    for bad in ({"top_k": 0}, {"chunk_overlap": 500}, {"score_threshold": 2}, {"semantic_weight": -1}, {"semantic_weight": 0, "keyword_weight": 0}, {"fusion_method": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert (Config().embedding_provider, Config().embedding_dimension) in {("hashing", 256), ("local", 384)}


def test_language_functions():
    assert phonetic_token("rajdhani") == "রাজধানি" and shorten("kiii") == "ki" and fold_text("KIII?") == "ki?"
    assert "রাজধানী" in transliterate_text("desh er rajdhani") and "capital" in transliterate_text("desh er capital ki?")


def test_chunks():
    text = ("Sentence number one is here. " * 40 + "\n\nঢাকা বাংলাদেশের রাজধানী। " * 20).strip()
    got = split_text(text, 100, 20)
    assert len(got) > 10 and max(map(len, got)) <= 120 + 20 and set(text.split()) <= set(" ".join(got).split())
    assert split_text("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50] and split_text("  ") == [] and split_text("short") == ["short"]


def test_hash_vectors():
    v = hash_vectors(["বাংলা text", "", "বাংলা text", "texts"], 256)
    assert v.shape == (4, 256) and not v[1].any() and np.allclose(v[0], v[2]) and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and v[0] @ v[3] > 0


def test_fusion_by_hand(spark):
    rows = [(0, 0, "a", 1, 0.9, 1), (0, 0, "b", 2, 0.5, 2), (0, 1, "b", 2, 3.0, 1), (0, 1, "c", 3, 1.0, 2)]
    lists = spark.createDataFrame(rows, "qid long, list int, key string, seq long, score double, rank int")
    assert [(r["key"], round(r["score"], 6)) for r in fuse(lists, [0.7, 0.3]).orderBy("rank").collect()] == [("a", 0.7), ("b", 0.3), ("c", 0.0)]
    rrf = {r["key"]: r["score"] for r in fuse(lists, [1.0, 1.0], "rrf").collect()}
    assert rrf["b"] == 1.0 and abs(rrf["a"] - (1 / 61) / (1 / 62 + 1 / 61)) < 1e-9
    with pytest.raises(RetrievalError):
        fuse(lists, [1.0], "max")


def test_metrics_by_hand(spark):
    one = spark.createDataFrame([(["a", "c"], ["x", "a", "a", "c"], "Dhaka is big [1] [3]", ["Dhaka is a big city"])], "rel array<string>, got array<string>, answer string, ev array<string>")
    r = one.select(
        M.hit_at_k(F.col("rel"), F.col("got"), 1), M.recall_at_k(F.col("rel"), F.col("got"), 3), M.reciprocal_rank(F.col("rel"), F.col("got")), M.ndcg_at_k(F.col("rel"), F.col("got"), 4),
        M.faithfulness(F.col("answer"), F.col("ev")), M.citation_accuracy(F.col("answer"), F.col("ev")), M.answer_accuracy(F.col("answer"), F.lit("dhaka")), M.is_grounded(F.col("answer"), F.col("ev")),
    ).first()
    ideal = 1 + 1 / np.log2(3)
    assert tuple(r)[:3] == (0.0, 0.5, 0.5) and abs(r[3] - (1 / np.log2(3) + 1 / 2) / ideal) < 1e-9 and tuple(r)[4:] == (1.0, 0.5, 1.0, True)


def test_answer_spans():
    cases = [("What is the capital of Bangladesh?", "Dhaka is the capital of Bangladesh.", "Dhaka"), ("desh er rajdhani ki?", "Bangladesh er rajdhani Dhaka.", "Dhaka"), ("Where is the fort?", "The fort is in Dhaka.", "Dhaka"),
             ("When was it?", "It was in 1971.", "1971"), ("koto manush?", "There are 1,200 people.", "1,200"), ("How is it made?", "It is made by hand.", "hand"), ("why?", "Because it is so.", "Because it is so.")]
    for question, passage, want in cases:
        assert answers.extract(question, passage) == f"{want} [1]", question
    assert answers.trim_verbose("A. " * 200 + "End [2]").endswith("[2]") and answers.trim_verbose("short") == "short"


def test_first_of_each(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("", 1, "z"), ("", 1, "z"), (None, 3, "n"), ("b", None, "b"), ("b", 9, "c")], "content_hash string, seq long, `a.b` string")
    got = sorted(tuple(r) for r in first_of_each(rows).fillna("-", subset=["content_hash"]).collect())
    assert got == [("", 1, "z"), ("", 1, "z"), ("-", 3, "n"), ("a", 1, "y"), ("b", 9, "c")]
    assert first_of_each(rows.limit(0)).count() == 0 and first_of_each(rows).columns == rows.columns


@pytest.mark.parametrize("text,count,romanised", [("Ami bhalo achi", None, True), ("the capital of a country", 0, False), ("AMI xami amix", 1, False), ("", 0, False)])
def test_markers(spark, text, count, romanised):
    got = spark.range(1).select(language.marker_count(F.lit(text)).alias("n"), language.looks_banglish(F.lit(text)).alias("b")).first()
    assert (count is None or got["n"] == count) and got["b"] == romanised
