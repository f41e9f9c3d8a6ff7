"""The engine: ingest, search, answer. Every step takes and gives DataFrames; one query is a table of one row."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F

from ..config import Config
from ..errors import ConfigurationError, RAGError
from ..functions import answers, text as T
from ..functions.chunking import chunks as chunk
from ..functions.embedding import embedder
from ..functions.language import detect_language
from ..operators.dedup import first_of_each, not_in
from ..operators.filters import encode, matches
from ..operators.fusion import candidate_count, hybrid
from ..operators.keyword import KeywordIndex, build_index, keyword_search
from ..operators.rerank import rerank
from ..operators.vectors import vector_search
from ..sources.loaders import SUPPORTED, load_files
from ..sources.store import Store, list_collections

_DOC = "pos long, text string, source string, title string, page int, document_id string, metadata map<string,string>"


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``pos``, the place of a row's keys in their order from 0. Only the keys are sorted, not what else the rows hold."""
    order = rows.select(*keys).distinct().withColumn("pos", (F.row_number().over(W.orderBy(*keys)) - 1).cast("long"))
    return rows.join(order, list(keys))


def chunk_rows(docs: DataFrame, config: Config, first_seq: int = 1) -> DataFrame:
    """Document rows (pos, text, source, title, page, document_id, metadata) to chunk rows, without embeddings, in the order of pos."""
    doc_id = F.coalesce("document_id", T.document_id(F.col("text"), F.col("source")))
    cut = docs.select("pos", "source", "title", "page", "metadata", doc_id.alias("document_id"), F.posexplode(chunk(F.col("text"), config.chunk_size, config.chunk_overlap)).alias("chunk_index", "text"))
    cut = cut.withColumn("language", detect_language(F.col("text")))
    cut = cut.withColumn("normalized_text", T.normalize_for_search(F.col("text"), F.col("language")))
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "language")
    return cut.select(
        (F.lit(first_seq).cast("long") + F.col("pos") * (1 << 20) + F.col("chunk_index")).alias("seq"), T.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", "text",
        "normalized_text", "language", "source", "title", "page", F.map_concat(own, F.create_map(F.lit("language"), F.concat(F.lit('"'), "language", F.lit('"')))).alias("metadata"), T.content_hash(F.col("normalized_text")).alias("content_hash"),
    )


class Engine:
    """A collection with its settings.

    >>> db = Engine(spark, storage_path="/data/index"); db.add("Dhaka is the capital."); db.search("capital").show()
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, generator: Callable[[str, str], str] | None = None, **overrides: Any) -> None:
        self.spark, self.generator = spark, generator
        self.config = replace(config or Config(), **overrides)
        if self.config.vector_store != "local":
            raise ConfigurationError(f"unknown vector store {self.config.vector_store!r}")
        if self.config.llm_provider not in ("template", "slm", "openai"):
            raise ConfigurationError(f"unknown llm provider {self.config.llm_provider!r}")
        self.embed = embedder(self.config)
        self.store = Store(spark, self.config)
        self._index: KeywordIndex | None = None

    # Ingest

    def add(self, text: str, metadata: dict[str, Any] | None = None, source: str = "user", title: str | None = None, page: int | None = None, document_id: str | None = None) -> int:
        if not isinstance(text, str) or not text.strip():
            raise ConfigurationError("text is a string that is not blank")
        return self.add_documents([(0, text, source, title, page, document_id, self._meta(metadata))])

    def add_many(self, texts: list[str], metadata: list[dict[str, Any]] | None = None, source: str = "user") -> int:
        if metadata is not None and len(metadata) != len(texts):
            raise ConfigurationError("metadata has a dictionary for each text")
        return self.add_documents([(i, t, source, None, None, None, self._meta(metadata[i] if metadata else None)) for i, t in enumerate(texts)]) if texts else 0

    def add_file(self, path: str, metadata: dict[str, Any] | None = None) -> int:
        return self._add_path(path, True, SUPPORTED, metadata)

    def add_directory(self, path: str, recursive: bool = True, extensions: tuple[str, ...] = SUPPORTED, metadata: dict[str, Any] | None = None) -> int:
        return self._add_path(path, recursive, extensions, metadata)

    def _add_path(self, path: str, recursive: bool, extensions: tuple[str, ...], metadata: dict[str, Any] | None) -> int:
        files = load_files(self.spark, path, recursive, extensions)
        given = F.create_map(*[F.lit(x) for pair in (self._meta(metadata) or {}).items() for x in pair]).cast("map<string,string>")
        files = numbered(files.withColumn("page_no", F.coalesce("page", F.lit(0))), "path", "page_no")
        return self.add_documents(files.select("pos", "text", F.regexp_replace("path", "^file:/*", "/").alias("source"), "title", "page", F.lit(None).cast("string").alias("document_id"), given.alias("metadata")))

    @staticmethod
    def _meta(metadata: dict[str, Any] | None) -> dict[str, str | None] | None:
        return {k: encode(v) for k, v in metadata.items()} if metadata else None

    def add_documents(self, docs: DataFrame | list[tuple]) -> int:
        """Rows (pos, text, source, title, page, document_id, metadata); gives the number of chunks that were new. Chunks are embedded after the duplicates are gone."""
        docs = docs if isinstance(docs, DataFrame) else self.spark.createDataFrame(docs, _DOC)
        have = self.store.rows
        fresh = first_of_each(chunk_rows(docs, self.config, self.store.next_seq()))
        fresh = not_in(fresh, have) if self.store.info else fresh
        vector = self.embed(F.when(F.col("normalized_text") != "", F.col("normalized_text")).otherwise(F.col("text")))
        before = self.count()
        self.store.append(fresh.withColumn("embedding", vector).select(*have.columns))
        self._index = None
        return self.count() - before

    # Catalog

    def count(self) -> int:
        return self.store.rows.count() if self.store.info else 0

    def chunks(self) -> DataFrame:
        return self.store.rows.orderBy("seq")

    def delete(self, chunk_id: str) -> None:
        """Takes out the first chunk of this id; an unknown id is no error."""
        first = self.store.rows.where(F.col("chunk_id") == chunk_id).agg(F.min("seq")).first()[0]
        if first is not None:
            self.store.replace(self.store.rows.where(F.col("seq") != first))
            self._index = None

    def clear(self) -> None:
        self.store.replace(self.store.rows.limit(0))
        self._index = None

    def language_distribution(self) -> DataFrame:
        return self.store.rows.groupBy("language").count()

    def collection_info(self) -> DataFrame:
        return self.store.rows.agg(F.lit(self.config.collection).alias("name"), F.count_distinct("document_id").alias("document_count"), F.count("*").alias("chunk_count"))

    def info(self) -> dict[str, Any]:
        c, one = self.config, self.collection_info().first()
        return {"collection": c.collection, "embedding_model": c.embedding_model, "embedding_dimension": c.embedding_dimension, "metric": c.metric, "documents": one["document_count"], "chunks": one["chunk_count"],
                "languages": {r["language"]: r["count"] for r in self.language_distribution().collect()}}

    def list_collections(self) -> list[str]:
        return list_collections(self.config.storage_path)

    # Search

    def _keyword_index(self) -> KeywordIndex:
        if self._index is None:  # rebuilt after every change of the collection
            self._index = build_index(self.store.rows, text="normalized_text")
        return self._index

    def _mode(self, mode: str | None) -> str:
        mode = mode or self.config.search_mode
        if mode not in ("semantic", "keyword", "hybrid", "auto"):
            raise ConfigurationError(f"unknown search mode {mode!r}")
        return "hybrid" if mode == "auto" else mode

    def search_batch(self, queries: DataFrame, top_k: int | None = None, score_threshold: float | None = None, filter: dict[str, Any] | None = None, mode: str | None = None, rerank_results: bool | None = None, include_metadata: bool = True) -> DataFrame:  # noqa: A002
        """(qid, query, rank, score and the chunk's columns) for all of ``queries`` (qid long, query) in one plan."""
        c = self.config
        k, mode, threshold = top_k or c.top_k, self._mode(mode), c.score_threshold if score_threshold is None else score_threshold
        how = c.reranker if rerank_results is None else (c.reranker or "lexical") if rerank_results else None
        fetch = max(k, c.rerank_candidates) if how else k
        asked = queries.select(F.col("qid").cast("long").alias("qid"), "query", T.normalize_for_search(F.col("query")).alias("normalized"))
        rows, keep = self.store.rows, matches(F.col("metadata"), filter)

        def semantic(n: int) -> DataFrame:
            return vector_search(rows.where(keep), asked.select("qid", self.embed(F.col("normalized")).alias("embedding")), n, c.metric)

        def keyword(n: int) -> DataFrame:
            return keyword_search(rows, asked.select("qid", F.col("normalized").alias("query")), n, keep if filter else None, index=self._keyword_index())

        if mode == "hybrid":
            n = candidate_count(fetch)
            found = hybrid(semantic(n), keyword(n), (c.semantic_weight, c.keyword_weight), c.fusion_method, fetch).select("qid", "seq", "score", "rank")
        else:
            found = (semantic if mode == "semantic" else keyword)(fetch)
        found = found.join(rows.drop("embedding", "normalized_text", "content_hash"), "seq").join(asked, "qid")
        if how:
            found = rerank(found.withColumnRenamed("query", "_asked").withColumnRenamed("normalized", "query"), how, k, c.reranker_model).drop("query").withColumnRenamed("_asked", "query")
        else:
            found = found.drop("normalized")
        if threshold > 0:
            found = found.where(F.col("score") >= threshold)
        return found if include_metadata else found.withColumn("metadata", F.create_map().cast("map<string,string>"))

    def search(self, query: str, **options: Any) -> DataFrame:
        if not isinstance(query, str) or not query.strip():
            raise ConfigurationError("a query is a string that is not blank")
        return self.search_batch(self.spark.createDataFrame([(0, query)], "qid long, query string"), **options).orderBy("rank")

    def explain(self, query: str, **options: Any) -> dict[str, Any]:
        rows = self.search(query, **options).select("score").collect()
        return {"query": query, "language": self._language(query), "mode": self._mode(options.get("mode")), "candidate_count": len(rows), "top_score": rows[0]["score"] if rows else None}

    def _language(self, text: str) -> str:
        return self.spark.range(1).select(detect_language(F.lit(text))).first()[0]

    # Answers

    def ask_batch(self, questions: DataFrame, top_k: int | None = None, filter: dict[str, Any] | None = None, mode: str | None = None) -> DataFrame:  # noqa: A002
        """(qid, query, answer, model, prompt, citations): cited extractive answers, or a refusal where nothing is found or the best score is under the threshold."""
        found = self.search_batch(questions, top_k=top_k, filter=filter, mode=mode)
        cited = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "source", "page", "text", "chunk_id", "document_id"))).alias("citations"))
        rows = questions.select(F.col("qid").cast("long").alias("qid"), "query").join(cited, "qid", "left")
        best = F.try_element_at("citations", F.lit(1))
        limit = self.config.rag_confidence_threshold
        refuse = best.isNull() | ((F.lit(limit) > 0) & (best["score"] < limit))
        prompt = answers.build_prompt(F.col("query"), F.col("citations"))
        answer, model = answers.extract_udf(F.col("query"), best["text"]), F.lit("template-extractive")
        if self.generator is not None:
            own = generator_udf(self.generator)(F.col("query"), prompt)
            model = F.when(F.coalesce(own, F.lit("")) != "", self.config.llm_model).otherwise(model)
            answer = F.coalesce(F.nullif(own, F.lit("")), answer)
        return rows.select("qid", "query", F.when(refuse, answers.refusal(F.col("query"))).otherwise(answer).alias("answer"), model.alias("model"), F.when(refuse, "").otherwise(prompt).alias("prompt"),
                           F.when(~refuse, F.col("citations")).otherwise(F.array().cast(cited.schema["citations"].dataType)).alias("citations"))

    def ask(self, question: str, **options: Any) -> Row:
        if not isinstance(question, str) or not question.strip():
            raise RAGError("a question is a string that is not blank")
        return self.ask_batch(self.spark.createDataFrame([(0, question)], "qid long, query string"), **options).first()

    def close(self) -> None:
        """All changes are on disk as soon as they are made."""

    def to_json(self) -> str:
        return json.dumps(self.info(), ensure_ascii=False, indent=2)


def generator_udf(generate: Callable[[str, str], str]) -> Callable[[Column, Column], Column]:
    """A language model as a function (question, prompt) -> answer; where it fails or says nothing the extractive answer is used."""
    @F.pandas_udf("string")
    def run(questions: pd.Series, prompts: pd.Series) -> pd.Series:
        def one(q: str, p: str) -> str | None:
            try:
                return answers.trim_verbose(generate(q, p).strip()) or None if isinstance(p, str) else None
            except Exception:  # noqa: BLE001 - any failure of a model falls back
                return None

        return pd.Series([one(q, p) for q, p in zip(questions, prompts)])

    return run
