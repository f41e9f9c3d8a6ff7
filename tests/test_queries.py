"""Every query that has SQL gives the rows that DuckDB gives, at the smallest scale; and the entry module works without the training-data part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from lexloom.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "benchmark", "labels", "conversations", "pages"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["bm25_topk_batch", "hybrid_search", "fuse_rrf", "rerank_dice", "lang_detect", "lang_detect_scripts", "dedup_first", "knn_batch", "metrics_ndcg", "citation_accuracy", "faithfulness", "refusal", "question_type", "prompt_context"])
def test_same_as_sql(spark, con, name):
    got = own.queries()[name](spark, SF)
    rel = con.sql(own.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in rel.fetchall())


def test_entry_without_training_data_part(tmp_path):
    """A copy without the llm folder and the pipeline still imports and lists its queries."""
    root = Path(__file__).resolve().parents[1]
    import shutil

    shutil.copytree(root / "lexloom", tmp_path / "lexloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
