"""Collections as versioned Parquet: <storage>/<collection>/v=N/ and an ``index_info.json`` that names N."""

from __future__ import annotations

import json
import shutil
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..errors import IndexVersionError

SCHEMA = (
    "seq long, chunk_id string, document_id string, chunk_index int, text string, normalized_text string, language string, source string, title string, page int, "
    "metadata map<string,string>, content_hash string, embedding array<float>"
)
INFO = "index_info.json"


class Store:
    """One collection. A change is written as a new version and then the pointer is replaced; the version before is kept until the next change."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark, self.config = spark, config
        self.folder = Path(config.storage_path) / config.collection
        self.info = json.loads((self.folder / INFO).read_text(encoding="utf-8")) if (self.folder / INFO).exists() else None
        if self.info:
            have, want = (self.info["embedding_model"], self.info["embedding_dimension"]), (config.embedding_model, config.embedding_dimension)
            if have != want:
                raise IndexVersionError(f"collection {config.collection!r} was made with {have}, not {want}")

    @property
    def rows(self) -> DataFrame:
        if not self.info or self.info.get("data_version") is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[str(self.folder / p) for p in self.info["parts"]])

    def _point(self, parts: list[str], version: int) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        old = (self.info or {}).get("parts", [])
        self.info = {
            "embedding_model": self.config.embedding_model, "embedding_dimension": self.config.embedding_dimension, "embedding_version": "1", "index_version": "1",
            "metric": self.config.metric, "created_at": (self.info or {}).get("created_at") or datetime.now(timezone.utc).isoformat(), "data_version": version, "parts": parts,
        }
        new = self.folder / (INFO + ".new")
        new.write_text(json.dumps(self.info, ensure_ascii=False, indent=2), encoding="utf-8")
        new.replace(self.folder / INFO)
        for gone in self.folder.glob("v=*"):
            if gone.name not in parts and gone.name not in old:
                shutil.rmtree(gone)

    @property
    def _next(self) -> int:
        return ((self.info or {}).get("data_version") or 0) + 1

    def append(self, rows: DataFrame) -> None:
        """Adds rows without rewriting what is there."""
        n = self._next
        rows.write.parquet(str(self.folder / f"v={n}"))
        self._point([*(self.info or {}).get("parts", []), f"v={n}"], n)

    def replace(self, rows: DataFrame) -> None:
        n = self._next
        rows.write.parquet(str(self.folder / f"v={n}"))
        self._point([f"v={n}"], n)

    def next_seq(self) -> int:
        return (self.rows.agg(F.max("seq")).first()[0] or 0) + 1 if self.info else 1


def list_collections(storage: str) -> list[str]:
    root = Path(storage)
    return sorted(p.parent.name for p in root.glob(f"*/{INFO}")) if root.is_dir() else []
