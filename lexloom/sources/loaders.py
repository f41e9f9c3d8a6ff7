"""Files to document rows (path, text, title, page), read by the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import DocumentLoadError

SUPPORTED = (".txt", ".md", ".pdf", ".docx")
_SCHEMA = "path string, text string, title string, page int"


def _text(path: str, raw: bytes) -> list[tuple[str, int | None]]:
    try:
        return [(raw.decode("utf-8-sig"), None)]
    except UnicodeDecodeError as e:
        raise DocumentLoadError(f"{path} is not UTF-8") from e


def _docx(path: str, raw: bytes) -> list[tuple[str, int | None]]:
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise DocumentLoadError(f"{path} is not a Word document") from e
    body = root.find(f"{word}body")
    paragraphs = ["".join(t.text or "" for t in p.iter(f"{word}t")) for p in (body if body is not None else root).findall(f"{word}p")]
    return [("\n\n".join(p for p in paragraphs if p.strip()), None)]


def _pdf(path: str, raw: bytes) -> list[tuple[str, int | None]]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise DocumentLoadError("reading .pdf needs the package pypdf") from e
    try:
        return [(page.extract_text() or "", n) for n, page in enumerate(PdfReader(io.BytesIO(raw)).pages, 1)]
    except Exception as e:
        raise DocumentLoadError(f"{path} can't be read: {e}") from e


_READERS = {".txt": _text, ".md": _text, ".docx": _docx, ".pdf": _pdf}


def suffix(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def get_loader(path: str):  # noqa: ANN201
    if suffix(path) not in _READERS:
        raise DocumentLoadError(f"{path}: only {', '.join(SUPPORTED)} can be read")
    return _READERS[suffix(path)]


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, raw in zip(frame["path"], frame["content"]):
            for text, page in get_loader(path)(path, bytes(raw)):
                if text.strip():
                    rows.append((path, text, PurePosixPath(path).stem, page))
        yield pd.DataFrame(rows, columns=["path", "text", "title", "page"]).astype({"page": "Int32"})


def load_files(spark: SparkSession, path: str, recursive: bool = True, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """Documents of a file, or of a directory's files with these extensions in either case. Blank documents and pages are left out."""
    local = Path(path)
    if "://" not in path and not local.exists():
        raise DocumentLoadError(f"{path} does not exist")
    if local.is_file():
        get_loader(path)
    allowed = "|".join(re.escape(e.lower()) for e in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive or local.is_file()).lower())
    if local.is_dir() and not recursive:
        files = files.option("pathGlobFilter", "*.*")
    return files.load(path).where(f"lower(path) RLIKE '({allowed})$'").select("path", "content").mapInPandas(_parse, _SCHEMA)


def safe_resolve(path: str, base: str) -> Path:
    """The path under the base; one that leaves the base is an error."""
    root = Path(base).resolve()
    full = (root / path).resolve()
    if not full.is_relative_to(root):
        raise DocumentLoadError(f"{path} leaves {base}")
    return full
