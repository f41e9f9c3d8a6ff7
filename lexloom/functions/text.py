"""Normalisation, tokens, digests and sentences."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .language import detect_language, transliterate, transliterate_text

#: Words: letters, digits, underscore and the whole Bangla block, so that vowel signs stay with their letters.
TOKEN = r"[\p{L}\p{N}_\x{0980}-\x{09FF}]+"
_INVISIBLE = "[​‌‍﻿]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def strip(text: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Zero-width characters removed, runs of white space made one space, ends stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _INVISIBLE, ""), r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """NFKC, which leaves ASCII texts alone, then ``squeeze``."""
    return squeeze(_nfkc(text))


def normalize_for_search(text: Column, language: Column | None = None) -> Column:
    plain = normalize(text)
    return F.when((detect_language(text) if language is None else language) == "banglish", transliterate(plain)).otherwise(plain)


def normalize_text(text: str) -> str:
    """The same for one string on the driver."""
    return re.sub(r"\s+", " ", re.sub(_INVISIBLE, "", unicodedata.normalize("NFKC", text))).strip()


def search_text(text: str, language: str) -> str:
    plain = normalize_text(text)
    return transliterate_text(plain) if language == "banglish" else plain


def tokens(text: Column) -> Column:
    """Lower-cased words in order, repeats kept; of a null text none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


class _Letters(dict):
    """For str.translate: what is no part of a word to a space, filled in as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = kept = chr(code) if re.match(r"[\wঀ-৿]", chr(code)) else " "
        return kept


_letters = _Letters()


def words(text: str | None) -> list[str]:
    """``tokens`` of one text, by the Unicode tables of Python, which know letters that those of an older JVM do not."""
    return text.lower().translate(_letters).split() if text else []


def content_hash(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def document_id(text: Column, source: Column) -> Column:
    return short_hash(F.concat(text, F.lit("|"), source))


def chunk_id(document: Column, index: Column) -> Column:
    return short_hash(F.concat(document, F.lit("|"), index.cast("string")))


def sentences(text: Column) -> Column:
    """Parts that end with a full stop, dari, exclamation or question mark before white space."""
    return F.filter(F.transform(F.split(strip(text), r"(?<=[।.!?])(?U)\s+"), strip), lambda s: s != "")
