"""Language detection (native expressions) and romanised-Bangla transliteration (Arrow UDF)."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, StringType

from .. import data

_LATIN = "[A-Za-z]+"
BANGLA = "[ঀ-৿]"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_bangla(text: Column) -> Column:
    return text.rlike(BANGLA)


def latin_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_LATIN), F.lit(0)), lambda t: F.lower(t))


def fold(token: Column) -> Column:
    """The common spelling of a romanised word."""
    table = F.create_map(*[F.lit(x) for pair in sorted(data.mapping("variants").items()) for x in pair])
    return F.coalesce(F.element_at(table, token), token)


def marker_count(text: Column) -> Column:
    """How many distinct marker words of romanised Bangla the text has, as written or folded."""
    tokens = F.array_distinct(latin_tokens(text))
    return F.size(F.array_intersect(F.array_union(tokens, F.transform(tokens, fold)), _strings(data.words("markers"))))


@cache
def _marked() -> tuple[dict[str, frozenset[str]], re.Pattern]:
    """The markers that each word stands for, as written or folded, and the pattern of words."""
    markers, variants = frozenset(data.words("markers")), data.mapping("variants")
    found = {w: markers & {w, variants.get(w, w)} for w in markers | set(variants)}
    return {w: m for w, m in found.items() if m}, re.compile(_LATIN)


def is_banglish(text: str) -> bool:
    """``looks_banglish`` of one text."""
    marked, word = _marked()
    tokens = [t.lower() for t in word.findall(text)]
    hits = [marked[t] for t in tokens if t in marked]
    return bool(hits) and (len(frozenset().union(*hits)) >= 2 or len(hits) / len(tokens) >= 0.4)


@F.pandas_udf(BooleanType())
def looks_banglish(texts: pd.Series) -> pd.Series:
    """Two distinct markers, or markers making up two fifths of the Latin words. By a set in Arrow batches: array functions look through the whole list for each word."""
    return texts.map(is_banglish, na_action="ignore").astype(object)


def detect_language(text: Column) -> Column:
    """en, bn, banglish, mixed or unknown; null and blank texts are unknown."""
    bangla, latin = has_bangla(text), text.rlike("[A-Za-z]")
    return (
        F.when(text.isNull(), "unknown").when(bangla & latin, "mixed").when(bangla, "bn").when(latin, F.when(looks_banglish(text), "banglish").otherwise("en")).otherwise("unknown")
    )


def shorten(token: str) -> str:
    """Characters written three times or more, once."""
    return re.sub(r"(.)\1{2,}", r"\1", token)


def _canonical(token: str) -> str:
    token = shorten(token.lower())
    return data.mapping("variants").get(token, token)


def fold_text(text: str) -> str:
    """Every Latin word in lower case and common spelling."""
    return re.sub(_LATIN, lambda m: _canonical(m[0]), text)


class _Tables:
    """Longest-match tables: for each state, the romanisations by length."""

    def __init__(self) -> None:
        vowels = data.rows("vowels")
        self.independent = {r[0]: r[1] for r in vowels}
        self.dependent = {r[0]: r[2] for r in vowels}
        self.consonants = data.mapping("consonants")
        self.longest = max(len(k) for t in (self.independent, self.consonants) for k in t)

    def match(self, table: dict[str, str], low: str, at: int) -> str | None:
        return next((low[at : at + n] for n in range(self.longest, 0, -1) if at + n <= len(low) and low[at : at + n] in table), None)


_tables: _Tables | None = None


def phonetic_token(token: str) -> str:
    """A romanised word in Bangla script: a vowel is a sign after a consonant and a letter elsewhere; what no table has stays."""
    global _tables
    tables = _tables = _tables or _Tables()
    low, at, out, after_consonant = token.lower(), 0, [], False
    while at < len(low):
        vowels = tables.dependent if after_consonant else tables.independent
        if key := tables.match(vowels, low, at):
            out.append(vowels[key])
            after_consonant = False
        elif key := tables.match(tables.consonants, low, at):
            out.append(tables.consonants[key])
            after_consonant = True
        else:
            key = token[at]
            out.append(key)
            after_consonant = False
        at += len(key)
    return "".join(out)


def phonetic_text(text: str) -> str:
    english = set(data.words("english"))
    return re.sub(_LATIN, lambda m: m[0] if m[0].lower() in english else phonetic_token(m[0]), text)


def transliterate_text(text: str) -> str:
    """The dictionary for each word that it has, then the phonetic rules for all other words but English ones."""
    known = data.mapping("words")
    return phonetic_text(re.sub(_LATIN, lambda m: known.get(_canonical(m[0]), m[0]), text))


@F.pandas_udf(StringType())
def transliterate(texts: pd.Series) -> pd.Series:
    return texts.map(transliterate_text, na_action="ignore")


@F.pandas_udf(StringType())
def normalize_romanised(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")
