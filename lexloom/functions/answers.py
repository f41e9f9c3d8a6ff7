"""Extractive answers: the type of a question, a span of the best sentence, prompts and refusals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .language import has_bangla

REFUSE_EN = "I could not find relevant context to answer this question."
REFUSE_BN = "এই প্রশ্নের উত্তর দেওয়ার জন্য প্রাসঙ্গিক তথ্য পাওয়া যায়নি।"
_ENGLISH = ["what", "who", "where", "when", "why", "how", "which", "whose"]
#: Looked for as substrings, in this order.
_BANGLA = [("কী", "what"), ("কি", "what"), ("কোথায়", "where"), ("কোথা\u09df", "where"), ("কখন", "when"), ("কে", "who"), ("কত", "how_many")]
_BANGLA += [("কেন", "why"), ("কেমন", "how")]
_ROMAN = {w: kind for kind, ws in {"what": "ki kee", "where": "kothay kothai", "when": "kokhon kokhono", "who": "ke", "why": "keno", "how": "kivabe kibhabe kemon", "how_many": "koto"}.items() for w in ws.split()}
_WORD = re.compile(r"[\wঀ-৿]+")
_END = r"[.।]?$"
_MONTHS_BN = sorted("জানুয়ারি ফেব্রুয়ারি মার্চ এপ্রিল মে জুন জুলাই আগস্ট সেপ্টেম্বর অক্টোবর নভেম্বর ডিসেম্বর".split(), reverse=True)
_IN_MONTH = {m: m + ("তে" if m[-1] in "িই" or m == "মে" else "ে") for m in _MONTHS_BN}
_MONTHS_EN = sorted(["May", "June", "July", "March", "April", "August", "January", "October", "February", "November", "December", "September"])


def question_type(question: str) -> str:
    low = question.lower().strip()
    words = set(re.findall(r"\w+", low))
    for w in _ENGLISH:
        if w in words:
            return w
    for mark, kind in _BANGLA:
        if mark in question:
            return kind
    return next((_ROMAN[t] for t in re.findall("[a-zA-Z]+", low) if t in _ROMAN), "other")


def _find(pattern: str, text: str, group: int = 1, flags: int = 0) -> str | None:
    m = re.search(pattern, text, flags)
    return m[group].strip() if m else None


def _what(question: str, sent: str) -> str | None:
    low = question.lower()
    capital = "capital" in low or "rajdhani" in low or "রাজধানী" in question
    if m := re.match(rf"(.+?)\s+is\s+(?:the\s+)?(.+?){_END}", sent, re.I):
        return m[1 if capital else 2].strip()
    if capital:
        for head in (r"\S+\s+er", r"\S+?-?er"):
            if m := re.match(rf"{head}\s+(?:capital|rajdhani)\s+(\S+?){_END}", sent, re.I):
                return m[1].strip()
        words = sent.rstrip("।.").split()
        if re.search("[ঀ-৿]", sent) and len(words) > 1:
            return words[0]
    for verb in (r"\S*ের", "হয়"):
        if m := re.match(rf".+?\s+{verb}\s+(.+?){_END}", sent):
            return m[1].strip()
    return None


def _who(question: str, sent: str) -> str | None:
    if m := re.match(r"(.+?)\s+(?:is|was)\s+(?:an |a |born)", sent, re.I):
        return m[1].strip()
    words = sent.rstrip("।.").split()
    return words[0] if re.search(r"জন্মগ্রহণ\s+করেন", sent) and words else None


#: (pattern, flags) tried in order, by type of question; the first group is the answer.
_PATTERNS = {
    "where": [
        (rf"\bis\s+in\s+(.+?){_END}", re.I), (rf"\bis\s+(?:situated|located)\s+in\s+(.+?){_END}", re.I), (rf"অবস্থিত\s+(.+?){_END}", 0), (rf"অবস্থান\s+(.+?){_END}", 0),
        (rf"(?:দেশ|রাজধানী|শহর|নদী)\s+(\S+?(?:ত|তে|ে)){_END}", 0),
    ],
    "when": [
        ("(" + "|".join(_IN_MONTH.values()) + ")", 0), (r"(\d{4}\s*সালে|\d{1,2}\s*(?:" + "|".join(_MONTHS_BN) + "))", 0), (r"\b((?:18|19|20)\d\d)\b", 0),
        (r"\b(" + "|".join(_MONTHS_EN) + r")\b", re.I),
    ],
    "how_many": [(r"(\d+(?:,\d{3})*(?:\.\d+)?)", 0), ("([০-৯]+)", 0)],
    "how": [(rf"\bby\s+(.+?){_END}", re.I)],
}


def answer_span(question: str, passage: str, kind: str) -> str | None:
    parts = [s.strip() for s in re.split(r"(?<=[।.!?])\s+", passage.strip()) if s.strip()]
    if not parts:
        return None
    asked = set(_WORD.findall(question.lower()))
    best = max(parts, key=lambda s: len(asked & set(_WORD.findall(s.lower()))))
    if kind == "what":
        return _what(question, best)
    if kind == "who":
        return _who(question, best)
    return next((found for pattern, flags in _PATTERNS.get(kind, []) if (found := _find(pattern, best, flags=flags))), None)


def extract(question: str, passage: str) -> str:
    """A span of the first line of the passage, or that line, with its citation."""
    line = passage.split("\n")[0].strip()
    if not line:
        return REFUSE_EN
    return f"{answer_span(question.strip(), line, question_type(question.strip())) or line} [1]"


@F.pandas_udf(StringType())
def question_type_udf(questions: pd.Series) -> pd.Series:
    return questions.map(question_type, na_action="ignore")


@F.pandas_udf(StringType())
def extract_udf(questions: pd.Series, passages: pd.Series) -> pd.Series:
    return pd.Series([extract(q, p) if isinstance(q, str) and isinstance(p, str) else None for q, p in zip(questions, passages)])


def refusal(question: Column) -> Column:
    return F.when(has_bangla(question), REFUSE_BN).otherwise(REFUSE_EN)


def format_context(passages: Column) -> Column:
    """Passages (source, page, text) as numbered lines."""
    place = lambda p: F.concat(F.coalesce(F.nullif(p["source"], F.lit("")), F.lit("unknown")), F.coalesce(F.concat(F.lit(", page "), p["page"].cast("string")), F.lit("")))
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), place(p), F.lit(") "), p["text"])), "\n")


def build_prompt(question: Column, passages: Column) -> Column:
    tail = "\n\nName passages by number, like [1]. Use their words only, briefly, in the language of the question. If they have no answer, reply: " + REFUSE_EN + "\n\nAnswer:"
    return F.concat(F.lit("Answer from this evidence alone.\n\nEvidence:\n"), format_context(passages), F.lit("\n\nQuestion: "), question, F.lit(tail))


def trim_verbose(text: str) -> str:
    """Of more than 300 characters three sentences at most, up to the first with a citation; a citation that was lost is added."""
    parts = re.split(r"(?<=[।.!?])\s+", text)
    if len(text) <= 300 or len(parts) < 2:
        return text
    cited = [bool(re.search(r"\[\d+\]", p)) for p in parts[:3]]
    n = cited.index(True) + 1 if True in cited else 3
    short = " ".join(parts[:n]).strip()
    first = re.search(r"\[\d+\]", text)
    return f"{short} {first[0]}" if first and not re.search(r"\[\d+\]", short) else short
