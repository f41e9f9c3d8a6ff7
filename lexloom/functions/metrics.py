"""Ranking and answer metrics as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import data
from .text import strip, tokens

_CITATION = r"\[([0-9]+)\]"
#: What an honest refusal says, in English or Bangla.
REFUSALS = [
    "জানি না", "তথ্য.*পাওয়া.*যায়নি", "প্রাসঙ্গিক.*তথ্য.*নেই", "unable to (?:find|answer)", "do(?:n't| not) know", "(?:could |can)not find",
    "not (?:enough )?(?:evidence|context|information)", "no (?:relevant )?(?:passage|evidence|information|context)",
]
REFUSAL = "|".join(f"(?:{r})" for r in REFUSALS)


def _first(ranked: Column, k: int) -> Column:
    return F.slice(ranked, 1, k)


def hit_at_k(relevant: Column, ranked: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(_first(ranked, k), relevant), F.lit(False)).cast("double")


def recall_at_k(relevant: Column, ranked: Column, k: int) -> Column:
    n = F.size(F.array_distinct(relevant))
    return F.when(n > 0, F.size(F.array_intersect(_first(ranked, k), relevant)) / n).otherwise(0.0)


def reciprocal_rank(relevant: Column, ranked: Column) -> Column:
    """1 / rank of the first relevant id, over the whole list."""
    at = F.array_min(F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1 / at, F.lit(0.0))


def ndcg_at_k(relevant: Column, ranked: Column, k: int) -> Column:
    """Binary gains; repeated ids among the first k count once, at the place they have without repeats."""
    gains = F.transform(F.array_distinct(_first(ranked, k)), lambda x, i: F.when(F.array_contains(relevant, x), 1 / F.log2(i + 2.0)).otherwise(0.0))
    n = F.least(F.size(F.array_distinct(relevant)), F.lit(k))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ideal = total(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: 1 / F.log2(i + 1.0)))
    return F.when(n > 0, total(gains) / ideal).otherwise(0.0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def marked_hit(marks: Column, k: int) -> Column:
    """The four metrics from ``marks``, which say of each id of a ranked list without repeats whether it is relevant, and ``n``, how many are: a task then needs no list of the relevant ids."""
    return F.exists(_first(marks, k), lambda x: x).cast("double")


def marked_recall(marks: Column, n: Column, k: int) -> Column:
    return F.when(n > 0, F.size(F.filter(_first(marks, k), lambda x: x)) / n).otherwise(0.0)


def marked_rr(marks: Column) -> Column:
    at = F.array_position(marks, True)
    return F.when(at > 0, 1 / at).otherwise(0.0)


def marked_ndcg(marks: Column, n: Column, k: int) -> Column:
    gains = F.transform(_first(marks, k), lambda x, i: F.when(x, 1 / F.log2(i + 2.0)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1))), lambda i: 1 / F.log2(i + 1.0))
    return F.when(n > 0, _total(gains) / _total(ideal)).otherwise(0.0)


def word_set(text: Column) -> Column:
    """Distinct words that are not all digits."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: ~t.rlike(r"^\p{Nd}+$"))


def content_words(text: Column) -> Column:
    return F.array_except(word_set(text), F.array(*[F.lit(w) for w in data.words("stopwords")]))


def without_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, _CITATION, "")


def is_refusal(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(f"(?iu){REFUSAL}")


def answer_accuracy(answer: Column, expected: Column, mode: str = "substring") -> Column:
    """How far the answer gives what was expected: as a substring, as a share of its content words, or exactly."""
    said, wanted = F.lower(strip(without_citations(answer))), F.lower(strip(expected))
    contains = F.contains(said, wanted).cast("double")
    if mode == "exact":
        value = (said == wanted).cast("double")
    elif mode == "token":
        words = content_words(wanted)
        value = F.when(F.size(words) == 0, contains).otherwise(F.size(F.array_intersect(words, word_set(said))) / F.size(words))
    else:
        value = contains
    return F.when((F.coalesce(answer, F.lit("")) == "") | (F.coalesce(expected, F.lit("")) == ""), 0.0).otherwise(value)


def _supported(words: Column, passages: Column, need: Column) -> Column:
    return F.exists(passages, lambda p: F.size(F.array_intersect(words, word_set(p))) >= need)


def faithfulness(answer: Column, passages: Column) -> Column:
    """1 if two content words of the answer (one, if it has but one) stand in one passage; also if it has none."""
    words = content_words(without_citations(answer))
    empty = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(F.size(passages), F.lit(0)) <= 0)
    return F.when(empty, 0.0).when(F.size(words) == 0, 1.0).otherwise(_supported(words, passages, F.least(F.size(words), F.lit(2))).cast("double"))


def is_grounded(answer: Column, passages: Column) -> Column:
    """As faithfulness, but question words count as content, and an answer of one word is looked up as it is."""
    questions = ["what", "where", "when", "who", "why", "how", "which", "whose", "কি", "কী", "কোথায়", "কখন", "কে", "কেন", "কিভাবে", "কীভাবে"]
    stop = [w for w in data.words("stopwords") if w not in questions]
    words = word_set(without_citations(answer))
    content = F.array_except(words, F.array(*[F.lit(w) for w in stop]))
    content = F.when(F.size(words) < 2, words).otherwise(content)
    return F.when(F.size(passages) <= 0, False).when(F.size(content) == 0, True).otherwise(_supported(content, passages, F.least(F.size(content), F.lit(2))))


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(_CITATION), F.lit(1)), lambda n: n.cast("int"))


def citation_accuracy(answer: Column, passages: Column) -> Column:
    """The share of citations, repeats counted, whose passage exists and has a content word of the answer."""
    words, cited = content_words(without_citations(answer)), citations(answer)
    right = F.filter(cited, lambda n: (n >= 1) & (n <= F.size(passages)) & (F.size(F.array_intersect(words, word_set(F.get(passages, n - 1)))) > 0))
    return F.when(F.coalesce(F.size(cited), F.lit(0)) <= 0, 0.0).when(F.coalesce(F.size(passages), F.lit(0)) <= 0, 0.0).otherwise(F.size(right) / F.size(cited))


def refusal_accuracy(answer: Column, should_refuse: Column) -> Column:
    return (is_refusal(answer) == should_refuse).cast("double")


def ensure_citation(answer: Column) -> Column:
    return F.when(answer.rlike(_CITATION), answer).otherwise(F.concat(answer, F.lit(" [1]")))


def answer_scores(answer: Column, expected: Column, passages: Column, should_refuse: Column, mode: str = "substring") -> Column:
    """All four as a struct; where a refusal is right there is no claim to verify and nothing to cite."""
    return F.struct(
        F.when(should_refuse, is_refusal(answer).cast("double")).otherwise(answer_accuracy(answer, expected, mode)).alias("answer_accuracy"),
        F.when(should_refuse, 1.0).otherwise(faithfulness(answer, passages)).alias("faithfulness"),
        F.when(should_refuse, 1.0).otherwise(citation_accuracy(answer, passages)).alias("citation_accuracy"),
        refusal_accuracy(answer, should_refuse).alias("refusal_accuracy"),
    )
