"""Operator 8: URL filters indexed by their rarest literal token.

A rule is a pattern of literal text, ``*`` (anything), ``^`` (a separator or the end) and ``||`` (the
start of a host name). Each rule with a literal token is stored under the one that the fewest URLs have;
the tokens of a URL fetch the rules stored under them, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: (rule_id, pattern, action). An allow rule outweighs block rules.
RULES: list[tuple[int, str, str]] = [
    (1, "||blog.*/de/", "block"), (2, "||m.*?page=", "block"), (3, "utm_source=feed", "block"), (4, "/fr/*.html", "block"),
    (5, "||www.*.example.org^", "block"), (6, "?page=2&ref=x", "block"), (7, "||thering.example.org^", "block"), (8, "/es/1", "block"),
    (9, "||ads.", "block"), (10, "/tracking/", "block"), (11, "||tionsh.example.net/en/1", "block"), (12, "#top", "block"),
    (13, "||blog.tionble.example.com^", "block"), (14, "/de/*?page=", "block"), (15, "casino", "block"), (16, ".example.com/es/", "block"),
    (17, "||m.*.example.org/en/", "block"), (18, "/login^", "block"), (19, "sessionid=", "block"), (20, "||therha.example.net/de/", "block"),
    (101, "||www.*/en/", "allow"), (102, "/en/*.html", "allow"), (103, "||tionsh.example.net/fr/", "allow"), (104, "/terms^", "allow"),
]


def rule_regex(pattern: str) -> str:
    """The regular expression of a pattern, for URLs in lower case; the same in Java and RE2."""
    p, head = pattern.lower(), ""
    if p.startswith("||"):
        head, p = r"^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?", p[2:]
    special = {"*": ".*", "^": r"([^a-z0-9_.%\-]|$)"}
    return head + "".join(special.get(c, re.sub(r"([^a-z0-9/=&:_#\-])", r"\\\1", c)) for c in p)


def rule_tokens(pattern: str) -> list[str]:
    """Tokens that every matching URL has as a whole: runs of letters and digits that the pattern bounds on both sides."""
    p = pattern.lower()
    anchored = p.startswith("||")
    p = p[2:] if anchored else p
    found = []
    for m in re.finditer(r"[a-z0-9]+", p):
        before = p[m.start() - 1] if m.start() else ("|" if anchored else "*")
        after = p[m.end()] if m.end() < len(p) else "*"
        if before != "*" and after != "*":
            found.append(m.group())
    return found


def match_rules(pages: DataFrame, rules: list[tuple[int, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, n_rules, rule_ids, decision) of every page.

    ``rule_ids`` lists the matching rules in ascending order, parted by commas. The decision is ``allow``
    if an allow rule matches or none does, else ``block``. URLs are compared in lower case. A null URL
    matches nothing; pages of null id are kept; rows that repeat stay so. Rules without a usable token are
    tried on every URL. Rules are broadcast: they are a list of the driver, not data.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    tokens = lambda u: F.array_distinct(F.regexp_extract_all(F.lower(u), F.lit("[a-z0-9]+"), F.lit(0)))
    words = sorted({t for _, p, _ in rules for t in rule_tokens(p)})
    # How many URLs have each token that a rule could be stored under.
    counted = rows.select(F.explode(tokens(F.col("url"))).alias("t")).where(F.col("t").isin(words)) if words else None
    df = {r["t"]: r["count"] for r in counted.groupBy("t").count().collect()} if words else {}  # a row a literal token of the rules at most
    stored: dict[str, list[int]] = {}
    general: list[int] = []
    for k, (_, pattern, _) in enumerate(rules):
        options = rule_tokens(pattern)
        if options:
            stored.setdefault(min(options, key=lambda t: (df.get(t, 0), t)), []).append(k)
        else:
            general.append(k)
    index = spark.sparkContext.broadcast((stored, general))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, general = index.value
        compiled: dict[int, re.Pattern[str]] = {}

        def hit(k: int, url: str) -> bool:
            if k not in compiled:
                compiled[k] = re.compile(rule_regex(rules[k][1]))
            return compiled[k].search(url) is not None

        for batch in batches:
            n, ids, decision = [], [], []
            for url in batch.column(2).to_pylist():
                tried = [k for t in set(re.findall("[a-z0-9]+", url)) for k in stored.get(t, ())] + general if url is not None else []
                hits = sorted((rules[k][0], rules[k][2]) for k in tried if hit(k, url))
                n.append(len(hits))
                ids.append(",".join(str(i) for i, _ in hits))
                decision.append("block" if hits and all(a != "allow" for _, a in hits) else "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decision, pa.string())], names=["page_id", "url", "n_rules", "rule_ids", "decision"])

    return rows.withColumn("low", F.lower("url")).mapInArrow(run, "page_id long, url string, n_rules long, rule_ids string, decision string")


SQL = (
    "WITH r(id, rx, action) AS (VALUES "
    + ", ".join(f"({i}, '{rule_regex(p)}', '{a}')" for i, p, a in RULES)
    + """), m AS (SELECT page_id, url, id, action FROM pages LEFT JOIN r ON regexp_matches(lower(url), rx))
SELECT page_id, url, CAST(count(id) AS BIGINT) AS n_rules, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS rule_ids,
CASE WHEN count(id) = 0 OR bool_or(action = 'allow') THEN 'allow' ELSE 'block' END AS decision FROM m GROUP BY page_id, url"""
)
