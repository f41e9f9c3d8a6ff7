"""Each operator against brute force or by its invariants, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from lexloom.llm import decontaminate, jaccard, licenses, packing, quality, sharding, substrings, token_counts, topk, url_filters
from lexloom.llm.queries import TOKENIZER
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
prose = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)


def clash(df):
    """The same rows with columns named like those that the operators make."""
    return df.withColumns({c: F.lit("x") for c in ("n_tokens", "gid", "anchor", "rank", "items", "score", "keep", "text_", "h", "s", "b", "n")})


@pytest.fixture(scope="module")
def base():
    shared, long = prose(70), prose(20000)
    rows = [(i, prose(rng.randint(1, 200)), f"s{i % 3}" if i % 9 else None) for i in range(40)]
    rows += [(100, prose(40) + " " + shared + " " + prose(30), "s0"), (101, prose(10) + "\n" + shared, "s1"), (102, shared + " " + prose(60), "s0")]
    near = rows[20][1].split() + prose(80).split()
    rows += [(110, " ".join(near), "s0"), (111, " ".join(near[:40] + ["zzz"] + near[41:]), "s0"), (112, " ".join(near), "s1"), (113, " ".join(near), "s1")]
    return rows + [(120, long, "s2"), (121, None, "s2"), (122, "", "s0"), (123, " \n ", "s0"), (None, "no id here", "s0"), (124, "one", "s0"), (125, "the " * 300, None), (5, rows[5][1], rows[5][2])]


EMPTY = []


def test_token_counts(spark, base):
    enc = token_counts.encoder(TOKENIZER)
    got = token_counts.token_counts(clash(table(spark, base)), TOKENIZER, batch_bytes=3000, split_bytes=500).collect()
    want = sorted((str(i), str(None if t is None else enc([t])[0])) for i, t, _ in base)
    assert sorted((str(r[0]), str(r[1])) for r in got) == want
    odd = "a  b\n\n c's it's 12 3!? é x" * 50 + " " * 700 + "x y" * 300
    cuts = token_counts.safe_cuts(odd.encode(), 40)
    assert len(cuts) > 20 and sum(enc([odd.encode()[a:b].decode() for a, b in zip(cuts, cuts[1:])])) == enc([odd])[0]
    assert token_counts.token_counts(table(spark, EMPTY), TOKENIZER).count() == 0


@pytest.mark.parametrize("every", [1, 3])
def test_topk(spark, every):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 20)).astype(np.float32)
    x[7] = x[3]
    x[9] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)]
    lower = [float(v) for v in x[6]]
    lower[0] -= 50  # of the repeats of an id the least vector counts
    bad = [(90, None), (92, [float("nan")] * 20), (93, [float("inf")] * 20), (94, [None] * 20), (95, []), (None, rows[0][1]), rows[5], (6, lower)]
    short = [(100 + i, [float(i), float(i % 3), 1.0]) for i in range(5)]  # another length, searched by itself; fewer than k others
    x[6] = lower
    df = spark.createDataFrame(rows + bad + short, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    got = {}
    for q in topk.topk_search(df, 5, block_rows=16, every=every).orderBy("query_id", "rank").collect():
        got.setdefault(q["query_id"], []).append((q["neighbor_id"], round(q["distance"], 4)))
    want = {}
    for ids, m in ((range(60), x.astype(float)), ([i for i, _ in short], np.array([v for _, v in short]))):
        d = ((m[:, None] - m[None]) ** 2).sum(2)
        for a, i in enumerate(ids):
            if i % every == 0:
                want[i] = [(j, round(v**0.5, 4)) for v, j in sorted((d[a, b], j) for b, j in enumerate(ids) if j != i)[:5]]
    assert got == want
    assert topk.topk_search(df.limit(0)).count() == 0


def spread(spark, rows, parts=1):
    return table(spark, rows).coalesce(1) if parts == 1 else table(spark, rows).repartition(parts)


def test_packing(spark, base):
    for parts in (1, 4):
        got = packing.pack(clash(spread(spark, base, parts)), capacity=256, open_windows=3).collect()
        seen = {}
        for w in got:
            assert 0 < w["used"] <= 256 and w["used"] == sum(i["length"] for i in w["items"]) and w["n_docs"] == len(w["items"])
            for i in w["items"]:
                seen.setdefault(i["doc_id"], []).append((i["start"], i["length"]))
        want = {}
        for i, t, _ in base:
            if i is not None and t and t.split():
                want[i] = want.get(i, 0) + len(t.split())
        assert {k: sum(n for _, n in v) for k, v in seen.items()} == want
        assert len({w["window_id"] for w in got}) == len(got)
    assert packing.pack(table(spark, EMPTY)).count() == 0


def test_packing_is_the_stated_algorithm():
    sizes = [rng.randint(1, 100) for _ in range(200)]
    bins, out = packing.OpenWindows(100, 4), []
    for k, n in enumerate(sizes):
        out += bins.place(n, [k])
    open_, want = [], []
    for k, n in enumerate(sizes):  # the same by plain search
        fits = [b for b in open_ if sum(sizes[i] for i in b) + n <= 100]
        if fits:
            b = max(fits, key=lambda b: sum(sizes[i] for i in b))
            b.append(k)
        else:
            if len(open_) == 4:
                full = max(open_, key=lambda b: sum(sizes[i] for i in b))
                open_.remove(full)
                want.append(full)
            b = [k]
            open_.append(b)
        if sum(sizes[i] for i in b) == 100:
            open_.remove(b)
            want.append(b)
    assert [i for _, i in out] == want and [i for _, i in bins.open] == open_


def test_quality(spark):
    bad_words = ["slur", "trashy", "vile"]
    rows, labels = [], []
    for i in range(2000):  # with few labels the quantile is too rough to test
        t, kind = prose(60), i % 4
        if kind == 0:
            t += " " + rng.choice(bad_words) + " " + prose(5)
        if kind == 1:
            t = "JUNK!!! " * 40
        rows.append((i, t, "s"))
        if i < 1600:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs = table(spark, [*rows, (None, "x", "s"), (7000, None, "s"), (7001, "", "s"), (3, rows[3][1], "s")])
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 1), (1801, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(clash(docs), marks, quantile=0.01)
    kept = {r["doc_id"] for r in quality.scores(docs, model).where("keep").collect()}
    held = range(1600, 2000)
    assert sum(i in kept for i in held if i % 4 > 1) >= 190 and sum(i not in kept for i in held if i % 4 < 2) >= 194
    out = quality.keep_documents(docs, model)
    assert out.columns == docs.columns and out.where("doc_id = 3").count() in (0, 2)
    nothing = quality.train(docs, marks.limit(0))
    assert quality.keep_documents(docs, nothing).count() == docs.where("doc_id IS NOT NULL").count()
    assert quality.keep_documents(table(spark, EMPTY), model).count() == 0


def test_sharding(spark, base):
    df = table(spark, base)
    got = sorted(map(str, (tuple(r) for r in sharding.shards(clash(df), 64, buckets=16).collect())))
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(str((a, b, c, d)) for a, b, c, d in con.execute(sharding.SQL).fetchall())
    assert got == want
    shards = sharding.shards(df, 4).groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1
    assert sharding.shards(table(spark, EMPTY)).count() == 0


def brute_spans(rows, width):
    seen = {}
    texts = [(i, t.split()) for i, t, _ in rows if i is not None and t]
    for i, w in texts:
        for p in range(len(w) - width + 1):
            seen.setdefault(tuple(w[p : p + width]), []).append((i, p))
    kept, other = {}, {}
    for places in seen.values():
        if len(places) > 1:
            for n, (i, p) in enumerate(sorted(places)):
                (kept if n == 0 else other).setdefault(i, set()).update(range(p, p + width))
    cut = {(i, q) for i, s in other.items() for q in s} - {(i, q) for i, s in kept.items() for q in s}
    return cut, {(i, q) for i, s in kept.items() for q in s}


def test_substrings(spark, base):
    for width in (50, 20):
        got = substrings.repeated_spans(clash(table(spark, base)), width).collect()
        cut, kept = brute_spans(base, width)
        tokens = lambda what: {(r["doc_id"], q) for r in got if r["action"] == what for q in range(r["start_token"], r["end_token"])}
        assert tokens("remove") == cut and tokens("keep") == kept
        ends = sorted((r["doc_id"], r["action"], r["start_token"], r["end_token"]) for r in got)
        assert all(a[:2] != b[:2] or a[3] < b[2] for a, b in zip(ends, ends[1:]))  # maximal
    out = {(r["doc_id"]): r for r in substrings.remove_repeats(table(spark, base)).collect()}
    assert set(out) == {i for i, _, _ in base} - {112, 113}  # whole copies are gone, white space that was there is not
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in out.values())
    assert out[102]["text"].split() == dict((i, t) for i, t, _ in base)[102].split()[70:]
    assert substrings.repeated_spans(table(spark, EMPTY)).count() == 0 and substrings.remove_repeats(table(spark, EMPTY)).count() == 0


def test_substring_groups_across_batches(spark, base):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_substrings(spark, base[:50])
    except AssertionError:
        rows = base[:50]
        got = substrings.repeated_spans(table(spark, rows), 20).where("action = 'remove'").collect()
        assert {(r["doc_id"], q) for r in got for q in range(r["start_token"], r["end_token"])} == brute_spans(rows, 20)[0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    for _ in range(200):
        a, b = np.random.default_rng(_).integers(0, 4, 12).astype(np.uint64), np.random.default_rng(_ + 999).integers(0, 4, 11).astype(np.uint64)
        assert decontaminate.edit_distance(a, b, 99) == levenshtein(a.tolist(), b.tolist())


def test_decontamination_recall(spark, base):
    items = [(k, prose(rng.randint(14, 50))) for k in range(30)]
    rows, want = list(base), set()
    for k in range(150):
        item, text = items[k % 30]
        w = text.split()
        for _ in range(rng.randint(0, int(0.2 * len(w)))):
            p, kind = rng.randrange(len(w)), rng.random()
            w[p : p + 1] = [] if kind < 0.3 and len(w) > 3 else [rng.choice(VOCAB)] if kind < 0.7 else [w[p], rng.choice(VOCAB)]
        before = words(prose(rng.randint(0, 60)))
        doc = before + w + words(prose(rng.randint(0, 60)))
        rows.append((1000 + k, " ".join(doc).upper(), "s"))
        n = len(text.split())
        if min(levenshtein(text.split(), doc[p : p + n]) for p in range(max(1, len(doc) - n + 1))) <= int(0.2 * n):
            want.add((1000 + k, item))
    bench = spark.createDataFrame([*items, (None, "x"), (40, None), (41, "!!"), items[3]], "item_id long, text string")
    got = decontaminate.leaks(clash(table(spark, rows)), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(want & found) >= 0.95 * len(want) and len(want) > 100
    text_of, by_item = {i: t for i, t, _ in rows}, dict(items)
    for r in got:  # every finding is within the edits
        a, w = by_item[r["item_id"]].split(), words(text_of[r["doc_id"]])[r["start_token"] : r["end_token"]]
        assert levenshtein(a, w) == r["edits"] <= 0.2 * len(a)
    left = {r["doc_id"] for r in decontaminate.without_leaks(table(spark, rows), bench).collect()}
    assert left == {i for i, _, _ in rows} - {d for d, _ in found}
    assert decontaminate.leaks(table(spark, EMPTY), bench).count() == 0
    assert decontaminate.leaks(table(spark, base), bench.limit(0)).count() == 0


def test_url_filters(spark):
    urls = ["https://blog.a.example.com/de/1", "http://m.x.org/?page=2&ref=x", "https://www.b.example.org/en/7.html#top", None, "", "HTTP://THERING.EXAMPLE.ORG/a", "http://ads.z/tracking/1", "x" * 5000 + "casino"]
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)] + [(None, urls[0], "")], "page_id long, url string, html string").withColumn("decision", F.lit(1))
    for r in url_filters.match_rules(df).collect():
        hits = sorted((i, a) for i, p, a in url_filters.RULES if r["url"] is not None and re.search(url_filters.rule_regex(p), r["url"].lower()))
        assert r["rule_ids"] == ",".join(str(i) for i, _ in hits) and r["n_rules"] == len(hits)
        assert r["decision"] == ("block" if hits and all(a == "block" for _, a in hits) else "allow")
    assert url_filters.match_rules(df).count() == len(urls) + 1 and url_filters.match_rules(df.limit(0)).count() == 0


def gram_sets(rows):
    """{(id, set of 3-grams)} of the documents with an id."""
    out = set()
    for i, t, _ in rows:
        w = words(t) if t else []
        if i is not None:
            out.add((i, frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])))
    return sorted(out, key=lambda x: (x[0], sorted(x[1])))


def brute_classes(rows, least):
    """(doc_id, class_id, n_links) by comparing all with all."""
    docs = gram_sets(rows)
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(docs):
        for b, (_, y) in enumerate(docs[a + 1 :], a + 1):
            if x and y and len(x & y) >= least * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d[0], docs[find(k)][0], links[k]) for k, d in enumerate(docs))


def varied(of, times, share):
    """Copies of random documents with a share of their words replaced."""
    out = []
    for k in range(of):
        w = prose(rng.randint(30, 120)).split()
        for c in range(rng.randint(2, times)):
            v = list(w)
            for _ in range(rng.randint(0, int(len(v) * share))):
                v[rng.randrange(len(v))] = rng.choice(VOCAB)
            out.append((2000 + 100 * k + c, " ".join(v), "s"))
    return out


def test_jaccard(spark, base):
    rows = base + varied(50, 5, 0.12) + [(101, "other text of the same id", "s"), (300, None, "s"), (301, "?!", "s")]
    got = sorted(map(tuple, jaccard.near_classes(clash(table(spark, rows))).collect()))
    want = brute_classes(rows, 0.5)
    assert got == want and sum(n > 0 for _, _, n in got) > 100
    con = duckdb.connect()
    con.register("documents", table(spark, rows).toPandas().astype({"doc_id": "Int64"}))
    assert sorted(con.execute(jaccard.SQL).fetchall()) == want
    kept = {r["doc_id"] for r in jaccard.one_of_each(table(spark, rows)).collect()}
    assert kept == {i for i, _, _ in rows} - {i for i, c, _ in want if c < i}
    assert jaccard.near_classes(table(spark, EMPTY)).count() == 0 and jaccard.one_of_each(table(spark, EMPTY)).count() == 0


def test_licenses(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    cases = [
        (1, mit, {("text", "MIT")}), (2, "Copyright (c) 2024 A. Person\nAll rights reserved.\n\n" + mit.upper().replace("LICENSE", "LICENCE"), {("text", "MIT")}),
        (3, "Prose.\nReleased under the MIT Licence!\nMore.", {("line", "MIT")}), (4, "licensed under CC BY NC 4 0", {("line", "CC-BY-NC-4.0"), ("text", "CC-BY-NC-4.0")}), (5, "Copyright of ideas is a topic", set()),
        (6, None, set()), (7, "", set()), (8, "\n\n!!\n", set()), (9, mit + " more", set()), (10, prose(5000), set()), (None, "SPDX-License-Identifier: MIT", {("text", "MIT"), ("line", "MIT")}),
    ]
    got = {}
    for r in licenses.license_scan(clash(table(spark, [(i, t, "s") for i, t, _ in cases]))).collect():
        got.setdefault(r["doc_id"], set()).add((r["unit"], r["license"]))
        assert r["n"] == 1
    assert got == {i: s for i, _, s in cases if s}
    assert licenses.license_scan(table(spark, EMPTY)).count() == 0


def test_kernel_hashes():
    from lexloom.llm import kernels

    texts = ["a bb a", None, "", "bb  é,a\n", " ", "a"]
    tok = kernels.tokenise(pa.array(texts))
    got = [tok.data[a:b].tobytes().decode() for a, b in zip(tok.starts, tok.ends)]
    assert got == ["a", "bb", "a", "bb", "é", "a", "a"] and tok.counts.tolist() == [3, 0, 0, 3, 0, 1]
    assert len({(t, int(h)) for t, h in zip(got, tok.hashes)}) == 3 and kernels.tokenise(pa.array(texts).slice(3, 1)).hashes.tolist() == tok.hashes[3:6].tolist()
    assert kernels.sliding_min(np.array([5, 3, 4, 1, 2, 9]), 3).tolist() == [3, 1, 1, 1]
