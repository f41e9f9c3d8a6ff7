"""Operators over the whole of their job: every pair of copies, long items."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from lexloom.llm import decontaminate, jaccard, quality

from test_operators import brute_classes, prose, table, words


def test_no_pair_at_the_threshold_is_missed(spark):
    """3,000 pairs of 150 n-grams each with 100 in common, so with an index of exactly 0.5, and as many with 99."""
    w = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows, want = [], []
    for k in range(6000):
        common = 102 if k < 3000 else 101
        at = 1000 * k
        rows += [(2 * k, w(at, at + 152), "s"), (2 * k + 1, w(at + 152 - common, at + 304 - common), "s")]
        want += [(2 * k, 2 * k, int(k < 3000)), (2 * k + 1, 2 * k if k < 3000 else 2 * k + 1, int(k < 3000))]
    assert sorted(map(tuple, jaccard.near_classes(table(spark, rows)).collect())) == want


@pytest.mark.parametrize("part_tokens", [200, 1 << 20])
def test_large_groups_of_near_copies(spark, part_tokens):
    """Groups that are divided, boilerplate that unlike documents share, and copies of copies."""
    base, passage = prose(90).split(), prose(70)
    rows = [(i, " ".join(base[: 3 * (i % 7)] + [f"x{i % 40}"] + base[3 * (i % 7) + 1 :]), "s") for i in range(150)]
    rows += [(1000 + i, passage + " " + prose(40), "s") for i in range(60)] + [(2000 + i, passage + " " + prose(90), "s") for i in range(60)]
    rows += [(3000 + i, " ".join(f"c{j}" for j in range(9 * i, 9 * i + 60)), "s") for i in range(30)]  # a chain, linked neighbour to neighbour
    want = brute_classes(rows, 0.5)
    assert sorted(map(tuple, jaccard.near_classes(table(spark, rows), part_tokens=part_tokens).collect())) == want
    assert {c for i, c, _ in want if i >= 3000} == {3000} and max(n for _, _, n in want) > 100


def test_decontamination_of_long_items():
    """Random copies of long items at the limit of edits agree with the item in one of its repetitions."""
    r = np.random.default_rng(3)
    for n in (200, 400, 800):
        index = decontaminate.build_index([1], [" ".join(f"w{k}" for k in r.integers(0, 1 << 40, n))], 0.2, 0.99, 0.45, 2, 7)
        copies = np.tile(index.words[0], (60, 1))
        for c in copies:
            c[r.choice(n, n // 5, replace=False)] = r.integers(0, 1 << 63, n // 5, dtype=np.int64).astype(np.uint64)
        keys = decontaminate.cgk_keys(copies, np.full(60, n), index.steps[: index.reps[0]])
        assert (keys == index.keys[: index.reps[0]]).any(0).sum() >= 58
    item = prose(200)
    copy = item.split()
    for p in range(0, 200, 5):
        copy[p] = f"x{p}"
    index = decontaminate.build_index([1, 2], [item, prose(20)], 0.2, 0.99, 0.45, 2, 7)
    assert (0, 0, 30, 230, 40) in list(decontaminate.scan(pa.array([" ".join(words(prose(30)) + copy + words(prose(9))), None, "x"]), index))


def test_quality_threshold_over_all_labels(spark):
    rows = [(i, prose(60) if i % 4 else "JUNK!!! " * 40, "s") for i in range(2000)]
    marks = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.train(table(spark, rows), marks, sample=100, quantile=0.1)
    clean = np.sort([r["score"] for r in quality.scores(table(spark, rows), model).where("doc_id % 4 > 0").collect()])
    assert abs((clean < model.threshold).mean() - 0.1) < 0.01  # 1,500 scores, of which some 80 were trained on
