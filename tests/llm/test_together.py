"""Close pairs against brute force, the fitted null model, and its tails."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from annalith.llm import together


def model(rows, least, share):
    baskets = {}
    for b, t in rows:
        if b is not None and t:
            baskets.setdefault(b, set()).add(t)
    items, pairs = {}, {}
    for b, texts in baskets.items():
        near = set()
        for t in texts:
            a = re.findall("[a-z0-9]{5,}", t.lower())
            for x in set(a):
                items.setdefault(x, set()).add(b)
            near |= {tuple(sorted((a[i], a[j]))) for i in range(len(a)) for j in range(i + 1, min(i + 4, len(a))) if a[i] != a[j]}
        for p in near:
            pairs[p] = pairs.get(p, 0) + 1
    n = len(baskets)
    return {p: (len(items[p[0]]), len(items[p[1]]), k, n) for p, k in pairs.items() if k >= least and k >= share * n}


@pytest.mark.parametrize("hot", [10**9, 20])
def test_counts(spark, hot, monkeypatch):
    r = random.Random(6)
    words = [f"item{chr(97 + i)}x" for i in range(12)] + ["tiny", "a"]
    rows = [(f"b{r.randrange(40)}" if i % 3 else "hot", " ".join(r.choices(words, k=r.randrange(30)))) for i in range(300)]
    rows += rows[:50] + [(None, "itemax itembx"), ("b1", None), ("b2", ""), ("none", "- -"), ("long", "itemax itembx " * 20000)]
    monkeypatch.setattr(together, "HOT_ROWS", hot)
    monkeypatch.setattr(together, "HELD", 30)
    df = spark.createDataFrame(rows, "page_id string, text string").selectExpr("*", "1 AS n", "2 AS b")
    found = {(x.item_a, x.item_b): (x.n_a, x.n_b, x.n_ab, x.baskets) for x in together.close_pairs(df, "page_id", "text", min_count=3, min_share=0.05).collect()}
    assert found == model(rows, 3, 0.05) and found


@pytest.mark.parametrize("hot", [10**9, 20])
def test_pairs_do_not_vanish_as_the_table_grows(spark, hot, monkeypatch):
    r = random.Random(9)
    words = [f"item{chr(97 + i)}x" for i in range(12)]
    rows = [(f"b{i % 40}", " ".join(r.choices(words, k=r.randrange(30)))) for i in range(300)] + [("b1", " ".join(r.choices(words, k=9))) for _ in range(30)]
    rows += [(f"b{i}", "rareone raretwo") for i in (1, 2)] + [(f"more{i}", "filler") for i in range(2000)]
    monkeypatch.setattr(together, "HOT_ROWS", hot)
    monkeypatch.setattr(together, "HELD", 30)
    df = spark.createDataFrame(rows, "page_id string, text string")
    for least in (1, 2):
        out = together.close_pairs(df, "page_id", "text", min_count=least, min_share=None).collect()
        found = {(x.item_a, x.item_b): (x.n_a, x.n_b, x.n_ab, x.baskets) for x in out}
        assert found == model(rows, least, 0) and ("rareone", "raretwo") in found and len(out) == len(found)
    by_share = together.close_pairs(df, "page_id", "text", min_count=3, min_share=0.004).collect()
    scores = {(x.item_a, x.item_b): x.log10_p for x in out}
    assert by_share and all(math.isclose(x.log10_p, scores[(x.item_a, x.item_b)], rel_tol=1e-6, abs_tol=1e-9) for x in by_share)


def test_fit_keeps_sizes_and_frequencies():
    r = np.random.default_rng(7)
    x, y = r.uniform(0.1, 3, 30), r.uniform(0.05, 1, 50)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    null = together.fit(p.sum(1), np.ones(30), np.ones(30), p.sum(0), np.ones(50))
    q = null.chance(p.sum(0))  # items by classes of baskets
    assert np.allclose(q.sum(0), p.sum(1), rtol=1e-3) and np.allclose(q.sum(1), p.sum(0), rtol=1e-3)


def test_tail_against_exact_sums():
    p, w = np.array([0.02, 0.1, 0.3]), np.array([200, 50, 10])
    exact = np.array([1.0])
    for q, n in zip(p, w):
        for _ in range(n):
            exact = np.convolve(exact, [1 - q, q])
    k = np.array([20, 30, 45, 60])
    mean, tail = together.log_tail(np.tile(p, (4, 1)), w.astype(float), k)
    assert np.allclose(mean, (p * w).sum())
    for n, t in zip(k, tail):
        assert math.isclose(t, math.log(exact[n:].sum()), rel_tol=0.02)
    assert together.log_tail(p[None, :], w.astype(float), np.array([5]))[1][0] == 0


def test_planted_pair_is_discovered_and_noise_is_not(spark):
    r = random.Random(8)
    words = [f"noise{i:03d}" for i in range(60)]
    rows = []
    for i in range(400):
        t = r.choices(words, k=20)
        if i % 8 == 0:
            t[5:7] = ["plantedone", "plantedtwo"]
        rows.append((f"b{i}", " ".join(t)))
    df = spark.createDataFrame(rows, "page_id string, text string")
    out = together.discoveries(together.close_pairs(df, "page_id", "text")).where("significant").collect()
    assert {(x.item_a, x.item_b) for x in out} == {("plantedone", "plantedtwo")}


def cases(rows):
    return {p for p, (a, b, k, n) in model(rows, 3, 0.004).items() if k * n >= 8 * a * b}


def test_cases_that_the_null_model_expects_are_found(spark, tmp_path):
    from annalith.llm import plans

    dense = " ".join(f"word{i:02d} word{j:02d}" for i, j in itertools.combinations(range(8), 2))
    rows = [(f"d{i}", dense) for i in range(3)] + [(f"p{i}", "filler") for i in range(297)]
    df = spark.createDataFrame(rows, "page_id string, text string")
    df.write.parquet(f"{tmp_path}/year_history.parquet")
    assert all(x.log10_p > -1.301 for x in together.close_pairs(df, "page_id", "text").collect())
    found = [tuple(x) for x in plans.p4_found(spark, str(tmp_path)).collect()]
    assert set(found) == cases(rows) and len(found) == 28


@pytest.mark.parametrize("hot", [10**9, 20])
def test_baskets_without_items_count(spark, hot, tmp_path, monkeypatch):
    from annalith.llm import plans

    monkeypatch.setattr(together, "HOT_ROWS", hot)
    rows = [("none", f"- {i}") for i in range(50)] + [("b0", f"itemax itembx {i}") for i in range(50)]
    rows += [(f"b{i}", "itemax itembx") for i in (1, 2)] + [(f"p{i}", "filler") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id string, text string")
    df.write.parquet(f"{tmp_path}/year_history.parquet")
    for share in (0.004, None):
        out = together.close_pairs(df, "page_id", "text", min_share=share).collect()
        assert [(x.item_a, x.item_b, x.n_a, x.n_b, x.n_ab, x.baskets) for x in out] == [("itemax", "itembx", 3, 3, 3, 24)]
    assert [tuple(x) for x in plans.p4_found(spark, str(tmp_path)).collect()] == list(cases(rows)) == [("itemax", "itembx")]


def test_empty(spark):
    df = spark.createDataFrame([], "page_id string, text string")
    assert together.discoveries(together.close_pairs(df, "page_id", "text")).collect() == []
    assert together.close_pairs(spark.createDataFrame([("a", "- -")], "page_id string, text string"), "page_id", "text").collect() == []
    with pytest.raises(ValueError):
        together.close_pairs(df, "page_id", "text", min_share=0)


def test_classes():
    assert len({together.basket_class(s, c) for s, c in itertools.product((1, 50, 900), (0.0, 0.01, 1.0))}) == 9
