"""z-scores against the formula, word by word."""

import math
import random
import re
from collections import Counter

import pytest

from annalith.llm import distinctive


def model(rows, least, prior=500.0):
    records = {}
    for g, r, t in rows:
        f = Counter(re.findall("[a-z0-9]{3,}", (t or "").lower()))
        if g is not None and r is not None and f:
            records[g, r] = f
    out = {}
    for (g, r), f in records.items():
        mine = [v for (h, _), v in records.items() if h == g]
        size, c = sum(v.total() for v in mine), Counter()
        for v in mine:
            c.update(v)
        for w, n in f.items():
            if n >= least:
                a = prior * c[w] / size
                k = sum(w in v for v in mine)
                here = math.log((n + a) / max(f.total() + prior - n - a, 1e-9))
                rest = math.log((c[w] - n + a) / max(size - f.total() + prior - c[w] + n - a, 1e-9))
                out[g, r, w] = (n, f.total(), len(f), c[w], k, len(mine), round((here - rest) / math.sqrt(1 / (n + a) + 1 / (c[w] - n + a)), 6))
    return out


@pytest.mark.parametrize("least", [1, 3])
def test_scores(spark, least, monkeypatch):
    monkeypatch.setattr(distinctive, "HELD", 5)
    r = random.Random(5)
    words = ["the", "cat", "dog", "Ω", "x1y", "of", "river", "River"]
    rows = [(y, f"p{i}", " ".join(r.choices(words, k=r.randrange(40)))) for y in (2001, 2002) for i in range(12)]
    rows += [(2003, "only", "alone alone"), (2004, "p", None), (2004, "q", ""), (2004, "r", "-- !"), (None, "p", "cat"), (2001, None, "cat"), (2005, "long", "word " * 50000)]
    df = spark.createDataFrame(rows, "year int, page_id string, text string").selectExpr("*", "1 AS z", "2 AS term")
    found = {(x.year, x.page_id, x.term): (x.f, x.n, x.d, x.c, x.k, x.total, round(x.z, 6)) for x in distinctive.term_scores(df, "year", "page_id", "text", min_count=least).collect()}
    assert found == model(rows, least)


def test_own_words_come_first(spark):
    rows = [(1, f"p{i}", "the the the and and of " + f"own{i} " * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "year int, page_id string, text string")
    best = {}
    for x in distinctive.term_scores(df, "year", "page_id", "text").collect():
        best[x.page_id] = max(best.get(x.page_id, (-99, "")), (x.z, x.term))
    assert all(v[1] == "own" + k[1:] for k, v in best.items())


def test_empty(spark):
    assert distinctive.term_scores(spark.createDataFrame([], "year int, page_id string, text string"), "year", "page_id", "text").collect() == []


def test_case_that_another_text_outweighs(spark, tmp_path):
    from annalith.llm import plans

    rows = [(f"p{i}", 2012, "filler " * 250) for i in range(1700)]
    rows += [("a", 2012, "rareword " * 12 + " ".join(f"w{i:03d} " * 20 for i in range(149))), ("b", 2012, "rareword " * 3000)]
    spark.createDataFrame(rows, "page_id string, year int, text string").write.parquet(f"{tmp_path}/year_history.parquet")
    assert ("a", 2012, "rareword") in {tuple(x) for x in plans.p2_found(spark, str(tmp_path)).collect()}


def test_every_word_has_a_score(spark, tmp_path):
    from annalith.llm import plans

    rows = [(f"p{i}", 2012, " ".join(f"word{j}" for j in range(i, i + 30))) for i in range(4)]
    spark.createDataFrame(rows, "page_id string, year int, text string").write.parquet(f"{tmp_path}/year_history.parquet")
    found = plans.QUERIES["p2_scores"](spark, str(tmp_path)).collect()
    assert {(r.page_id, r.word) for r in found} == {(p, w) for p, _, t in rows for w in t.split()} and all(r.z is not None for r in found)
