"""Per-key aggregation with heavy keys."""

import datetime as dt
import random

from annalith.operators import skew

SCHEMA = "year int, word string, article string, added int, removed int, emitted_at timestamp, extra string"


def at(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(seconds=n)


def test_totals_equal_brute_force_with_a_key_that_owns_half(spark):
    r = random.Random(1)
    rows = []
    for i in range(2000):
        word = "Hot!" if i % 2 else r.choice(["a", "B", "c-d", None, "é"])
        rows.append((r.choice([2001, 2001, 2001, None]), word, r.choice([None, *map(str, range(40))]), r.choice([None, 0, 3]), r.choice([None, 0, 2]), at(r.randrange(50)) if r.random() > 0.1 else None, "x"))
    rows += rows[:100]
    best = {}
    for y, w, a, add, rem, t, _ in rows:
        w = "".join(c for c in (w or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
        if w and a is not None:
            v = (t is not None, t or at(0), add or 0, rem or 0)
            best[y, w, a] = max(best.get((y, w, a), v), v)
    expected = {}
    for (y, w, _), (_, _, add, rem) in best.items():
        e = expected.setdefault((y, w), [0, 0, 0, 0, 0])
        for i, n in enumerate((add, rem, 1, add > 0, rem > 0)):
            e[i] += n
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(x.year, x.word): list(x[2:]) for x in skew.diff_totals(df, partitions=7).collect()}
    assert found == {k: [int(n) for n in v] for k, v in expected.items()}
    counts = {(x.year, x.word): x.article_count for x in skew.article_counts(df, partitions=7).collect()}
    assert counts == {k: v[2] for k, v in expected.items()}
    total = sum(counts.values())
    heavy = {(x.year, x.word) for x in skew.heavy_keys(skew.article_counts(df), 0.2).collect()}
    assert heavy == {k for k, n in counts.items() if n >= 0.2 * total}


def test_a_heavy_key_is_cut_into_ranges(spark):
    df = spark.range(20000).selectExpr("2001 AS year", "'hot' AS word", "cast(id AS string) AS article")
    sizes = skew.range_split(df, ["year", "word"], ["article"], 8).rdd.glom().map(len).collect()
    assert max(sizes) < 0.3 * sum(sizes)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert skew.diff_totals(df).collect() == []
    assert skew.heavy_keys(skew.article_counts(df)).collect() == []


def test_copies_are_merged_before_the_exchange(spark):
    df = spark.range(50_000).selectExpr("2012 AS year", "'mill' AS word", "if(id % 10000 = 0, cast(id AS string), 'same') AS article", "cast(null AS int) AS added", "1 AS removed", "timestamp'2020-01-01' AS emitted_at").coalesce(1)
    assert skew.copies_merged(df).count() < 50
    assert [tuple(r) for r in skew.article_counts(df).collect()] == [(2012, "mill", 6)]
    assert tuple(skew.diff_totals(df).first()) == (2012, "mill", 0, 6, 6, 0, 6)
    assert skew.copies_merged(df.limit(0)).collect() == []
