"""Bounded heaps against sorting."""

import random

import pytest

from annalith.llm import topn


def test_equals_sorting(spark, monkeypatch):
    r = random.Random(4)
    rows = [(2001, r.choice(["hot", "hot", "a", None]), f"i{i:04d}" if i % 17 else None, r.choice([None, *range(6)]), r.randrange(3), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "year int, word string, article string, x int, y int, records int").repartition(5)
    expected = {}
    for y, w, a, x, z, _ in rows:
        e = expected.setdefault((y, w), [0, [], []])
        e[0] += 1
        for k, s in ((1, x), (2, z)):
            if a is not None and s is not None:
                e[k].append((-s, a))
    expected = {k: (n, [(-s, a) for s, a in sorted(v)[:4]], [(-s, a) for s, a in sorted(u)[:4]]) for k, (n, v, u) in expected.items()}
    found = {(q[0], q[1]): (q[2], [tuple(i) for i in q[3]], [tuple(i) for i in q[4]]) for q in topn.top_items(df, ["year", "word"], ["x", "y"], "article", 4).collect()}
    assert found == expected


def test_heap_is_bounded_and_ties_go_to_the_smaller_identifier():
    heap = []
    for i in "dbca":
        topn.offer(heap, 2, 5, i)
        assert len(heap) <= 2
    assert sorted(x.s for _, x in heap) == ["a", "b"]


def test_handing_on_early_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(topn, "GROUPS_HELD", 1)
    df = spark.createDataFrame([(k, f"i{n}", n) for n in range(20) for k in "abc"], "k string, i string, s int").coalesce(1)
    assert {r.k: [x.item for x in r.top_s] for r in topn.top_items(df, ["k"], ["s"], "i", 2).collect()} == {k: ["i19", "i18"] for k in "abc"}


def test_places_and_empty(spark):
    df = spark.createDataFrame([("k", "a", 3), ("k", "b", 5)], "k string, i string, s int")
    tops = topn.top_items(df, ["k"], ["s"], "i", 3)
    assert sorted(tuple(r) for r in topn.placed(tops, ["k"], ["s"]).collect()) == [("k", "s", 1, "b", 5), ("k", "s", 2, "a", 3)]
    assert topn.top_items(df.limit(0), ["k"], ["s"], "i", 3).collect() == []
    with pytest.raises(ValueError):
        topn.top_items(df, ["k"], ["s"], "i", 0)
