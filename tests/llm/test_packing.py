"""Containers: nothing lost, nothing over, only too long items cut, little room left."""

import random
from collections import defaultdict

from annalith.llm import packing


def check(items, rows, capacity):
    """Every item once and whole, or cut into full pieces and a rest; no container over its capacity."""
    by_item, load = defaultdict(list), defaultdict(int)
    for container, item, start, length in rows:
        by_item[item].append((start, length))
        load[container] += length
    assert max(load.values()) <= capacity
    assert set(by_item) == set(items)
    for item, size in items.items():
        parts = sorted(by_item[item])
        assert parts[0][0] == 0 and sum(n for _, n in parts) == max(size or 0, 0)
        assert all(n == capacity and s + n == t for (s, n), (t, _) in zip(parts, parts[1:]))
        assert len(parts) == max(1, -(-max(size or 0, 0) // capacity))
    return load


def test_packs(spark):
    r = random.Random(11)
    items = {i: r.choice([0, None, -3, 7, r.randrange(1, 300), r.randrange(1, 300), 5000]) for i in range(4000)}
    df = spark.createDataFrame(list(items.items()), "doc_id long, size int").selectExpr("*", "1 AS window", "2 AS open")
    packs = spark.createDataFrame([(1, 256), (2, 1024), (3, None), (4, 0)], "pack_id int, capacity int")
    out = packing.pack_items(df, packs, "doc_id", "size", "pack_id", "capacity", part_items=500, merged_parts=3).collect()
    total = sum(max(n or 0, 0) for n in items.values())
    for pack, capacity in ((1, 256), (2, 1024)):
        load = check(items, [(x.container, x.doc_id, x.start, x.length) for x in out if x.pack_id == pack], capacity)
        assert total > 0.95 * capacity * len(load)
    assert {x.pack_id for x in out} == {1, 2}
    odd = df.unionByName(spark.createDataFrame([(None, 5, 1, 2), (2**60 + 1, 7, 1, 2)], "doc_id long, size int, window int, open int"))
    found = packing.pack_items(odd, packs.where("pack_id = 1"), "doc_id", "size", "pack_id", "capacity", part_items=500, merged_parts=3)
    assert sorted(x.length for x in found.where("doc_id IS NULL OR doc_id > 5000").collect()) == [5, 7] and found.where(f"doc_id = {2**60 + 1}").count() == 1
    again = packing.pack_items(df.repartition(7), packs, "doc_id", "size", "pack_id", "capacity", part_items=500, merged_parts=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_one_window_open(spark):
    items = {i: 6 for i in range(10)}
    df = spark.createDataFrame(list(items.items()), "doc_id long, size int")
    packs = spark.createDataFrame([(1, 10)], "pack_id int, capacity int")
    out = packing.pack_items(df, packs, "doc_id", "size", "pack_id", "capacity", windows=1, part_items=5).collect()
    check(items, [(x.container, x.doc_id, x.start, x.length) for x in out], 10)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, size int")
    packs = spark.createDataFrame([(1, 10)], "pack_id int, capacity int")
    assert packing.pack_items(df, packs, "doc_id", "size", "pack_id", "capacity").collect() == []


def test_leftovers_merge():
    assert packing.merge_leftovers([("a", 6), ("b", 4), ("c", 5), ("d", 0)], 10) == {"a": "a", "c": "c", "b": "a", "d": "c"}


def test_fill_with_one_and_many_parts(spark):
    r = random.Random(12)
    items = {i: r.randrange(1, 200) for i in range(20000)}
    df = spark.createDataFrame(list(items.items()), "doc_id long, size int")
    packs = spark.createDataFrame([(1, 256)], "pack_id int, capacity int")
    for part_items, least in ((20000, 0.97), (313, 0.92), (20, 0.85)):  # 1, 64 and 1,000 parts
        out = packing.pack_items(df, packs, "doc_id", "size", "pack_id", "capacity", part_items=part_items).collect()
        load = check(items, [(x.container, x.doc_id, x.start, x.length) for x in out], 256)
        assert sum(items.values()) > least * 256 * len(load), (part_items, sum(items.values()) / 256 / len(load))


def test_very_many_items_of_no_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "HELD", 10)
    df = spark.range(3000).selectExpr("id AS doc_id", "cast(if(id % 100 = 0, 90, 0) AS int) AS size")
    packs = spark.createDataFrame([(1, 100)], "pack_id int, capacity int")
    out = packing.pack_items(df, packs, "doc_id", "size", "pack_id", "capacity", windows=2, part_items=1000).collect()
    check({i: 90 if i % 100 == 0 else 0 for i in range(3000)}, [(x.container, x.doc_id, x.start, x.length) for x in out], 100)
