"""Changes between snapshots against a plain model."""

import datetime as dt
import random

from annalith.operators import snapshots


def trim(t):
    return None if t is None else t.replace("\r\n", "\n").strip(" \t\r\n")


def test_years(spark):
    r = random.Random(2)
    rows = [(f"p{i}", f"t{i}", y, r.choice(["a", "a ", "b", "", "\r\n", None, "x" * 20000, "a\r\nb", "a\nb"])) for i in range(60) for y in range(2008, 2014) if r.random() < 0.8]
    rows += rows[:30] + [(None, None, 2010, "a"), ("p0", None, None, "a")]
    state = {(p, y): trim(t) for p, _, y, t in rows if p and y and t is not None}
    expected = set()
    for p, y in {(p, y + d) for p, y in state for d in (0, 1)}:
        was, now = state.get((p, y - 1)), state.get((p, y))
        if 2009 <= y <= 2013 and was != now:
            expected.add((p, str(y), "added" if was is None else "removed" if now is None else "changed"))
    df = spark.createDataFrame(rows, "page_id string, title string, year int, text string")
    found = [tuple(x) for x in snapshots.year_changes(df, 2009, 2013).select("page_id", "row_ref", "change_kind").collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_revisions_with_a_hot_page(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        page = "hot" if i % 2 else f"p{r.randrange(20)}"
        rows.append((page, None if i % 50 == 7 else str(100 + i * 7 % 997), dt.datetime(2015, 1, 1) + dt.timedelta(hours=r.randrange(200)) if i % 41 else None, r.choice(["a", "a ", "b", "", " \n", None])))
    rows += rows[:20]
    pages = {}
    for p, rev, ts, c in set(rows):
        if rev and ts:
            pages.setdefault(p, []).append((ts, int(rev), rev, trim(c) or ""))
    expected = set()
    for p, v in pages.items():
        was = ""
        for _, _, rev, now in sorted(v):
            if now != was:
                expected.add((p, rev, "added" if not was else "removed" if not now else "changed"))
            was = now
    df = spark.createDataFrame(rows, "page_id string, rev_id string, ts timestamp, content string")
    found = [tuple(x) for x in snapshots.revision_changes(df, blocks=8).select("page_id", "row_ref", "change_kind").collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_only_differing_leaves_are_compared(spark):
    rows = [("k%d" % i, y, "v" if (i, y) != (5, 2) else "w") for i in range(500) for y in (1, 2)]
    df = spark.createDataFrame(rows, "key string, snap int, value string")
    levels = snapshots.levels_for(500)
    sides = snapshots.both_sides(df, "snap").where("snap = 2")
    assert snapshots.differing_leaves(snapshots.merkle_tree(sides, "snap", "key", "value", levels), "snap", levels).count() == 1
    assert [tuple(x) for x in snapshots.snapshot_changes(df, "snap", "key", "value", 2, 2).collect()] == [(2, "k5", "changed")]


def test_leaves_are_skipped_at_a_million_keys(spark):
    df = spark.range(1_000_000).selectExpr("cast(id AS string) AS key", "explode(array(1, 2)) AS snap", "id").selectExpr("key", "snap", "md5(concat(key, if(snap = 2 and id % 250000 = 7, 'x', ''))) AS value")
    levels = snapshots.levels_for(1_000_000)
    assert 1_000_000 >> levels[-1] <= snapshots.LEAF_KEYS
    sides = snapshots.both_sides(df, "snap").where("snap = 2")
    tree = snapshots.merkle_tree(sides, "snap", "key", "value", levels)
    assert tree[levels[-1]].count() > 4000
    assert snapshots.differing_leaves(tree, "snap", levels).count() == 4
    found = [tuple(x) for x in snapshots.snapshot_changes(df, "snap", "key", "value", 2, 2).collect()]
    assert sorted(found) == [(2, k, "changed") for k in ("250007", "500007", "7", "750007")]


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id string, title string, year int, text string")
    assert snapshots.year_changes(empty).collect() == []
    assert snapshots.revision_changes(spark.createDataFrame([], "page_id string, rev_id string, ts timestamp, content string")).collect() == []
