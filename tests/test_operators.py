"""Operators on hand-made cases."""

import bz2
import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from annalith import constants as C
from annalith.operators import definitions, frontier, inverted, mapreduce, revisions, search, semantics, sequence, store, temporal
from annalith.sources import dump
from annalith.sources.tables import distinct_year_texts
from annalith.streaming import cadence

YEARS = "page_id string, title string, year int, text string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def texts(spark, data):
    return spark.createDataFrame(data, YEARS)


def history(spark, data):
    """(page, rev, day or None, content)"""
    full = [(p, r, d and dt.datetime(2000, 1, 1) + dt.timedelta(days=d), c, i) for i, (p, r, d, c) in enumerate(data)]
    return revisions.distinct_revisions(spark.createDataFrame(full, "page_id string, rev_id string, ts timestamp, content string, pos int"), "content")


def test_diff_goldens(spark):
    t = texts(spark, [("1", "A", 2001, "cat cat dog"), ("1", "A", 2004, "cat bird"), ("2", "B", 2001, "alpha"), ("2", "B", 2002, ""), ("2", "B", 2003, "bravo"), ("3", None, 2001, "cat"), ("3", None, 2002, "cat cat")])
    changes = temporal.temporal_diff(t)
    assert rows(changes, "page_id", "article", "year", "word", "added", "removed") == [
        ("1", "A", 2004, "bird", 1, 0), ("1", "A", 2004, "cat", 0, 1), ("1", "A", 2004, "dog", 0, 1), ("3", "3", 2002, "cat", 1, 0),
    ]
    totals = temporal.diff_totals(changes)
    assert rows(temporal.births(totals), "year", "place_no", "word") == [(2002, 1, "cat"), (2004, 1, "bird")]
    assert rows(temporal.deaths(totals), "year", "place_no", "word") == [(2004, 1, "cat"), (2004, 2, "dog")]
    top = temporal.diff_index(changes, 1).where("word = 'cat' AND year = 2004").first()
    assert top.top_added == [] and [tuple(x) for x in top.top_removed] == [("A", 0, 1)]
    assert temporal.diff_totals(temporal.positional_diff(t)).count() == 4


def test_moving_a_word_changes_nothing_by_count(spark):
    t = texts(spark, [("1", "A", 2001, "alpha bravo charlie"), ("1", "A", 2002, "charlie alpha bravo")])
    assert temporal.temporal_diff(t).count() == 0 and temporal.positional_diff(t).count() > 0


def test_repeated_deliveries(spark):
    t = texts(spark, [("1", None, 2001, "a"), ("1", "T", 2001, "a"), ("1", None, 2002, None), (None, "x", 2001, "a"), ("1", "x", None, "a")])
    assert rows(distinct_year_texts(t, "title"), "page_id", "year", "text", "title") == [("1", 2001, "a", "T"), ("1", 2002, None, None)]


def test_tfidf(spark):
    t = texts(spark, [("1", "A", 2001, "alpha alpha beta"), ("2", "B", 2001, "alpha gamma gamma gamma"), ("3", "C", 2001, None), ("4", "D", 2001, "")])
    assert rows(search.term_frequency(t), "title", "word", "n") == [("A", "alpha", 2), ("A", "beta", 1), ("B", "alpha", 1), ("B", "gamma", 3)]
    got = rows(search.tfidf(t, corpus=4), "word", "place_no", "title", "tfidf", "doc_count")
    assert got == [("alpha", 1, "A", 0.693147, 2), ("alpha", 2, "B", 0.346574, 2)]  # a word of one article has no postings
    assert rows(search.search(search.tfidf(t, corpus=4), 2001, ["ALPHA", "alpha", "none"])) == [("A", 0.693147), ("B", 0.346574)]
    assert search.search(search.tfidf(t), 2001, []).count() == 0


def test_cooccurrence(spark):
    t = texts(spark, [("1", "A", 2001, "alpha bravo alpha delta")])
    assert rows(semantics.cooccurrence(t), "word", "neighbour", "count") == [("alpha", "bravo", 1), ("alpha", "delta", 2), ("bravo", "alpha", 1), ("bravo", "delta", 1)]
    assert semantics.cooccurrence(texts(spark, [("1", "A", 2001, None), ("2", "B", 2001, ""), ("3", "C", 2001, "alone")])).count() == 0


def test_embeddings_align_with_themselves(spark):
    t = texts(spark, [("1", "A", y, f"alpha bravo charlie delta {'extra' * (y - 2000)} foxtrot") for y in (2001, 2002)])
    e = semantics.embeddings(semantics.cooccurrence(t))
    for r in e.collect():
        assert len(r.vector) == C.DIMENSION and abs(sum(x * x for x in r.vector) - 1) < 1e-9 and r.norm > 0
    same = semantics.shared_vocabulary(e, 2001, 2001)
    a = semantics.alignment(same).first()
    assert set(a.signs) == {1} and a.disparity == 0 and a.shared_vocab_size == e.where("year = 2001").count()
    assert all(abs(r.cosine_shift) < 1e-9 and r.euclidean_shift < 1e-6 and r.rank_shift in (0, None) for r in semantics.drift(same, semantics.alignment(same)).collect())
    assert semantics.align_all(e).count() == 1
    none = semantics.alignment(semantics.shared_vocabulary(e, 1990, 1991)).first()
    assert none.shared_vocab_size == 0 and none.disparity is None
    assert semantics.nearest(e.where("year = 2001"), "alpha", 2).count() == 2 and semantics.nearest(e, "unknown").count() == 0


def test_definitions(spark):
    t = texts(spark, [("2", "A", 2001, "Two is b. More."), ("1", "A", 2001, "One is a. More."), ("3", None, 1999, "x."), ("4", None, 2002, "Un. Ok.")])
    assert rows(definitions.definitions(t), "year", "title", "sentence") == [(2001, "A", "One is a."), (2002, "", "Un.")]


def test_segments_with_a_hot_page(spark):
    h = history(spark, [("1", str(i), 1 + i // 3, "x") for i in range(120)] + [("2", "900", 5, None), ("2", "900", 5, "y"), ("2", None, 5, "y"), ("2", "901", None, "y")])
    s = rows(revisions.segments(h).where("page_id = '1'"), "segment_id", "start_rev_id", "end_rev_id", "revision_count")
    assert s == [(0, "0", "49", 50), (1, "50", "99", 50), (2, "100", "119", 20)]
    assert rows(revisions.segments(h, overlap=True).where("page_id = '1'"), "segment_id", "start_rev_id", "revision_count") == [(0, "0", 50), (1, "49", 51), (2, "99", 21)]
    assert rows(revisions.article_meta(h), "page_id", "latest_rev_id", "revision_count", "segment_count") == [("1", "119", 120, 3), ("2", "900", 1, 1)]
    n = sequence.numbered(h, "page_id", "ts", ["pos", "rev_id"], blocks=5)
    assert rows(n.where("page_id = '1'"), "number", "rev_id", "count") == sorted((i + 1, str(i), 120) for i in range(120))
    p = sequence.with_previous(h, "page_id", "ts", ["pos", "rev_id"], ["rev_id"], blocks=5).where("page_id = '1'")
    assert {r.rev_id: r.previous and r.previous.rev_id for r in p.collect()} == {str(i): str(i - 1) if i else None for i in range(120)}
    with pytest.raises(ValueError):
        revisions.segments(h, 0)


def test_state_at_a_time(spark):
    h = history(spark, [("1", "a", 1900, "one"), ("1", "b", 2390, "two"), ("1", "c", 2390, None)])
    got = rows(revisions.as_of(h, ["2005-12-31 23:59:59", "2004-12-31 00:00:00", "2010-01-01 00:00:00"]), "rev_id", "content")
    assert got == [("a", "one"), ("c", None)] if got[-1][1] is None else False
    wanted = spark.createDataFrame([("1", "b"), ("9", "z")], "page_id string, rev_id string")
    assert rows(revisions.at_revision(h, wanted), "wanted", "rev_id") == [("b", "b")]
    missing = spark.createDataFrame([("1", "zz")], "page_id string, rev_id string")
    assert rows(revisions.at_revision(h, missing), "wanted", "rev_id") == [("zz", "c")]
    several = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "zz"), ("1", "b"), ("1", None), ("9", "z"), (None, "a")], "page_id string, rev_id string")
    assert sorted(map(tuple, revisions.at_revision(h, several).collect()), key=str) == [("1", "a", "a", "one"), ("1", "b", "b", "two"), ("1", "zz", "c", None), ("1", None, "c", None)]
    assert rows(revisions.year_ends(h, 2004, 2007), "year", "rev_id") == [(2005, "a"), (2006, "c"), (2007, "c")]


def test_deltas(spark):
    h = history(spark, [("1", str(i), i, c) for i, c in enumerate(["a\nb", "a\nc", None, "", "x\n" * 50, "x\n" * 49], 1)])
    back = revisions.delta_decode(revisions.delta_encode(h, 2), 2)
    assert rows(back, "rev_id", "content") == rows(h.withColumn("content", F.coalesce("content", F.lit(""))), "rev_id", "content")
    assert [r[1] for r in rows(revisions.revision_deltas(h), "rev_id", "changed")] == [True, True, True, False, True, True]


@pytest.mark.parametrize("edits,expected", [([10, 50, 50, 50, 50], 4), ([1, 1, 1, 1], None), ([1, 9, 1, 9, 1, 9], None), ([5, 5, 5, 5, 5], 3)])
def test_equilibrium(spark, edits, expected):
    df = spark.createDataFrame([("p", y, n) for y, n in enumerate(edits)], "page_id string, year int, edits long")
    assert revisions.equilibrium(df).first().equilibrium_year == expected


def test_edits(spark):
    h = history(spark, [("1", str(i), 100 * i, "x") for i in range(1, 9)])
    by_page = revisions.edits(h)
    assert sum(r.edits for r in by_page.collect()) == 8 and sum(r.edits for r in revisions.edits(h, 4).collect()) == 9
    assert revisions.edits_global(by_page).agg(F.sum("total_edits")).first()[0] == 8
    articles = spark.createDataFrame([("New York", "1", "New York"), ("new_york", "1", "New York"), ("x", "2", None)], "title_key string, page_id string, title string")
    assert revisions.edits_of(by_page, articles, " new york ").count() == by_page.count() == revisions.edits_of(by_page, articles, "1").count()
    s = revisions.edit_summary(by_page).first()
    assert (s.total, s.years) == (8, by_page.count())


def test_intervals(spark):
    t = dt.datetime
    df = spark.createDataFrame([(1, t(2001, 1, 1), t(2005, 1, 1)), (2, t(2001, 1, 1), None), (3, None, t(2009, 1, 1))], "i int, a timestamp, b timestamp")
    assert rows(revisions.active_at(df, "a", "b", "2001-01-01 00:00:00"), "i") == [(1,), (2,)]
    assert rows(revisions.active_at(df, "a", "b", "2005-01-01 00:00:00"), "i") == [(2,)]


def front(spark, data):
    schema = "key string, title string, depth int, status string, discovered_from string, enqueued_at timestamp, claimed_at timestamp, retries int"
    t = lambda n: n and dt.datetime(2020, 1, 1) + dt.timedelta(minutes=n)
    return spark.createDataFrame([(k, k.upper(), d, s, "seed", t(e), t(c), 0) for k, d, s, e, c in data], schema)


def test_frontier(spark):
    f = front(spark, [("a", 0, "pending", 3, None), ("b", 1, "pending", 1, None), ("c", 3, "pending", 1, None), ("d", 0, "inflight", 1, 10), ("e", 0, "inflight", 1, 14), ("f", 2, "stored", 1, None)])
    assert [r.key for r in frontier.batch(f, 5, 2).collect()] == ["a", "b"] and frontier.batch(f, 5, 2, 0).count() == 0
    assert dict(rows(frontier.recover_stale(f, "2020-01-01 00:15:00").where("key IN ('d', 'e')"), "key", "status")) == {"d": "pending", "e": "inflight"}
    assert tuple(frontier.status_counts(f).first()) == (6, 3, 2, 1, 0)
    links = spark.createDataFrame([("C", 1, "z"), ("c", 1, "y"), ("F", 1, "y"), ("new one", 1, "y"), ("deep", 9, "y"), ("", 1, "y")], "title string, depth int, discovered_from string")
    merged = {r.key: (r.depth, r.status, r.discovered_from) for r in frontier.merge(f, frontier.discovered(links)).collect()}
    assert merged["c"] == (1, "pending", "y") and merged["f"] == (2, "stored", "seed") and merged["new_one"] == (1, "pending", "y") and "deep" not in merged and len(merged) == 7
    assert rows(frontier.unseen(spark.createDataFrame([("a",), ("q",), ("q",), (None,)], "key string"), f)) == [("q",)]
    assert frontier.seed(f, spark.createDataFrame([("A",), ("Q q",)], "title string")).count() == 7
    merged = frontier.merge(f, frontier.discovered(links, now="2021-01-01 00:00:00"))
    assert merged.columns == f.columns
    kept = {r.key: r for r in merged.collect()}
    assert kept["d"].claimed_at == dt.datetime(2020, 1, 1, 0, 10) and kept["f"].enqueued_at == dt.datetime(2020, 1, 1, 0, 1)
    assert kept["c"].enqueued_at == kept["new_one"].enqueued_at == dt.datetime(2021, 1, 1) and kept["c"].title == "C" and kept["new_one"].retries == 0


def test_frontier_attempts(spark, tmp_path):
    f = front(spark, [("a", 0, "pending", 3, None), ("b", 1, "pending", 1, None), ("c", 0, "stored", 1, None), ("d", 0, "inflight", 1, 10)])
    taken = frontier.claim(f, frontier.batch(f, 5, 2), "2020-01-02 00:00:00")
    assert dict(rows(taken, "key", "status")) == {"a": "inflight", "b": "inflight", "c": "stored", "d": "inflight"}
    tried = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "key string, failed boolean")
    after = {r.key: r for r in frontier.settle(taken, tried, "2020-01-02 00:01:00", 2).collect()}
    assert (after["a"].status, after["a"].retries, after["a"].claimed_at) == ("pending", 1, None)
    assert (after["b"].status, after["b"].claimed_at) == ("stored", dt.datetime(2020, 1, 2, 0, 1))
    assert (after["c"].status, after["d"].status, after["d"].claimed_at) == ("stored", "inflight", dt.datetime(2020, 1, 1, 0, 10))
    assert {r.key: r.status for r in frontier.settle(taken, tried, "2020-01-02 00:01:00", 1).collect()}["a"] == "failed"
    for state in (f, taken):  # the second replaces the first
        dump.write_state(state, str(tmp_path / "state"))
        assert rows(dump.read_frontier(spark, str(tmp_path / "state"))) == rows(state)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["state"]


def test_traverse(spark):
    links = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("A", "A"), ("A", "List of X"), ("B", None), (None, "Z"), ("X", "Y")], "src_title string, dst_title string")
    seeds = spark.createDataFrame([("a",), (None,)], "title string")
    assert rows(frontier.traverse(links, seeds, 2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(frontier.traverse(links, seeds, 9)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(frontier.traverse(links, seeds, 9, max_pages=2)) == [("a", 0), ("b", 1)]
    assert rows(frontier.traverse(links, seeds.limit(0), 9)) == []


def test_index_lines(spark):
    local = spark.createDataFrame([("word1 word2 | 8 | url1",), ("word3 | 1 | url9",), ("",)], "value string")
    merged = spark.createDataFrame([("word1 word2 | url4 2",), ("word3 | url3 2",)], "value string")
    out = inverted.as_lines(inverted.merge_indexes(inverted.from_lines(local), inverted.from_lines(merged)))
    assert rows(out) == [("word1 word2 | url1 8 url4 2",), ("word3 | url3 2 url9 1",)]
    texts_ = spark.createDataFrame([("u", "Été running runs"), ("u", None), (None, "x")], "url string, t string")
    assert rows(inverted.local_index(texts_.where("url = 'u'"), "t", "url", stem=True, most=2), "term") == [("et",), ("et run",), ("run",), ("run run",)]


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 2001, 1), ("b", 2001, 2), (None, 2002, 3)], "k string, year int, v int")
    new = spark.createDataFrame([(2001, "b", 9), (2003, "c", 5), (2002, None, 7)], "year int, k string, v int")
    assert rows(store.put(df, new, ["k"]).fillna("-"), "k", "v") == [("-", 7), ("a", 1), ("b", 9), ("c", 5)]
    left, gone = store.delete(df, spark.createDataFrame([("a",)], "k string"), ["k"])
    assert left.count() == 2 and rows(gone, "v") == [(1,)]
    assert store.get(df, "k", "zz").count() == 0 and store.keys(df, "k").count() == 2 and store.prefix(df, "k", "a").count() == 1
    lists = spark.createDataFrame([("a", [3, 1])], "k string, v array<int>")
    more = spark.createDataFrame([("a", 2), ("b", 4)], "k string, v int")
    assert rows(store.append(lists, more, ["k"], "v")) == [("a", [3, 1, 2]), ("b", [4])]
    store.write_index(df, str(tmp_path), "ix")
    assert (tmp_path / "ix" / "year=2001").exists()
    store.upsert_index(spark, new.select("k", "v", "year"), str(tmp_path), "ix", ["k"])
    assert rows(store.read_index(spark, str(tmp_path), "ix").fillna("-"), "k", "v") == [("-", 7), ("a", 1), ("b", 9), ("c", 5)]


def test_map_reduce(spark):
    df = spark.createDataFrame([("a b a",), ("b",), (None,)], "t string")
    count = lambda r: [(w, 1) for w in (r["t"] or "").split()]
    for combine in (False, True):
        assert rows(mapreduce.map_reduce(df, count, lambda _, v: int(sum(v)), "long", "long", combine)) == [("a", 2), ("b", 2)]
    broken = lambda r: [(r["t"].split()[1], 1)]
    assert rows(mapreduce.map_reduce(df, broken, lambda _, v: int(sum(v)), "long", "long", on_error="skip")) == [("b", 1)]
    with pytest.raises(Exception):
        mapreduce.map_reduce(df, broken, lambda _, v: int(sum(v)), "long", "long").collect()
    with pytest.raises(ValueError):
        mapreduce.map_reduce(df, broken, len, "long", "string", combine=True)


PAGES = """<mediawiki><page><title>Pluto</title><id>1</id>
<revision><id>10</id><timestamp>2001-01-01T00:00:00Z</timestamp><text>old</text></revision>
<revision><id>11</id><parentid>10</parentid><timestamp>2002-01-01T00:00:00Z</timestamp><contributor><id>7</id></contributor><text>See [[Mars]]</text></revision></page>
<page><title>Talk:Pluto</title><id>2</id><revision><id>20</id><timestamp>bad</timestamp><text>x</text></revision></page>
<page><title>Ceres</title><id>3</id><revision><id>30</id><timestamp>2002-01-01T00:00:00Z</timestamp><text>#REDIRECT [[Pluto]]</text></revision></page></mediawiki>"""


@pytest.mark.parametrize("name,pack", [("d.xml", bytes), ("d.xml.gz", gzip.compress), ("d.xml.bz2", bz2.compress)])
def test_dump(spark, tmp_path, name, pack):
    (tmp_path / name).write_bytes(pack(PAGES.encode()))
    d = dump.read_dump(spark, str(tmp_path / name))
    assert rows(d, "page_id", "rev_id", "pos") == [("1", "10", 0), ("1", "11", 1), ("2", "20", 0), ("3", "30", 0)]
    assert d.where("rev_id = '20'").first().ts is None
    assert rows(dump.read_articles(spark, str(tmp_path / name)), "title", "links") == [("Pluto", ["Mars"])]


def test_nodes_and_state(spark, tmp_path):
    (tmp_path / "n.txt").write_text("# c\n\n10.0.0.1:80\n 10.0.0.2 \n")
    assert [tuple(r) for r in dump.read_nodes(spark, str(tmp_path / "n.txt")).collect()] == [("10.0.0.1", 80), ("10.0.0.2", None)]
    (tmp_path / "s.json").write_text(json.dumps({"queue": ["a"], "visited": ["b", "c"], "failed": []}))
    assert rows(dump.read_state(spark, str(tmp_path / "s.json"))) == [("a", "pending"), ("b", "stored"), ("c", "stored")]
    (tmp_path / "bad.json").write_text("{")
    assert rows(dump.read_state(spark, str(tmp_path / "bad.json"))) == []


def test_edits_stream(spark, tmp_path):
    schema = "page_id string, rev_id string, ts timestamp"
    for n, data in enumerate([[("1", "a", dt.datetime(2001, 5, 1)), ("1", "b", dt.datetime(2001, 5, 2))], [("1", "a", dt.datetime(2001, 5, 1)), ("2", None, dt.datetime(2001, 5, 2)), ("2", "c", dt.datetime(2001, 5, 3))]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = cadence.edits_stream(stream).writeStream.outputMode("complete").format("memory").queryName("edits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("edits")) == [("1", 2001, 2), ("2", 2001, 1)]


def test_empty_tables(spark):
    t = texts(spark, [])
    e = semantics.embeddings(semantics.cooccurrence(t))
    h = revisions.distinct_revisions(spark.createDataFrame([], "page_id string, rev_id string, ts timestamp, content string, pos int"), "content")
    for df in (temporal.diff_index(temporal.temporal_diff(t)), search.tfidf(t), e, definitions.definitions(t), revisions.segments(h), revisions.revision_deltas(h), revisions.equilibrium(revisions.edits(h)), revisions.as_of(h, ["2001-01-01 00:00:00"])):
        assert df.collect() == []


def test_every_request_is_reconstructed(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    asked = spark.read.parquet(f"{folder}/split_requests.parquet").where("page_id IS NOT NULL").select("page_id", "rev_id").distinct()
    pages = spark.read.parquet(f"{folder}/revisions.parquet").where("rev_id IS NOT NULL AND ts IS NOT NULL").select("page_id").distinct()
    found = entry.queries()["reconstruct_revision"](spark, folder).selectExpr("page_id", "wanted AS rev_id")
    assert found.count() == asked.join(pages, "page_id").count() > asked.select("page_id").distinct().count()
