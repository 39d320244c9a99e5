"""Placement on nodes against big integers."""

import hashlib
import json

from annalith.functions.text import first_filled, query_string
from annalith.operators import placement, store
from annalith.sources import dump
from pyspark.sql import functions as F

NODES = [placement.node_id("10.0.0.1", p) for p in range(7)]


def test_placement(spark):
    keys = [f"key {i}" for i in range(200)] + ["", 'with "quotes" and é']
    ids = {k: hashlib.sha256(json.dumps(k, ensure_ascii=False).encode()).hexdigest() for k in keys}
    ordered = sorted(NODES)
    i = F.col("id")
    rows = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("id", placement.key_id(F.col("k")))
    for r in rows.select("k", "id", placement.by_remainder(i, NODES).alias("a"), placement.on_ring(i, NODES).alias("b"), placement.by_weight(i, NODES).alias("c")).collect():
        assert r.id == ids[r.k]
        assert r.a == ordered[int(r.id, 16) % len(NODES)]
        assert r.b == next((n for n in ordered if int(n, 16) >= int(r.id, 16)), ordered[0])
        assert r.c == max(NODES, key=lambda n: hashlib.sha256((r.id + n).encode()).hexdigest())


def test_key_parts(spark):
    df = spark.createDataFrame([("diff:2001:a:b",), ("diff",), (None,)], "k string")
    assert [tuple(r) for r in df.select(*store.key_parts(F.col("k"), ["f", "y", "w"])).collect()] == [("diff", "2001", "a:b"), ("diff", None, None), (None, None, None)]


def test_small_texts(spark, tmp_path):
    df = spark.createDataFrame([(None, "", "c"), (None, None, None)], "a string, b string, c string")
    assert [r.x for r in df.select(first_filled(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == ["c", ""]
    m = spark.createDataFrame([({"a b": "x&y", "n": None, "e": ""},)], "m map<string,string>")
    assert m.select(query_string(F.col("m")).alias("x")).first().x == "a+b=x%26y"
    dump.write_articles(spark.createDataFrame([("1", "A/B c")], "page_id string, title string"), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).first().name == "A_B_c"
