"""Texts that look the same, and texts that don't."""

import pytest

from annalith.llm import lookalike

SAME = [
    ("Caf\u00e9 \u2116", "Cafe\u0301\u00a0\u2116"), ("sheet 1", "ｓｈｅｅｔ\u3000１"), ("soft hyphen", "so\u00adft\u200b hyphen\ufeff"), ("Tea pot", "\u0422\u0435\u0430 p\u043et"),
    ("TO\u0301", "\u03a4\u039f\u0301"), ("fi - x", "ﬁ \u2011 x"), ("한국", "\u1112\u1161\u11ab국"), ("ё", "e\u0308"), ("kelvin K", "kelvin \u212a"), ("山水", "\u2f2d\u2f54"), ("ｶﾞ", "ガ"),
    *((f"x{a}z", f"x{b}z") for a, b in zip("νραιυϹϲϳӏӀѵѴ", "vpaiuCcjlIvV")),
]
DIFFERENT = [("cafe", "café"), ("Tea", "tea"), ("m²", "m2"), ("a b", "a  b"), ("ab", "a b"), ("1", "l"), ("я", "r"), ("и", "й"), ("👩\u200d🔬", "👩🔬"), ("x–y", "x-y"), ("①", "1")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_shape(a, b):
    assert lookalike.same_shape(a) == lookalike.same_shape(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_other_shape(a, b):
    assert lookalike.same_shape(a) != lookalike.same_shape(b)


def test_pairs_and_classes(spark):
    texts = [x + f" {i}" for i, p in enumerate(SAME) for x in p] + [x + f" d{i}" for i, p in enumerate(DIFFERENT) for x in p]
    texts += ["Cafe\u0301\u00a0\u2116 0", "", None, " ", "\u200b", "plain", "plain"] + ["long " * 20000, "long " * 19999 + "l\u043eng "]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class_id", "2 AS variant", "3 AS shape")
    blank = lambda t: not (t or "").replace("\u200b", "").strip()
    expected = {(i, j) for i, a in rows for j, b in rows if i < j and not blank(a) and not blank(b) and a != b and lookalike.same_shape(a) == lookalike.same_shape(b)}
    found = [(r.doc_a, r.doc_b) for r in lookalike.pairs(df, "doc_id", "text").collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) >= len(SAME) + 2
    sizes = {r.canonical: (r.spellings, r.documents) for r in lookalike.class_sizes(df.unionByName(df), "text").collect()}
    for _, a in rows:
        alike = {b for _, b in rows if a is not None and b is not None and lookalike.same_shape(b) == lookalike.same_shape(a)}
        if len(alike) > 1:
            assert sizes[min(alike, key=lambda s: s.encode())] == (len(alike), 2 * sum(b in alike for _, b in rows))
    out = {r.doc_id: r for r in lookalike.classes(df, "text").collect()}
    assert len(out) == len(rows)
    for i, a in rows:
        assert (out[i].class_id is None) == (a is None)
        if a is not None:
            assert out[i].canonical == min((b for _, b in rows if b is not None and lookalike.same_shape(b) == lookalike.same_shape(a)), key=lambda s: s.encode())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lookalike.pairs(df, "doc_id", "text").collect() == [] and lookalike.classes(df, "text").collect() == []
