"""Column expressions and Python functions against plain models and hand-made cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalith import constants as C
from annalith.functions import text as X
from annalith.functions import udfs as U
from annalith.functions import vectors as V
from pyspark.sql import functions as F


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}").select("i", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_compatible_hash(spark):
    words = ["democracy", "pluto", "computer", "democracy#sign", ""]
    assert column(spark, words, V.compat_hash) == [2354947772, 1908927356, 2058657674, 1750488178, 2166136261]


def test_words(spark):
    assert column(spark, ["The Cat-sat, été 42 x", None, ""], X.words) == [["cat", "sat"], None, []]


def test_titles(spark):
    assert column(spark, ["  New  York_City ", None], lambda c: X.title_key(X.display_title(c))) == ["new_york_city", None]
    assert column(spark, ["List of x", "Talk:a", "Mercury (Disambiguation)", "Pluto", "", None], X.is_followed) == [False, False, False, True, False, False]
    assert column(spark, ["#REDIRECT [[X]]", "  #redirect x", "text", "", None], lambda c: X.is_article(F.lit("T"), c)) == [False, False, True, False, False]
    assert column(spark, ["Talk:x", "User talk:x", "talk:x"], lambda c: X.is_article(c, F.lit("text"))) == [False, False, True]


def test_wiki_text(spark):
    assert column(spark, ["'''Pluto''' is a [[planet|dwarf planet]].<ref>x</ref>", "{{a {{b}} c}}d"], X.plain_text) == ["Pluto is a dwarf planet.", "c}}d"]
    assert column(spark, ["See [[Twice]] and [[NewJeans]] [[Twice#a|b]] [[File:x.png]] [[ ]]"], X.wiki_links) == [["Twice", "NewJeans"]]


def model_sentence(p):
    for i, c in enumerate(p):
        if c in ".!?" and (i + 1 == len(p) or p[i + 1] == " "):
            rest = p[i + 2 :].lstrip(" ")
            if rest and rest[0] not in '"([' and not ("A" <= rest[0] <= "Z"):
                continue
            if p[:i].rpartition(" ")[2].lower() in C.ABBREVIATIONS:
                continue
            return p[: i + 1].strip()
    return None


def test_first_sentence(spark):
    given_ = ["Dr. Smith went home. He slept.", "Born in the U.S. Army base. Next.", "No end", "Is it? Yes.", "a. b. C", "v. 2 is (new). Ok", "etc. The", "e.g. this. (That)", "x.", "St. No. Mr. A b! C"]
    assert column(spark, given_, X.first_sentence) == [model_sentence(p) for p in given_]
    assert column(spark, given_[:2], X.first_sentence) == ["Dr. Smith went home.", "Born in the U.S. Army base."]


def test_definition(spark):
    long = "word " * 200
    assert column(spark, [None, "", "{{x}}", "'''A''' is\nb.\n\nMore.", "== H ==\nx", long], X.definition) == [None, None, None, "A is b.", "== H == x", long.strip()[:500] + "…"]


def test_ngrams(spark):
    assert column(spark, [["a", "b", "c"], ["a"], []], X.ngrams, "array<string>") == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.euclidean(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r.c for r in rows] == [0.0, None, None, 1.0]
    assert [round(r.e, 6) for r in rows] == [round(5**0.5, 6), 2.0, 1.0, 0.0]
    one = spark.createDataFrame([(["a", "b", "c"], ["b", "a", "d"], [1, -1])], "a array<string>, b array<string>, s array<int>")
    r = one.select(V.rank_shift(F.col("a"), F.col("b")).alias("r"), V.diagonal(F.col("s")).alias("m")).first()
    assert r.r == 1.0 and r.m == [[1, 0], [0, -1]]


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("hoping", "hope"), ("sized", "size"),
     ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("is", "is")],
)
def test_stems(word, stem):
    assert U.stem_word(word) == stem


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=30), st.text("ab\n", max_size=30))
def test_patches_round_trip(a, b):
    assert U.apply_patch(a, U.make_patch(a, b)) == b


def test_html():
    page = '<html><style>p{}</style><p>A &amp; <a href="x/y">b</a></p><script>1</script><a href="http://o.example/z">c</a></html>'
    assert U.html_to_text(page) == "A & b\nc"
    assert U.page_urls(page, "http://e.example/d/index.html") == ["http://e.example/d/x/y", "http://o.example/z"]
    body = (
        '<div class="mw-parser-output"><p><a href="/wiki/Pluto#x">p</a><sup class="reference"><a href="/wiki/Ref">r</a></sup><a href="/wiki/Me">m</a></p><table><tr><td><a href="/wiki/T">t</a></td></tr></table>'
        '<p><a href="/wiki/New%20York?a">n</a><a href="/wiki/pluto">p</a><a href="/wiki/File:F">f</a></p><div class="mw-heading"><h2>References</h2></div><p><a href="/wiki/Late">l</a></p></div>'
    )
    assert U.body_links(body, "Me") == ["Pluto", "New York"]
    assert U.body_links("<p><a href='/wiki/X'>x</a></p>") == []


def test_moved_words_count_by_position():
    assert U.word_changes("a b c".split(), "c a b".split()) in [({"c": 1}, {"c": 1}), ({"a": 1, "b": 1}, {"a": 1, "b": 1})]


def test_patterns_are_valid():
    for pattern in C.CRAWL_PATTERNS:
        re.compile(pattern)
