"""Token ids against the public library, and the way back."""

import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
vocabulary = pytest.importorskip("public_tokenizers")

from annalith.llm import tokens

ODD = [
    None, "", " ", "\n\n  x", "a" * 5000, "<|endoftext|>", "It's we'll I'M 1234567 ½²", "日本語のテキスト。" * 200, "Привет, мир!", "e\u0301\u200b\ufeff\u00a0x", "👩‍🔬🏳️‍🌈", "\t\r\n \u2028\u3000a", "x\x00y",
    "สวัสดีชาวโลก" * 60, "=" * 700, "\u0085\u000b\x1c", "don't 'tis 'S 's",
]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=tokens.read_ranks(), special_tokens={})


def test_same_ids_and_round_trip(spark, encoding):
    r = random.Random(9)
    chars = "ab cdé\n\t'st1９ß日🙂．"
    texts = ODD + ["".join(r.choices(chars, k=r.randrange(200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = df.union(df.limit(20)).selectExpr("*", "1 AS piece", "2 AS id", "3 AS ids")
    out = tokens.encode_texts(df, "doc_id", "text").cache()
    assert {x.doc_id: list(x.ids) for x in out.collect()} == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {x.doc_id: x.tokens for x in tokens.count_tokens(df, "doc_id", "text").collect()} == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert {x.doc_id: x.text for x in tokens.decode_ids(out, "doc_id", "ids").collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_pieces_of_any_length(spark, encoding):
    r = random.Random(10)
    runs = ["".join(r.choices("abcdeé日", k=r.randrange(1, 60))) for _ in range(300)]
    runs += ["xyz" * 1000, "=" * 5001, "a" * 1025, "ab" * 999 + "a", "aba" * 333, "日本" * 500, "".join(r.choices("ACGT", k=1500)), "".join(r.choices("etaoins", k=900))]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    for frequent in (0, 60):
        out = tokens.encode_texts(df, "doc_id", "text", frequent=frequent)
        assert {x.doc_id: list(x.ids) for x in out.collect()} == {i: encoding.encode_ordinary(t) for i, t in enumerate(runs)}
        counts = tokens.count_tokens(df, "doc_id", "text", frequent=frequent)
        assert {x.doc_id: x.tokens for x in counts.collect()} == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(runs)}


def test_frequent_pieces_are_bounded(spark):
    df = spark.range(1000).selectExpr("cast(id AS string) AS piece", "id + 1 AS n", "array(1) AS ids")
    assert 0 < tokens.frequent_pieces(df, 300).count() <= 300
    assert tokens.frequent_pieces(df, 300).selectExpr("min(n)").first()[0] > 600
    assert tokens.frequent_pieces(df.limit(0), 300).count() == 0


def test_empty_and_null_identifier(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_texts(df, "doc_id", "text").collect() == []
    one = spark.createDataFrame([(None, "hello")], "doc_id long, text string")
    assert [len(x.ids) for x in tokens.encode_texts(one, "doc_id", "text").collect()] == [1]


def test_no_row_carries_a_constant(spark):
    df = spark.createDataFrame([(1, "a mill"), (2, None)], "doc_id long, text string")
    ranks = tokens.constant_map(tokens.rank_table(spark, tokens.read_ranks()), "token", "rank")
    plans = [tokens.encoded_pieces(df, "text", ranks)]
    plans += [tokens._looked_up(rows, "doc_id", "text", "byte_bpe_50k", tokens.FOLDER, 10, lambda x: x)[0] for rows in (df, df.union(df))]
    for p in plans:
        optimized = p._jdf.queryExecution().optimizedPlan().toString()
        assert " AS _ranks" not in optimized and " AS _known" not in optimized and "scalar-subquery" in optimized
