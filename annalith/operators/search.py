"""Term frequencies, tf-idf postings, and search within a year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalith import constants as C
from annalith.functions.text import runs, words


def term_frequency(texts: DataFrame, stop: Sequence[str] = C.STOP_SEARCH, min_length: int = 3) -> DataFrame:
    """page_id, title, year, word, n: how often each word stands in each text; null and empty texts give nothing.

    Stop words are left out after the split, where the list is a hash set of compiled code.
    """
    return (
        texts.select("page_id", F.coalesce("title", "page_id").alias("title"), "year", F.explode(runs(F.col("text"), min_length)).alias("word"))
        .where(~F.col("word").isin(*stop))
        .groupBy("page_id", "title", "year", "word")
        .agg(F.count("*").alias("n"))
    )


def tfidf(texts: DataFrame, corpus: int = C.CORPUS_SIZE, cap: int = C.POSTINGS_CAP) -> DataFrame:
    """year, word, place_no, title, tfidf, idf, doc_count: the postings of every word in two records of a year or more.

    tf is the count over the number of distinct terms of the text, idf the natural logarithm of ``corpus`` over the number
    of records. Of records with one title the highest counts; ``doc_count`` is the number of titles. The ``cap`` best
    postings are kept, ties by title. Scores are rounded to 6 places before they are ranked.
    """
    split = texts.select("page_id", F.coalesce("title", "page_id").alias("title"), "year", words(F.col("text"), 3, C.STOP_SEARCH).alias("w")).withColumn(
        "distinct", F.array_distinct("w")
    )
    counts = (
        split.withColumn("terms", F.size("distinct"))
        .select("page_id", "title", "year", "terms", F.explode("w").alias("word"))
        .groupBy("page_id", "title", "year", "terms", "word")
        .agg(F.count("*").alias("n"))
    )
    records = split.select("year", F.explode("distinct").alias("word")).groupBy("year", "word").agg(F.count("*").alias("records")).where("records >= 2")
    idf = F.log(F.lit(float(corpus)) / F.col("records"))
    postings = (
        counts.join(records, ["year", "word"])
        .groupBy("year", "word", "records", "title")
        .agg(F.round(F.max(F.col("n") / F.col("terms") * idf), 6).alias("tfidf"))
    )
    order = Window.partitionBy("year", "word").orderBy(F.desc("tfidf"), "title")
    titles = postings.groupBy("year", "word").agg(F.count("*").alias("doc_count"))
    return (
        postings.withColumn("place_no", F.row_number().over(order))
        .where(F.col("place_no") <= cap)
        .join(titles, ["year", "word"])
        .select("year", "word", "place_no", "title", "tfidf", F.round(idf, 6).alias("idf"), "doc_count")
    )


def search(postings: DataFrame, year: int, terms: Sequence[str], limit: int = C.SEARCH_LIMIT) -> DataFrame:
    """title, score: the sum of the kept postings of the distinct lower-cased terms, the best first; ties by title."""
    wanted = sorted({t.lower() for t in terms})
    return (
        postings.where((F.col("year") == year) & F.col("word").isin(*wanted) if wanted else F.lit(False))
        .groupBy("title")
        .agg(F.round(F.sum("tfidf"), 6).alias("score"))
        .orderBy(F.desc("score"), "title")
        .limit(limit)
    )
