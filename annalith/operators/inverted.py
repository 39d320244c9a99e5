"""The plain inverted index: n-grams of terms with the places they occur in, and the merging of two indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalith.functions.text import legacy_terms, ngrams
from annalith.functions.udfs import stems


def local_index(texts: DataFrame, text: str, url: str, stem: bool = False, most: int = 3) -> DataFrame:
    """term, url, freq: how often each run of 1 to ``most`` terms stands in the texts of a url.

    ``stem`` reduces terms by the Porter algorithm before. Null texts give nothing; a null url is one like others.
    """
    terms = legacy_terms(F.col(text))
    terms = stems(terms) if stem else terms
    return (
        texts.where(F.col(text).isNotNull())
        .select(F.col(url).alias("url"), terms.alias("terms"))
        .select("url", F.explode(ngrams(F.col("terms"), most)).alias("term"))
        .groupBy("term", "url")
        .agg(F.count("*").alias("freq"))
    )


def merge_indexes(local: DataFrame, merged: DataFrame) -> DataFrame:
    """term, url, freq: the sum of both."""
    return local.unionByName(merged).groupBy("term", "url").agg(F.sum("freq").alias("freq"))


def postings(index: DataFrame) -> DataFrame:
    """term, urls: a term's places as an array of {url, freq}, most frequent first, ties by url."""
    item = F.struct((-F.col("freq")).alias("neg"), F.col("url"))
    return index.groupBy("term").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["url"].alias("url"), (-x["neg"]).alias("freq"))).alias("urls")
    )


def as_lines(index: DataFrame) -> DataFrame:
    """line: the text form of ``postings``: term | url freq url freq ..."""
    pairs = F.array_join(F.transform("urls", lambda x: F.concat_ws(" ", x["url"], x["freq"].cast("string"))), " ")
    return postings(index).select(F.concat(F.col("term"), F.lit(" | "), pairs).alias("line"))


def from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """term, url, freq from text lines: of a local index (term | freq | url) or a merged one (term | url freq ...).

    Blank lines are left out.
    """
    parts = F.transform(F.split(column, r"\|"), lambda x: F.trim(x))
    local = F.array(F.struct(F.get("p", F.lit(2)).alias("url"), F.get("p", F.lit(1)).try_cast("long").alias("freq")))
    flat = F.filter(F.split(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s+"), lambda x: x != "")
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size("f") - 2, F.lit(0)), F.lit(2)), lambda i: i + 1 < F.size("f")),
        lambda i: F.struct(F.get("f", i).alias("url"), F.get("f", i + 1).try_cast("long").alias("freq")),
    )
    return (
        lines.where(F.trim(column) != "")
        .withColumn("p", parts)
        .withColumn("f", flat)
        .select(F.get("p", F.lit(0)).alias("term"), F.inline(F.when(F.size("p") > 2, local).otherwise(pairs)))
    )
