"""The Parquet tables of a dataset folder, and the shapes the operators expect of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalith.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table, a file or a folder of Parquet files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def distinct_year_texts(history: DataFrame, *more: str) -> DataFrame:
    """One row for each (page_id, year): repeated deliveries are merged.

    Copies of a record carry the same text; were they to differ, the greatest one is kept. ``more`` names further
    columns to keep (the greatest value that is not null). Rows without page_id or year are left out.
    """
    keep = history.where(F.col("page_id").isNotNull() & F.col("year").isNotNull())
    return keep.groupBy("page_id", "year").agg(*(F.max(c).alias(c) for c in ("text", *more)))


def folded_word(word) -> F.Column:
    """Lower case with everything but a-z and 0-9 taken out."""
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")
