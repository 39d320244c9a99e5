"""The first sentence of each article in each year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalith import constants as C
from annalith.functions.text import definition


def definitions(texts: DataFrame, first: int = C.FIRST_YEAR, last: int = C.LAST_YEAR) -> DataFrame:
    """year, title, sentence for the years ``first`` to ``last``; of records with one title that of the smallest page_id.

    Null and empty texts, and texts that leave nothing without their markup, give no row; a null title counts as empty.
    """
    return (
        texts.where(F.col("year").between(first, last) & (F.col("text") != ""))
        .select("year", F.coalesce("title", F.lit("")).alias("title"), "page_id", definition(F.col("text")).alias("sentence"))
        .where("sentence IS NOT NULL")
        .groupBy("year", "title")
        .agg(F.min_by("sentence", "page_id").alias("sentence"))
    )
