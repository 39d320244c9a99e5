"""Words added and removed from year to year, and the words that appear and fade."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalith import constants as C
from annalith.functions.text import words
from annalith.functions.udfs import word_changes


def year_pairs(texts: DataFrame) -> DataFrame:
    """page_id, year, text, article with ``from_previous`` and ``to_next``: whether the pair with that year counts.

    Years are paired with the year before among those present. An empty or null text breaks the chain; an absent year
    doesn't. ``texts`` has one row for each (page_id, year); an article without title goes by its page_id.
    """
    by_page = Window.partitionBy("page_id").orderBy("year")
    full = F.coalesce(F.col("text"), F.lit("")) != ""
    return (
        texts.select("page_id", "year", "text", F.coalesce("title", "page_id").alias("article"), full.alias("full"))
        .withColumn("from_previous", F.col("full") & F.coalesce(F.lag("full").over(by_page), F.lit(False)))
        .withColumn("next_year", F.lead("year").over(by_page))
        .withColumn("next_article", F.lead("article").over(by_page))
        .withColumn("to_next", F.col("full") & F.coalesce(F.lead("full").over(by_page), F.lit(False)))
    )


def temporal_diff(texts: DataFrame) -> DataFrame:
    """page_id, article, year, word, added, removed: words whose count differs from that of the year before.

    Every word counts once for its own year and once against the next, so one pass and one aggregation compare the bags of
    words; the rows stay partitioned by page. The change belongs to the later year, so the first year of a page gives
    nothing. An empty table gives an empty result.
    """
    own = F.struct(F.col("year").alias("year"), F.col("article").alias("article"), F.lit(1).alias("sign"))
    next_ = F.struct(F.col("next_year").alias("year"), F.col("next_article").alias("article"), F.lit(-1).alias("sign"))
    sides = F.filter(F.array(F.when(F.col("from_previous"), own), F.when(F.col("to_next"), next_)), lambda x: x.isNotNull())
    d = F.col("d")
    return (
        year_pairs(texts)
        .where("from_previous OR to_next")
        .select("page_id", sides.alias("sides"), words(F.col("text")).alias("words"))
        .select("page_id", "sides", F.explode("words").alias("word"))
        .groupBy("page_id", "sides", "word")
        .agg(F.count("*").alias("n"))
        .select("page_id", "word", "n", F.inline("sides"))
        .groupBy("page_id", "article", "year", "word")
        .agg(F.sum(F.col("n") * F.col("sign")).alias("d"))
        .where(d != 0)
        .select("page_id", "article", "year", "word", F.greatest(d, F.lit(0)).alias("added"), F.greatest(-d, F.lit(0)).alias("removed"))
    )


def positional_diff(texts: DataFrame) -> DataFrame:
    """The same columns by position: a moved word is removed and added. Longest matching runs; in Python, pair by pair."""
    by_page = Window.partitionBy("page_id").orderBy("year")
    pairs = (
        year_pairs(texts)
        .withColumn("was", F.lag("text").over(by_page))
        .where("from_previous")
        .select("page_id", "article", "year", words(F.col("was")).alias("was"), words(F.col("text")).alias("now"))
    )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "article", "year", "word", "added", "removed"]
        for f in frames:
            rows = []
            for page, article, year, was, now in f.itertuples(index=False):
                added, removed = word_changes(list(was), list(now))
                rows += [(page, article, year, w, added.get(w, 0), removed.get(w, 0)) for w in {*added, *removed}]
            yield pd.DataFrame(rows, columns=columns)

    return pairs.mapInPandas(compare, "page_id string, article string, year int, word string, added long, removed long")


def diff_totals(changes: DataFrame) -> DataFrame:
    """year, word, total_added, total_removed, article_count (records), articles_added, articles_removed."""
    return changes.groupBy("year", "word").agg(
        F.sum("added").alias("total_added"),
        F.sum("removed").alias("total_removed"),
        F.count("*").alias("article_count"),
        F.count_if(F.col("added") > 0).alias("articles_added"),
        F.count_if(F.col("removed") > 0).alias("articles_removed"),
    )


def diff_tops(changes: DataFrame, n: int = C.TOP_WORDS) -> DataFrame:
    """year, word, side, place_no, article, added, removed: the articles with the largest changes; ties by article, then page.

    The rank filter lets Spark keep n rows of a group on the map side.
    """
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("amount")) for s in ("added", "removed")))
    rows = changes.select("year", "word", "article", "page_id", "added", "removed", F.inline(sides)).where("amount > 0")
    order = Window.partitionBy("year", "word", "side").orderBy(F.desc("amount"), "article", "page_id")
    return rows.withColumn("place_no", F.row_number().over(order)).where(F.col("place_no") <= n).select(
        "year", "word", "side", "place_no", "article", "added", "removed"
    )


def diff_index(changes: DataFrame, n: int = C.TOP_WORDS) -> DataFrame:
    """``diff_totals`` with ``top_added`` and ``top_removed``, arrays of {article, added, removed} of at most ``n``, best first."""
    item = F.struct("place_no", "article", "added", "removed")
    top = lambda s: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == s, item))), lambda x: x.dropFields("place_no")
    ).alias(f"top_{s}")
    return diff_totals(changes).join(diff_tops(changes, n).groupBy("year", "word").agg(top("added"), top("removed")), ["year", "word"])


def births(totals: DataFrame, n: int = C.TOP_WORDS, side: str = "added") -> DataFrame:
    """year, place_no, word, total, articles: the words most added in each year (or removed); ties by word."""
    order = Window.partitionBy("year").orderBy(F.desc("total"), "word")
    return (
        totals.select("year", "word", F.col(f"total_{side}").alias("total"), F.col(f"articles_{side}").alias("articles"))
        .where("total > 0")
        .withColumn("place_no", F.row_number().over(order))
        .where(F.col("place_no") <= n)
    )


def deaths(totals: DataFrame, n: int = C.TOP_WORDS) -> DataFrame:
    return births(totals, n, "removed")


def diff_range(totals: DataFrame, word: str, first: int, last: int) -> DataFrame:
    """The rows of a word for the years from ``first`` to ``last`` that have one, by year; one year if they are the same."""
    return totals.where((F.col("word") == word.lower()) & F.col("year").between(first, last)).orderBy("year")
