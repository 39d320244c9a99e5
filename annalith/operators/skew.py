"""Per-key aggregation when a few keys own most of the rows.

Rows are range-partitioned on the composite key and a secondary order, with bounds that Spark takes from sampled
quantiles. The secondary order is part of the range, so a heavy key is cut into as many ranges as its share asks for and
no task gets more than about its share of rows. Each range then holds whole (key, order) groups, which are reduced in
place; what a key has in each of its ranges is a partial state, and those few states are stitched by a second aggregation.
Copies of a row, which no range can part, are merged before the exchange, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalith.session import shuffle_partitions
from annalith.sources.tables import folded_word


def copies_merged(df: DataFrame) -> DataFrame:
    """``df`` without the copies of a row within an Arrow batch, so that a row delivered very often doesn't make a range heavy."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from pa.Table.from_batches([b]).group_by(b.schema.names).aggregate([]).select(b.schema.names).to_batches()

    return df.mapInArrow(distinct, df.schema)


def range_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of (keys, order). Equal (keys, order) never part; equal keys may."""
    return copies_merged(df).repartitionByRange(partitions or shuffle_partitions(df.sparkSession), *keys, *order)


def skewed_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    record: dict[str, Column],
    total: dict[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """One row for each of ``keys``, however unevenly the rows lie.

    ``record`` reduces the rows of one (keys, order) to one record, inside a range and without a further shuffle.
    ``total`` reduces the records of a key: a partial state for each range, then the stitching of the states, of which
    there are at most (number of keys + number of ranges).

    Null keys form a group of their own, as in GROUP BY; an empty table gives an empty result; repeated rows are what
    ``record`` is there to merge, and it must not count them; other columns of ``df`` are ignored.
    """
    ranged = range_split(df, keys, order, partitions)
    whole = [*keys, *order]
    # a bare DISTINCT over the range is hash-aggregated; with values the rows of a record are merged by struct
    records = ranged.groupBy(*whole).agg(*(c.alias(n) for n, c in record.items())) if record else ranged.select(*whole).distinct()
    return records.groupBy(*keys).agg(*(c.alias(n) for n, c in total.items()))


def diff_records(emits: DataFrame) -> DataFrame:
    """Rows of the temporal diff with folded words. Left out: words that fold to nothing, and null articles.

    Only the columns of a record remain; null counts are 0.
    """
    return (
        emits.select(
            "year",
            folded_word(F.col("word")).alias("word"),
            "article",
            F.coalesce("added", F.lit(0)).alias("added"),
            F.coalesce("removed", F.lit(0)).alias("removed"),
            "emitted_at",
        )
        .where((F.col("word") != "") & F.col("article").isNotNull())
    )


def latest(*values: str, by: str) -> Column:
    """The values of the row with the greatest ``by``; ties by the greatest values; null ``by`` comes first."""
    return F.max(F.struct(by, *values))


def diff_totals(emits: DataFrame, partitions: int | None = None) -> DataFrame:
    """Index of the temporal diff: one row for each (year, folded word).

    Of several rows of a (year, word, article) the one emitted last counts. Columns: year, word, total_added,
    total_removed, article_count, articles_added, articles_removed.
    """
    r = F.col("last")
    return skewed_aggregate(
        diff_records(emits),
        ["year", "word"],
        ["article"],
        {"last": latest("added", "removed", by="emitted_at")},
        {
            "total_added": F.sum(r["added"]),
            "total_removed": F.sum(r["removed"]),
            "article_count": F.count("*"),
            "articles_added": F.count_if(r["added"] > 0),
            "articles_removed": F.count_if(r["removed"] > 0),
        },
        partitions,
    )


def article_counts(emits: DataFrame, partitions: int | None = None) -> DataFrame:
    """The number of distinct articles of each (year, folded word), without the values."""
    return skewed_aggregate(
        diff_records(emits).select("year", "word", "article"), ["year", "word"], ["article"], {}, {"article_count": F.count("*")}, partitions
    )


def heavy_keys(counts: DataFrame, share: float = 0.01) -> DataFrame:
    """The rows of ``counts`` whose article_count is at least ``share`` of the sum over all keys.

    The sum is a scalar subquery of one number. Nothing is found in an empty table.
    """
    total = counts.agg(F.sum("article_count").alias("n"))
    return counts.where(F.col("article_count") >= F.lit(share) * total.scalar())
