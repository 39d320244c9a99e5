"""Numbering and looking back along time within a key, also where one key owns a large share of the rows.

A window over a key would put all its rows into one task. Here time is cut at sampled quantiles into blocks; rows are
numbered within (key, block), and what the earlier blocks of a key hold, one row for each block, is added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = 64


def with_block(df: DataFrame, at: str, blocks: int = BLOCKS) -> DataFrame:
    """``df`` with ``_block``, the number of the quantile range of the timestamp ``at``; null times are in block 0."""
    micros = df.where(F.col(at).isNotNull()).select(F.unix_micros(at).cast("double").alias("at"))
    cuts = micros.approxQuantile("at", [i / blocks for i in range(1, blocks)], 0.25 / blocks)
    if not cuts:
        return df.withColumn("_block", F.lit(0))
    bounds = F.array(*(F.lit(int(c)) for c in sorted(set(cuts))))
    return df.withColumn("_block", F.size(F.filter(bounds, lambda b: b <= F.coalesce(F.unix_micros(at), F.lit(-(1 << 62))))))


def numbered(df: DataFrame, key: str, at: str, order: Sequence[str | Column], blocks: int = BLOCKS) -> DataFrame:
    """``df`` with ``number``, from 1 along (``at``, ``order``) within the key, and ``count``, the key's rows.

    Null keys form a group; columns of these names are replaced.
    """
    cut = with_block(df.drop("number", "count"), at, blocks)
    inside = Window.partitionBy(key, "_block").orderBy(at, *order)
    by_block = Window.partitionBy(key).orderBy("_block")
    sizes = (
        cut.groupBy(key, "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("count", F.sum("_n").over(Window.partitionBy(key)))
        .drop("_n")
    )
    return (
        cut.join(sizes, [key, "_block"])
        .withColumn("number", F.row_number().over(inside) + F.col("_before"))
        .drop("_block", "_before")
    )


def with_previous(df: DataFrame, key: str, at: str, order: Sequence[str], values: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """``df`` with ``previous``, a struct of ``values`` in the row before along (``at``, ``order``); null at a key's start.

    A column of this name is replaced.
    """
    cut = with_block(df.drop("previous"), at, blocks)
    inside = Window.partitionBy(key, "_block").orderBy(at, *order)
    value = F.struct(*values)
    ends = (
        cut.groupBy(key, "_block")
        .agg(F.max_by(value, F.struct(at, *order)).alias("_end"))
        .withColumn("_start", F.lag("_end").over(Window.partitionBy(key).orderBy("_block")))
        .drop("_end")
    )
    return cut.join(ends, [key, "_block"]).withColumn("previous", F.coalesce(F.lag(value).over(inside), F.col("_start"))).drop("_block", "_start")
