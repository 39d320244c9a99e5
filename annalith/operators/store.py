"""Keyed tables: points, prefixes and key lists, and writing with upsert, append and delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from annalith.session import checkpointed, replace_folder


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; an empty result if it isn't there. The filter reaches the scan."""
    return df.where(F.col(key) == value)


def keys(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys that aren't null."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def prefix(df: DataFrame, key: str, start: str) -> DataFrame:
    """The rows whose key begins with ``start``."""
    return df.where(F.col(key).startswith(start))


def content_key(*columns: str | Column) -> Column:
    """The key of a value that has none: the SHA-256 of its JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def short_key(key: Column) -> Column:
    return F.substring(key, 1, 5)


def key_parts(key: Column, names: Sequence[str]) -> list[Column]:
    """The parts of a colon-separated key as columns; the last name gets all that is left, colons included.

    A key with fewer parts gives nulls.
    """
    parts = F.split(key, ":", len(names))
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def put(df: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df`` with ``rows`` in place of the rows of their keys; null keys match each other. Columns are matched by name."""
    same = [df[k].eqNullSafe(rows[k]) for k in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return df.join(rows, on, "left_anti").unionByName(rows)


def append(df: DataFrame, rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """key, ``value`` as an array: the lists of both, those of ``df`` first; a value of ``rows`` is one element.

    ``value`` is an array in ``df``. Elements of several rows of a key follow in their own order.
    """
    old = df.select(*key, F.posexplode(value).alias("_at", "_v")).withColumn("_new", F.lit(0))
    new = rows.select(*key, F.lit(0).alias("_at"), F.col(value).alias("_v")).withColumn("_new", F.lit(1))
    ordered = F.array_sort(F.collect_list(F.struct("_new", "_at", "_v")))
    return old.unionByName(new).groupBy(*key).agg(F.transform(ordered, lambda x: x["_v"]).alias(value))


def delete(df: DataFrame, keys_: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What is left without the keys, and what was taken out."""
    return df.join(keys_, list(key), "left_anti"), df.join(keys_, list(key), "left_semi")


def write_index(df: DataFrame, root: str, name: str, by: str | None = "year") -> str:
    """Write an index as Parquet under ``root``/``name``, partitioned by ``by``, replacing what was there. The path.

    Rows are range-partitioned by ``by`` and the columns after it, so a large year is written by several tasks. The new index
    is written beside the old one first.
    """
    path = f"{root}/{name}"
    by = by if by in df.columns else None
    replace_folder(df.sparkSession, path, lambda beside: _partitioned(df, by).parquet(beside))
    return path


def _partitioned(df: DataFrame, by: str | None) -> DataFrameWriter:
    if by is None:
        return df.write
    order = [f.name for f in df.schema if f.name != by and isinstance(f.dataType, AtomicType)]
    return df.repartitionByRange(by, *order[:2]).write.partitionBy(by)


def upsert_index(spark: SparkSession, rows: DataFrame, root: str, name: str, key: Sequence[str], by: str | None = "year") -> str:
    """Put ``rows`` into a written index. Only the partitions of ``rows`` are read and replaced, when all of them are written.

    With ``by`` among ``key`` a row's key lies in its own partition; otherwise the whole index is written anew.
    """
    path = f"{root}/{name}"
    old = spark.read.parquet(path).select(*rows.columns)
    if by is None or by not in key:
        return write_index(checkpointed(put(old, rows, key)), root, name, by)
    rows = checkpointed(rows)
    touched = F.broadcast(rows.select(by).distinct())  # partitions of the index are few
    new = checkpointed(put(old.join(touched, by, "left_semi"), rows, key).select(*rows.columns))
    _partitioned(new, by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return path


def read_index(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")
