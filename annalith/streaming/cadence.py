"""Edits by page and year as revisions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edits_stream(revisions: DataFrame, late: str = "30 days") -> DataFrame:
    """page_id, year, edits of a stream of revisions (page_id, rev_id, ts), each revision once.

    A revision that comes again within ``late`` of its time is dropped by the watermark's state; one that comes later
    than that is dropped itself. Rows without page, id or time are left out.
    """
    return (
        revisions.where("page_id IS NOT NULL AND rev_id IS NOT NULL AND ts IS NOT NULL")
        .withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["page_id", "rev_id"])
        .groupBy("page_id", F.year("ts").alias("year"))
        .agg(F.count("*").alias("edits"))
    )


def edits_by_day(revisions: DataFrame, late: str = "1 day") -> DataFrame:
    """day, edits, pages (approximate) in windows of a day that close behind the watermark, so they can be appended."""
    return (
        revisions.where("ts IS NOT NULL")
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.count("*").alias("edits"), F.approx_count_distinct("page_id").alias("pages"))
        .select(F.col("w.start").alias("day"), "edits", "pages")
    )
