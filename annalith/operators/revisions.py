"""Histories of pages: segments, state at a time, differences between revisions, and edits by year."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalith import constants as C
from annalith.functions.text import display_title, title_key
from annalith.functions.udfs import apply_patch, make_patch
from annalith.operators.sequence import numbered, with_previous

ORDER = ["pos", "rev_id"]


def distinct_revisions(df: DataFrame, *more: str) -> DataFrame:
    """page_id, rev_id, ts, pos and ``more``: one row for each revision; those without page, id or time are left out.

    Of several deliveries the greatest values count, and the first place of arrival.
    """
    return (
        df.where("page_id IS NOT NULL AND rev_id IS NOT NULL AND ts IS NOT NULL")
        .groupBy("page_id", "rev_id")
        .agg(F.max("ts").alias("ts"), F.min("pos").alias("pos"), *(F.max(c).alias(c) for c in more))
    )


def segments(revisions: DataFrame, size: int = C.SEGMENT_SIZE, overlap: bool = False) -> DataFrame:
    """page_id, segment_id, start_rev_id, end_rev_id, start_ts, end_ts, revision_count: ``size`` revisions each, by time.

    With ``overlap`` each segment but the first begins with the last revision of the one before.
    """
    if size < 1:
        raise ValueError("a segment has at least one revision")
    n = numbered(revisions, "page_id", "ts", ORDER)
    place = F.floor((F.col("number") - 1) / size).cast("int")
    if overlap:
        carried = F.when((F.col("number") % size == 0) & (F.col("number") < F.col("count")), F.array(place, place + 1)).otherwise(F.array(place))
        n = n.withColumn("segment_id", F.explode(carried))
    else:
        n = n.withColumn("segment_id", place)
    return n.groupBy("page_id", "segment_id").agg(
        F.min_by("rev_id", "number").alias("start_rev_id"),
        F.max_by("rev_id", "number").alias("end_rev_id"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("*").alias("revision_count"),
    )


def article_meta(revisions: DataFrame, size: int = C.SEGMENT_SIZE) -> DataFrame:
    """page_id, latest_rev_id, first_ts, latest_ts, revision_count, segment_count, segment_size."""
    return revisions.groupBy("page_id").agg(
        F.max_by("rev_id", F.struct("ts", *ORDER)).alias("latest_rev_id"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("latest_ts"),
        F.count("*").alias("revision_count"),
        F.ceil(F.count("*") / size).cast("int").alias("segment_count"),
        F.lit(size).alias("segment_size"),
    )


def manifest(parts: DataFrame) -> DataFrame:
    """page_id, segments: the segments of each page in order, as an array of structs."""
    item = F.struct("segment_id", "start_rev_id", "end_rev_id", "start_ts", "end_ts", "revision_count")
    return parts.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("segments"))


def first_revisions(revisions: DataFrame, limit: int = C.HISTORY_LIMIT) -> DataFrame:
    """The first ``limit`` revisions of each page by time, with ``number`` and ``truncated``: whether there are more."""
    return numbered(revisions, "page_id", "ts", ORDER).where(F.col("number") <= limit).withColumn("truncated", F.col("count") > limit).drop("count")


def last_revisions(revisions: DataFrame, limit: int = C.MAX_REVISIONS) -> DataFrame:
    """The ``limit`` revisions of each page that arrived last, by place of arrival."""
    order = Window.partitionBy("page_id").orderBy(F.desc("pos"), F.desc("rev_id"))
    return revisions.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")


def as_of(revisions: DataFrame, times: Sequence[str]) -> DataFrame:
    """page_id, as_of, rev_id, content: the last revision of each page at each of the given UTC times; pages without none yet.

    The identifiers are chosen first, without contents: an aggregation with map-side combine in which each revision is counted
    for the times from which it is known. The contents of those chosen, one for each page and time at most, are joined.
    """
    chosen = last_known(revisions, times)
    return chosen.join(revisions.select("page_id", "rev_id", "content"), ["page_id", "rev_id"]).select("page_id", "as_of", "rev_id", "content")


def last_known(revisions: DataFrame, times: Sequence[str]) -> DataFrame:
    """page_id, as_of, rev_id: as ``as_of``, without contents. The times are a literal array, ascending or not."""
    known = F.filter(F.array(*(F.to_timestamp(F.lit(t)) for t in times)), lambda t: F.col("ts") <= t)
    light = revisions.select("page_id", "rev_id", "ts", *ORDER[:1])
    # of each stretch between two times only a page's last revision can be asked for, so a revision isn't repeated for each time
    last = light.withColumn("_known", known).groupBy("page_id", "_known").agg(F.max(F.struct("ts", *ORDER)).alias("x"))
    return last.select("page_id", F.explode("_known").alias("as_of"), "x").groupBy("page_id", "as_of").agg(F.max("x").alias("x")).select("page_id", "as_of", "x.rev_id")


def year_ends(revisions: DataFrame, first: int, last: int) -> DataFrame:
    """page_id, year, rev_id, content at the end of each year, carried forward; nothing before a page's first revision."""
    rows = as_of(revisions, _year_ends(first, last))
    return rows.select("page_id", F.year("as_of").alias("year"), "rev_id", "content")


def year_end_ids(revisions: DataFrame, first: int, last: int) -> DataFrame:
    """page_id, year, rev_id: as ``year_ends``, without contents."""
    return last_known(revisions, _year_ends(first, last)).select("page_id", F.year("as_of").alias("year"), "rev_id")


def _year_ends(first: int, last: int) -> list[str]:
    return [f"{y}-12-31 23:59:59" for y in range(first, last + 1)]


def at_revision(revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id, wanted, rev_id, content: the revision asked for, or the page's latest if it isn't there.

    ``wanted`` has page_id and rev_id, any number of them for each page; pages without a revision are left out. Hits are joined
    by page and revision, and every page has one latest row, so no page's revisions are multiplied by its requests.
    """
    asked = wanted.where("page_id IS NOT NULL").select("page_id", F.col("rev_id").alias("wanted")).distinct()
    hits = revisions.select("page_id", F.col("rev_id").alias("wanted"), F.col("rev_id").alias("hit"))
    latest = revisions.groupBy("page_id").agg(F.max_by("rev_id", F.struct("ts", *ORDER)).alias("latest"))
    rows = asked.join(hits, ["page_id", "wanted"], "left").join(latest, "page_id")
    chosen = rows.select("page_id", "wanted", F.coalesce("hit", "latest").alias("rev_id"))
    return chosen.join(revisions.select("page_id", "rev_id", "content"), ["page_id", "rev_id"]).select("page_id", "wanted", "rev_id", "content")


def revision_deltas(revisions: DataFrame) -> DataFrame:
    """page_id, rev_id, length_change, changed: against the revision before; a null content counts as empty."""
    light = revisions.select("page_id", "rev_id", "ts", "pos", F.coalesce(F.length("content"), F.lit(0)).alias("length"), F.md5(F.coalesce("content", F.lit(""))).alias("digest"))
    p = F.col("previous")
    return with_previous(light, "page_id", "ts", ORDER, ["length", "digest"]).select(
        "page_id",
        "rev_id",
        (F.col("length") - F.coalesce(p["length"], F.lit(0))).alias("length_change"),
        (F.coalesce(p["digest"], F.md5(F.lit(""))) != F.col("digest")).alias("changed"),
    )


def active_years(history: DataFrame) -> DataFrame:
    """page_id, years: the years with a text, ascending."""
    return history.where("text <> ''").groupBy("page_id").agg(F.array_sort(F.collect_set("year")).alias("years"))


DELTA = "page_id string, number long, rev_id string, base string, patch array<struct<at:int,taken:int,put:array<string>>>"


def delta_encode(revisions: DataFrame, size: int = C.SEGMENT_SIZE) -> DataFrame:
    """page_id, number, rev_id and either base (the first of ``size`` revisions) or patch, line changes to the one before.

    A segment is one group of at most ``size`` rows, so no group grows with the page.
    """
    n = numbered(revisions.select("page_id", "rev_id", "ts", "pos", "content"), "page_id", "ts", ORDER)
    n = n.withColumn("segment_id", F.floor((F.col("number") - 1) / size)).select("page_id", "segment_id", "number", "rev_id", "content")

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        rows, was = [], None
        for r in frame.sort_values("number").itertuples(index=False):
            text = r.content or ""
            patch = None if was is None else [{"at": a, "taken": t, "put": p} for a, t, p in make_patch(was, text)]
            rows.append((r.page_id, r.number, r.rev_id, text if was is None else None, patch))
            was = text
        return pd.DataFrame(rows, columns=["page_id", "number", "rev_id", "base", "patch"])

    return n.groupBy("page_id", "segment_id").applyInPandas(encode, DELTA)


def delta_decode(encoded: DataFrame, size: int = C.SEGMENT_SIZE) -> DataFrame:
    """page_id, number, rev_id, content again. A patch that doesn't fit is an error."""

    def decode(frame: pd.DataFrame) -> pd.DataFrame:
        rows, text = [], ""
        for r in frame.sort_values("number").itertuples(index=False):
            text = r.base if r.base is not None else apply_patch(text, [(p["at"], p["taken"], list(p["put"])) for p in r.patch])
            rows.append((r.page_id, r.number, r.rev_id, text))
        return pd.DataFrame(rows, columns=["page_id", "number", "rev_id", "content"])

    keyed = encoded.withColumn("segment_id", F.floor((F.col("number") - 1) / size))
    return keyed.groupBy("page_id", "segment_id").applyInPandas(decode, "page_id string, number long, rev_id string, content string")


def edits(revisions: DataFrame, overlap: int | None = None) -> DataFrame:
    """page_id, year, edits: a page's revisions by UTC year.

    With ``overlap``, a segment size, the revision that each later segment repeats counts twice.
    """
    rows = revisions
    if overlap:
        n = numbered(revisions, "page_id", "ts", ORDER)
        twice = (F.col("number") % overlap == 0) & (F.col("number") < F.col("count"))
        rows = n.withColumn("_", F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.groupBy("page_id", F.year("ts").alias("year")).agg(F.count("*").alias("edits"))


def edits_global(by_page: DataFrame) -> DataFrame:
    """year, total_edits, distinct_pages, mean_edits_per_page."""
    return by_page.groupBy("year").agg(
        F.sum("edits").alias("total_edits"), F.count("*").alias("distinct_pages"), F.round(F.avg("edits"), 6).alias("mean_edits_per_page")
    )


def edit_summary(by_page: DataFrame) -> DataFrame:
    """page_id, years, total, most, most_year, least, least_year; the first year on ties."""
    return by_page.groupBy("page_id").agg(
        F.count("*").alias("years"),
        F.sum("edits").alias("total"),
        F.max("edits").alias("most"),
        F.max_by("year", F.struct("edits", -F.col("year"))).alias("most_year"),
        F.min("edits").alias("least"),
        F.min_by("year", F.struct("edits", "year")).alias("least_year"),
    )


def equilibrium(by_page: DataFrame) -> DataFrame:
    """page_id, equilibrium_year: the year of the third of three successive small changes, null if there is none.

    A change between years that have edits is small up to a tenth of the page's mean, and up to 1 at least. A page needs 5
    such years.
    """
    w = Window.partitionBy("page_id").orderBy("year")
    all_ = Window.partitionBy("page_id")
    small = F.abs(F.col("edits") - F.lag("edits").over(w)) <= F.greatest(F.lit(1.0), F.avg("edits").over(all_) * 0.1)
    third = F.col("small") & F.lag("small", 1, False).over(w) & F.lag("small", 2, False).over(w)
    return (
        by_page.withColumn("small", F.coalesce(small, F.lit(False)))
        .withColumn("third", third)
        .groupBy("page_id")
        .agg(F.when(F.count("*") >= 5, F.min(F.when(F.col("third"), F.col("year")))).alias("equilibrium_year"))
    )


def edits_preview(by_page: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` years of each page's series."""
    order = Window.partitionBy("page_id").orderBy(F.desc("year"))
    return by_page.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def edits_by_title(by_page: DataFrame, articles: DataFrame) -> DataFrame:
    """title_key, page_id, year, edits for each title that leads to the page; the keys are brought to normal form."""
    keys = articles.select(title_key(display_title(F.col("title_key"))).alias("title_key"), "page_id").distinct()
    return keys.join(by_page, "page_id").select("title_key", "page_id", "year", "edits")


def edits_of(by_page: DataFrame, articles: DataFrame, target: str) -> DataFrame:
    """year, edits of a page by its number or title, by year."""
    if target.isdigit():
        return by_page.where(F.col("page_id") == target).select("year", "edits").orderBy("year")
    key = title_key(display_title(F.lit(target)))
    return edits_by_title(by_page, articles).where(F.col("title_key") == key).select("year", "edits").distinct().orderBy("year")


def edit_report(by_page: DataFrame, articles: DataFrame, target: str, recent: int = 10) -> DataFrame:
    """One row about a page's edits: years, total, most, most_year, least, least_year, equilibrium_year, and recent, its last
    years as an array of {year, edits}; none for an unknown page. A page's series has one row for each year."""
    mine = edits_of(by_page, articles, target).withColumn("page_id", F.lit(target))
    items = F.array_sort(F.collect_list(F.struct("year", "edits")))
    last = mine.groupBy("page_id").agg(items.alias("all")).select("page_id", F.slice("all", F.greatest(F.size("all") - recent + 1, F.lit(1)), recent).alias("recent"))
    return edit_summary(mine).join(equilibrium(mine), "page_id").join(last, "page_id").drop("page_id")


def active_at(df: DataFrame, start: str, end: str, at: str | int | float) -> DataFrame:
    """Rows whose half-open interval holds the UTC time ``at``, a timestamp or seconds since 1970; a null end is open, a null
    start holds nothing. A time that can't be read holds no row."""
    known = F.to_timestamp(F.timestamp_seconds(F.lit(at))) if isinstance(at, (int, float)) else F.try_to_timestamp(F.lit(at))
    return df.where(F.coalesce((F.col(start) <= known) & (F.col(end).isNull() | (known < F.col(end))), F.lit(False)))
