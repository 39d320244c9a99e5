"""The frontier of a crawl over a link table: selection, recovery, merging, and the traversal itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalith import constants as C
from annalith.functions.text import is_followed, title_key
from annalith.session import checkpointed

STATUSES = ("pending", "inflight", "stored", "failed")


def batch(frontier: DataFrame, size: int = C.CRAWL_BATCH, max_depth: int = C.CRAWL_DEPTH, room: int | None = None) -> DataFrame:
    """The pending pages to take next: at most ``size`` and ``room``, least depth first, then oldest, then by key."""
    n = size if room is None else max(0, min(size, room))
    return frontier.where((F.col("status") == "pending") & (F.col("depth") <= max_depth)).orderBy("depth", "enqueued_at", "key").limit(n)


def recover_stale(frontier: DataFrame, now: str, minutes: int = C.STALE_MINUTES) -> DataFrame:
    """The frontier with pages that have been in flight for ``minutes`` or longer pending again."""
    stale = (F.col("status") == "inflight") & (F.unix_micros("claimed_at") <= F.unix_micros(F.to_timestamp(F.lit(now))) - minutes * 60_000_000)
    return frontier.withColumns(
        {"status": F.when(stale, "pending").otherwise(F.col("status")), "claimed_at": F.when(stale, None).otherwise(F.col("claimed_at"))}
    )


def status_counts(frontier: DataFrame) -> DataFrame:
    """One row: total and the number of each status."""
    return frontier.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def claim(frontier: DataFrame, taken: DataFrame, now: str) -> DataFrame:
    """The frontier with the pending pages among ``taken`` (key; see ``batch``, which bounds it) in flight since ``now``."""
    mine = F.broadcast(taken.select("key", F.lit(True).alias("_taken")).distinct())
    is_mine = F.coalesce("_taken", F.lit(False)) & (F.col("status") == "pending")
    return (
        frontier.join(mine, "key", "left")
        .withColumns({"claimed_at": F.when(is_mine, F.to_timestamp(F.lit(now))).otherwise(F.col("claimed_at")), "status": F.when(is_mine, "inflight").otherwise(F.col("status"))})
        .select(*frontier.columns)
    )


def settle(frontier: DataFrame, outcomes: DataFrame, now: str, most: int = 3) -> DataFrame:
    """The frontier after attempts on pages in flight: ``outcomes`` has key and failed, one row for each page.

    A page that didn't fail is stored, with ``claimed_at`` the time ``now``; a failed one has a retry more and is pending again
    until it has ``most`` of them, then failed. Pages that aren't in flight stay as they are.
    """
    tried = outcomes.select("key", F.coalesce("failed", F.lit(False)).alias("_failed"))
    mine = F.col("_failed").isNotNull() & (F.col("status") == "inflight")
    failed = mine & F.col("_failed")
    tries = F.coalesce("retries", F.lit(0)) + 1
    new = {
        "status": F.when(failed, F.when(tries < most, "pending").otherwise("failed")).when(mine, "stored").otherwise(F.col("status")),
        "claimed_at": F.when(failed, None).when(mine, F.to_timestamp(F.lit(now))).otherwise(F.col("claimed_at")),
        "retries": F.when(failed, tries).otherwise(F.col("retries")),
    }
    return frontier.join(tried, "key", "left").select(*(new.get(c, F.col(c)).alias(c) for c in frontier.columns))


def discovered(links: DataFrame, max_depth: int = C.CRAWL_DEPTH, now: str | None = None) -> DataFrame:
    """key, title, depth, discovered_from, enqueued_at: for each page found, its occurrence of least depth, ties by origin, then title.

    ``links`` has title, depth, discovered_from; deeper ones than ``max_depth`` are left out. ``now`` is when they are enqueued.
    """
    return (
        links.withColumn("key", title_key(F.col("title")))
        .where((F.col("depth") <= max_depth) & (F.col("key") != ""))
        .groupBy("key")
        .agg(F.min(F.struct("depth", "discovered_from", "title")).alias("x"))
        .select("key", "x.title", "x.depth", "x.discovered_from", F.to_timestamp(F.lit(now)).alias("enqueued_at"))
    )


def merge(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """The frontier, with all its columns, after ``found`` (see ``discovered``) has come in.

    New pages are pending, without retries and null in other columns; a pending page found at less depth takes depth, origin
    and time of the find and keeps the rest; others stay. One aggregation over both, without a join.
    """
    find = F.struct("depth", "discovered_from", "title", "enqueued_at")
    record = F.struct(*frontier.columns)
    both = (
        frontier.select("key", record.alias("old"))
        .unionByName(found.select("key", find.alias("find")), allowMissingColumns=True)
        .groupBy("key")
        .agg(F.first("old", ignorenulls=True).alias("old"), F.min("find").alias("find"))
    )
    new = F.col("old").isNull()
    nearer = ~new & (F.col("old.status") == "pending") & F.col("find").isNotNull() & (F.col("find.depth") < F.col("old.depth"))
    kind = {f.name: f.dataType for f in frontier.schema}
    fresh = {"title": F.col("find.title"), "status": F.lit("pending"), "retries": F.lit(0)}

    def column(c: str):
        if c == "key":
            return F.col("key")
        if c in ("depth", "discovered_from", "enqueued_at"):
            return F.when(new | nearer, F.col(f"find.{c}")).otherwise(F.col(f"old.{c}")).cast(kind[c]).alias(c)
        return F.when(new, fresh.get(c, F.lit(None))).otherwise(F.col(f"old.{c}")).cast(kind[c]).alias(c)

    return both.select(*map(column, frontier.columns))


def unseen(candidates: DataFrame, *known: DataFrame, cap: int = 100_000) -> DataFrame:
    """key of the candidates that no table in ``known`` has, each once, at most ``cap``, by key."""
    rows = candidates.select("key").where("key IS NOT NULL").distinct()
    for k in known:
        rows = rows.join(k.select("key").distinct(), "key", "left_anti")
    return rows.orderBy("key").limit(cap)


def seed(frontier: DataFrame, titles: DataFrame) -> DataFrame:
    """The frontier with ``titles`` at depth 0 where their key isn't there yet; what is there stays as it is."""
    new = (
        titles.withColumn("key", title_key(F.col("title")))
        .where("key <> ''")
        .groupBy("key")
        .agg(F.min("title").alias("title"))
        .join(frontier.select("key"), "key", "left_anti")
        .withColumns({"depth": F.lit(0), "status": F.lit("pending")})
    )
    return frontier.unionByName(new, allowMissingColumns=True)


def traverse(
    links: DataFrame, seeds: DataFrame, max_depth: int = C.CRAWL_DEPTH, max_rounds: int = C.CRAWL_ROUNDS, max_pages: int | None = None
) -> DataFrame:
    """key, depth: the pages reached from ``seeds`` (title) over ``links`` (src_title, dst_title) and the fewest steps to them.

    One round for each step; each round's pages are written to the shared folder, so plans stay short and a lost executor
    costs no earlier round. It ends when nothing new is found, after ``max_rounds``, or at ``max_pages`` pages, of which
    the nearest are kept, then by key. Links that a crawl doesn't follow and null titles are left out.
    """
    edges = (
        links.where(is_followed(F.col("dst_title")))
        .select(title_key(F.col("src_title")).alias("src"), title_key(F.col("dst_title")).alias("key"))
        .where("src <> '' AND key <> '' AND src <> key")
        .distinct()
    )
    edges = checkpointed(edges)
    last = checkpointed(seeds.select(title_key(F.col("title")).alias("key")).where("key <> ''").distinct().withColumn("depth", F.lit(0)))
    reached, total = last, last.count()
    for depth in range(1, min(max_depth, max_rounds) + 1):
        if max_pages is not None and total >= max_pages:
            break
        step = edges.join(last.select(F.col("key").alias("src")), "src", "left_semi").select("key").distinct()
        last = checkpointed(step.join(reached, "key", "left_anti").withColumn("depth", F.lit(depth)))
        new = last.count()
        if not new:
            break
        reached, total = reached.unionByName(last), total + new
    return reached if max_pages is None else reached.orderBy("depth", "key").limit(max_pages)
