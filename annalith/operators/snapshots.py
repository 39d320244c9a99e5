"""What changed between full snapshots.

A snapshot is reduced to (key, digest of the value). Keys fall into hash ranges, the leaves of a Merkle tree whose inner
nodes are hash prefixes; the tree is as deep as the number of keys asks for. The trees of two snapshots are compared from the
root down: children are looked at only under nodes whose digests differ, and rows only in leaves that differ. The revisions of
pages are snapshots too: the k-th of every page make the k-th snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalith.operators.sequence import BLOCKS, numbered
from annalith.session import checkpointed

#: Bits of the key's hash that one level of the tree adds, and keys of a leaf, about.
STEP_BITS, LEAF_KEYS = 4, 256
MOST_BITS = 40
WS = " \t\r\n"


def trimmed(text: Column) -> Column:
    """CR LF as LF, and spaces, tabs, CR and LF cut off at both ends."""
    return F.btrim(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(WS))


def digest(text: Column) -> Column:
    return F.md5(trimmed(text))


def levels_for(keys: int) -> list[int]:
    """The bits that name a node at each level, from the root (0) to the leaves."""
    levels = [0, STEP_BITS]
    while keys >> levels[-1] > LEAF_KEYS and levels[-1] < MOST_BITS:
        levels.append(levels[-1] + STEP_BITS)
    return levels


def _node(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def merkle_tree(rows: DataFrame, snapshot: str, key: str, value: str, levels: list[int]) -> dict[int, DataFrame]:
    """For each level, how every node of every snapshot differs from the snapshot before, built upwards from the leaves.

    ``rows`` has each row with ``side`` 1 in its own snapshot and -1 in the next. A digest is the number of a node's rows and
    two sums of 32-bit hashes over (key, value), as differences of the sides: rows can come in any order, the sums are combined
    before the shuffle, and nodes of equal digests cancel out, up to the root.
    """
    h = F.md5(F.concat_ws("\x00", key, value))
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long") * F.col("side")
    leaves = rows.where(F.col(value).isNotNull()).groupBy(snapshot, _node(key, levels[-1]).alias("node"))
    tree = {levels[-1]: checkpointed(leaves.agg(F.sum("side").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(9)).alias("b")))}
    for bits, below in zip(reversed(levels[:-1]), reversed(levels)):
        up = F.shiftright("node", below - bits).alias("node") if bits else F.lit(0).cast("long").alias("node")
        tree[bits] = tree[below].groupBy(snapshot, up).agg(*(F.sum(c).alias(c) for c in ("n", "a", "b")))
    return tree


def both_sides(rows: DataFrame, snapshot: str, goes_on: Column | None = None) -> DataFrame:
    """Every row with side 1 in its own snapshot and, where it ``goes_on``, with side -1 in the next, for which it is what was before."""
    sides = F.array(F.lit(1), F.lit(-1))
    if goes_on is not None:
        sides = F.when(goes_on, sides).otherwise(F.array(F.lit(1)))
    return rows.withColumn("side", F.explode(sides)).withColumn(snapshot, F.col(snapshot) + F.when(F.col("side") < 0, 1).otherwise(0))


def differing_leaves(tree: dict[int, DataFrame], snapshot: str, levels: list[int]) -> DataFrame:
    """(snapshot, node) of the leaves that differ from those of the snapshot before, found from the root down."""
    found = None
    for above, bits in zip([None, *levels], levels):
        differ = tree[bits].where("n <> 0 OR a <> 0 OR b <> 0").select(snapshot, "node")
        if found is not None:
            up = F.shiftright("node", bits - above) if above else F.lit(0).cast("long")
            parent = found.select(F.col(snapshot), F.col("node").alias("parent"))
            differ = differ.withColumn("parent", up).join(parent, [snapshot, "parent"], "left_semi").select(snapshot, "node")
        found = differ
    return found


def changes_by_tree(rows: DataFrame, snapshot: str, key: str, value: str, *more: str) -> DataFrame:
    """(snapshot, key, change_kind, ``more`` of the later row) of rows with their sides (see ``both_sides``).

    A null value is no row, but its ``more`` is known. Only rows of differing leaves are compared; both sides of a key meet in
    one hash aggregate. How many keys there are is estimated, which decides about the tree's depth alone.
    """
    keys = rows.agg(F.approx_count_distinct(key)).first()[0]
    levels = levels_for(keys)
    leaves = differing_leaves(merkle_tree(rows, snapshot, key, value, levels), snapshot, levels)
    both = rows.withColumn("node", _node(key, levels[-1])).hint("merge").join(leaves, [snapshot, "node"], "left_semi")
    now, was = F.col("now"), F.col("was")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    kind = F.when(was.isNull() & now.isNotNull(), "added").when(now.isNull() & was.isNotNull(), "removed").when(now != was, "changed")
    return (
        both.groupBy(snapshot, key)
        .agg(of(1, value).alias("now"), of(-1, value).alias("was"), *(of(1, c).alias(c) for c in more))
        .select(snapshot, key, kind.alias("change_kind"), *more)
        .where("change_kind IS NOT NULL")
    )


def snapshot_changes(rows: DataFrame, snapshot: str, key: str, value: str, first: int, last: int) -> DataFrame:
    """(snapshot, key, change_kind) for each snapshot number in first..last against the number before.

    ``rows`` has one row for each (snapshot, key) with a digest in ``value``; a null digest is no row. A snapshot without
    any row is an empty one. The table of digests is written once and read from there.
    """
    digests = checkpointed(rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(snapshot, key, value))
    sides = both_sides(digests, snapshot).where(F.col(snapshot).between(first, last))
    return changes_by_tree(sides, snapshot, key, value)


def year_changes(history: DataFrame, first: int = 2009, last: int = 2019) -> DataFrame:
    """page_id, row_ref (the year), change_kind between consecutive years of full year-end texts.

    An article is in a year's snapshot if its text is not null; texts are compared trimmed. Repeated deliveries count
    once, since only digests are gathered; if copies disagree the greatest digest stands.
    """
    rows = (
        history.where("page_id IS NOT NULL AND year IS NOT NULL AND text IS NOT NULL")
        .select("page_id", "year", digest(F.col("text")).alias("digest"))
        .groupBy("page_id", "year")
        .agg(F.max("digest").alias("digest"))
    )
    return snapshot_changes(rows, "year", "page_id", "digest", first, last).select(
        "page_id", F.col("year").cast("string").alias("row_ref"), "change_kind"
    )


def revision_changes(revisions: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """page_id, row_ref (the rev_id), change_kind along the revisions of each page, by (ts, rev_id as a number).

    Rows without rev_id, ts or page_id are left out; a null or blank content means that nothing is there, as before the
    first revision. A page's revisions are numbered by blocks of time, so a page with very many of them is work for several
    tasks; its k-th revision is its row in the k-th snapshot, and a page of k revisions isn't asked for in snapshot k + 1.
    """
    rows = (
        revisions.where("rev_id IS NOT NULL AND ts IS NOT NULL AND page_id IS NOT NULL")
        .select(
            "page_id",
            "rev_id",
            "ts",
            F.col("rev_id").try_cast("decimal(38,0)").alias("no"),
            F.when(F.coalesce(trimmed(F.col("content")), F.lit("")) != "", digest(F.col("content"))).alias("digest"),
        )
        .groupBy("page_id", "rev_id", "ts", "no")
        .agg(F.max("digest").alias("digest"))
    )
    counted = checkpointed(numbered(checkpointed(rows), "page_id", "ts", ["no", "rev_id"], blocks).select("number", "count", "page_id", "rev_id", "digest"))
    sides = both_sides(counted, "number", F.col("number") < F.col("count")).drop("count")
    changes = changes_by_tree(sides, "number", "page_id", "digest", "rev_id")
    return changes.select("page_id", F.col("rev_id").alias("row_ref"), "change_kind")
