"""The N highest-scoring items of every group, by mergeable bounded heaps.

Each task keeps, for every group it meets and every score, a heap of at most N items whose top is the worst one kept. The
heaps are the partial states: they are built before the shuffle, so a group of millions of items sends N items for each
task at most, and are merged after it. An item is better with a higher score, then with a smaller identifier in byte order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups a task holds before it hands its heaps on and starts anew; merging makes up for it, so the result is the same.
GROUPS_HELD = 100_000


class Last:
    """A string in reverse order, so that a heap's top is the item whose identifier comes last."""

    __slots__ = ("s",)

    def __init__(self, s: str):
        self.s = s

    def __lt__(self, other: Last) -> bool:
        return self.s > other.s

    def __eq__(self, other: object) -> bool:
        return self.s == other.s  # type: ignore[attr-defined]

    __hash__ = None  # type: ignore[assignment]


def offer(heap: list, n: int, score, ident: str) -> None:
    """Put an item into a bounded heap."""
    if len(heap) < n:
        heapq.heappush(heap, (score, Last(ident)))
    elif score >= heap[0][0]:
        item = (score, Last(ident))
        if heap[0] < item:
            heapq.heapreplace(heap, item)


def top_items(df: DataFrame, keys: Sequence[str], scores: Sequence[str], ident: str, n: int) -> DataFrame:
    """One row for each group: ``keys``, ``records`` (its rows), and for each score ``top_<score>``, an array of at most
    ``n`` structs (score, item), best first.

    ``df`` has one row for each (group, ident); scores are whole numbers. A null score or identifier is no item but counts
    as a row of its group; null keys form a group; other columns are ignored; an empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    source = df.select(*keys, *(F.col(s).cast("long").alias(s) for s in scores), F.col(ident).cast("string").alias(ident))
    item = T.ArrayType(T.StructType([T.StructField("score", T.LongType()), T.StructField("item", T.StringType())]))
    schema = T.StructType(
        [*(source.schema[k] for k in keys), T.StructField("records", T.LongType()), *(T.StructField(s, item) for s in scores)]
    )
    item_type = pa.list_(pa.struct([("score", pa.int64()), ("item", pa.string())]))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        types = None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in state], t) for i, t in enumerate(types)]
            columns.append(pa.array([v[0] for v in state.values()], pa.int64()))
            for i in range(len(scores)):
                columns.append(pa.array([[{"score": s, "item": x.s} for s, x in v[1][i]] for v in state.values()], item_type))
            return pa.RecordBatch.from_arrays(columns, [*keys, "records", *scores])

        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            columns = [b.column(c).to_pylist() for c in (*keys, *scores, ident)]
            for row in zip(*columns):
                key = row[: len(keys)]
                held = state.get(key)
                if held is None:
                    if len(state) >= GROUPS_HELD:
                        yield flush()
                        state.clear()
                    held = state[key] = [0, [[] for _ in scores]]
                held[0] += 1
                if row[-1] is not None:
                    for heap, s in zip(held[1], row[len(keys) : -1]):
                        if s is not None:
                            offer(heap, n, s, row[-1])
        if state:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, records, heaps, done, types = None, 0, [], [], []

        def finished() -> pa.RecordBatch:
            columns = [pa.array([d[0][i] for d in done], t) for i, t in enumerate(types)]
            columns.append(pa.array([d[1] for d in done], pa.int64()))
            columns += [pa.array([d[2][i] for d in done], item_type) for i in range(len(scores))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [*keys, "records", *tops])

        def close() -> None:
            best = [[{"score": s, "item": x.s} for s, x in sorted(h, reverse=True)] for h in heaps]
            done.append((key, records, best))

        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, "records", *scores))):
                if row[: len(keys)] != key:
                    if heaps:
                        close()
                    key, records, heaps = row[: len(keys)], 0, [[] for _ in scores]
                records += row[len(keys)]
                for heap, items in zip(heaps, row[len(keys) + 1 :]):
                    for x in items:
                        offer(heap, n, x["score"], x["item"])
            if len(done) > 10_000:
                yield finished()
        if heaps:
            close()
        if done:
            yield finished()

    tops = [f"top_{s}" for s in scores]
    merged_schema = T.StructType([*schema.fields[: len(keys) + 1], *(T.StructField(t, item) for t in tops)])
    # a group's heaps come one after the other, so what is held is one heap for each score, however many heaps there are
    partial = source.mapInArrow(build, schema)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, merged_schema)


def placed(tops: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """The items of ``top_items`` one by one: keys, side (the score's name), place_no from 1, item, score."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"top_{s}").alias("items")) for s in scores))
    return (
        tops.select(*keys, F.explode(sides).alias("s"))
        .select(*keys, F.col("s.side").alias("side"), F.posexplode("s.items").alias("at", "x"))
        .select(*keys, "side", (F.col("at") + 1).alias("place_no"), F.col("x.item").alias("item"), F.col("x.score").alias("score"))
    )
