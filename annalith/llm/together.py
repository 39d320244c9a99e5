"""Items that appear close together in the same basket, and how far that is above chance.

Pair counts are exact. What chance gives is a bipartite configuration model fitted to the frequency of every item and the
size of every basket: basket r holds item i with probability x_r y_i / (1 + x_r y_i). A pair that a basket holds stands
close in it with the share of its item pairs that do. The number of baskets with the close pair is then Poisson-binomial;
its upper tail (by saddlepoint) is the surprise, and false discoveries are controlled over all pairs of items.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalith.session import checkpointed

#: A basket of more rows than this is read in parts of about as many rows, by several tasks.
HOT_ROWS = 256
#: Entries a task gathers before it hands them on.
HELD = 1_000_000
SIZE_STEP, CLOSE_STEP, FREQUENCY_STEP = 1.25, 1.6, 1.05


@dataclass
class Null:
    """The fitted model. Baskets in classes of like size and closeness; items by frequency."""

    baskets: np.ndarray  # of each class: how many
    x: np.ndarray
    close: np.ndarray  # of each class: share of its item pairs that stand close
    log_n: np.ndarray  # of each frequency class
    log_y: np.ndarray

    def chance(self, n: np.ndarray) -> np.ndarray:
        """For items of frequencies n, the probability in a basket of each class."""
        xy = np.exp(np.interp(np.log(n), self.log_n, self.log_y))[:, None] * self.x[None, :]
        return xy / (1 + xy)


def fit(sizes, baskets, close, frequencies, items, rounds: int = 500, tolerance: float = 1e-8) -> Null:
    """Fixed-point fit of the configuration model: expected basket sizes and item frequencies equal the observed ones."""
    s, w, n, m = (np.asarray(v, float) for v in (sizes, baskets, frequencies, items))
    n = np.minimum(n, w.sum() - 0.5)
    s = np.minimum(s, m.sum() - 0.5)
    total = (w * s).sum()
    x, y = s / math.sqrt(total), n / math.sqrt(total)
    for _ in range(rounds):
        was = x
        x = s / (m * y / (1 + np.outer(x, y))).sum(1)
        y = n / (w[:, None] * x[:, None] / (1 + np.outer(x, y))).sum(0)
        if np.max(np.abs(x / was - 1)) < tolerance:
            break
    order = np.argsort(n)
    return Null(w, x, np.asarray(close, float), np.log(n[order]), np.log(y[order]))


_erfc = np.frompyfunc(math.erfc, 1, 1)


def log_tail(p: np.ndarray, w: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected, natural log of P(X >= k)) of X, the sum of w[c] trials of chance p[row, c], for each row.

    Lugannani-Rice for lattice variables; a k at or under the mean gives at least a half, reported as 0 (no surprise).
    """
    p = np.clip(p, 1e-300, 1 - 1e-12)
    mean = (w * p).sum(1)
    out = np.zeros(len(k))
    at = np.flatnonzero(k > mean + 0.5)
    if not len(at):
        return mean, out
    p, k = p[at], k[at].astype(float)
    k = np.minimum(k, w.sum() - 1e-6)
    t = np.log(k / mean[at])
    for _ in range(60):  # K'(t) = k by Newton, damped
        e = p * np.exp(t)[:, None]
        q = e / (1 - p + e)
        step = ((w * q).sum(1) - k) / np.maximum((w * q * (1 - q)).sum(1), 1e-300)
        t = t - np.clip(step, -1, 1)
        if np.max(np.abs(step)) < 1e-10:
            break
    e = p * np.exp(t)[:, None]
    q = e / (1 - p + e)
    cumulant = (w * np.log1p(p * np.expm1(t)[:, None])).sum(1)
    r = np.sqrt(np.maximum(2 * (t * k - cumulant), 1e-12))
    u = -np.expm1(-t) * np.sqrt((w * q * (1 - q)).sum(1))
    near = np.minimum(r, 20)
    mills = np.where(r < 20, _erfc(near / math.sqrt(2)).astype(float) * math.sqrt(math.pi / 2) * np.exp(near**2 / 2), 1 / r - 1 / r**3 + 3 / r**5)
    out[at] = np.minimum(0, -(r**2) / 2 - 0.5 * math.log(2 * math.pi) + np.log(np.maximum(mills + 1 / u - 1 / r, 1e-300)))
    return mean, out


def by_basket(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[str, bool, list[list[str]]]]:
    """(basket, is it hot, the items of each of its texts in order) from batches sorted by basket."""
    find = re.compile("[a-z0-9]{%d,}" % length).findall
    basket, hot, texts = None, False, []
    for b in batches:
        for name, is_hot, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if name != basket or is_hot and len(texts) >= HOT_ROWS:
                if texts:
                    yield basket, hot, texts
                basket, hot, texts = name, is_hot, []
            texts.append(find(text.lower()))
    if texts:
        yield basket, hot, texts


def close_codes(texts: list[np.ndarray], window: int) -> np.ndarray:
    """The distinct pairs of a basket, as smaller id * 2^32 + larger id; ids under 0 and equal ids make no pair."""
    found = []
    for ids in texts:
        for gap in range(1, window + 1):
            a, b = ids[:-gap], ids[gap:]
            keep = (a >= 0) & (b >= 0) & (a != b)
            a, b = a[keep], b[keep]
            found.append((np.minimum(a, b) << 32) | np.maximum(a, b))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _spread(df: DataFrame, basket: str, text: str) -> tuple[DataFrame, bool]:
    """Rows with a text that isn't empty, gathered by basket, or by part of a hot one; and whether any is hot."""
    rows = df.where(F.col(basket).isNotNull() & (F.col(text) != "")).select(F.col(basket).cast("string").alias("b"), F.col(text).alias("t"))
    hot = checkpointed(rows.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS))
    any_hot = not hot.isEmpty()
    if any_hot:
        parts = F.ceil(F.col("n") / HOT_ROWS)
        rows = rows.join(hot, "b", "left").select("b", F.col("n").isNotNull().alias("hot"), "t", F.coalesce(F.pmod(F.xxhash64("t"), parts), F.lit(0)).alias("part"))
    else:
        rows = rows.select("b", F.lit(False).alias("hot"), "t", F.lit(0).alias("part"))
    return rows.repartition("b", "part").sortWithinPartitions("b", "part"), any_hot


def close_pairs(df: DataFrame, basket: str, text: str, min_length: int = 5, window: int = 3, min_count: int = 3, min_share: float | None = 0.004) -> DataFrame:
    """One row for each pair of different items close together in at least ``min_count`` baskets and ``min_share`` of them.

    Without ``min_share`` (None) the floor is ``min_count`` alone, whatever the number of baskets: nothing is broadcast but the
    null model, pairs are counted by their items, and the frequencies of the items are joined.

    Items are the longest runs of a-z and 0-9 of at least ``min_length`` characters of the lower-cased text; a basket has
    the pair if in any of its texts the items stand at most ``window`` places apart. Columns: item_a < item_b, n_a, n_b,
    n_ab, baskets (with a text that isn't empty), expected (by the null model), log10_p, items (distinct ones in all).

    Rows with a null basket, and null or empty texts, are left out; repeated texts of a basket change nothing; an empty
    table, or one without items, gives an empty result. Items too rare for any such pair are dropped before pairs are
    formed; those left number at most (items a basket has on average) / min_share, and only those are broadcast.
    """
    if min_share is not None and not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0, as it bounds what is broadcast, or None")
    spark = df.sparkSession
    spread, hot = _spread(df, basket, text)

    def count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        classes: dict[int, list[float]] = {}
        hot_rows: set = set()

        def rows(kind, b=None, item=None, code=None, n=None, s=None, q=None):
            size = len(next(v for v in (n, item, code) if v is not None))
            column = lambda v, t: pa.array(v, t) if v is not None else pa.nulls(size, t)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * size, pa.int32()), column(b, pa.string()), column(item, pa.string()), column(code, pa.int64()),
                 column(n, pa.int64()), column(s, pa.float64()), column(q, pa.float64())],
                ["kind", "b", "item", "code", "n", "s", "q"],
            )

        def handed_on():
            if counts:
                yield rows(0, item=list(counts), n=list(counts.values()))
                counts.clear()
            if hot_rows:
                for kind, size in ((4, 1), (2, 2), (3, 3)):  # the basket itself, as it may have no items; items, and pairs as "a b"
                    part = [x for x in hot_rows if len(x) == size]
                    if part:
                        yield rows(kind, b=[x[0] for x in part], item=[" ".join(x[1:]) for x in part])
                hot_rows.clear()

        for name, is_hot, texts in by_basket(batches, min_length):
            distinct = sorted({i for t in texts for i in t})
            ids = {i: k for k, i in enumerate(distinct)}
            codes = close_codes([np.array([ids[i] for i in t], np.int64) for t in texts], window)
            if is_hot:
                hot_rows.add((name,))
                hot_rows.update((name, i) for i in distinct)
                hot_rows.update((name, distinct[c >> 32], distinct[c & 0xFFFFFFFF]) for c in codes.tolist())
            else:
                counts.update(distinct)
                s, m = len(distinct), len(codes)
                q = m / (s * (s - 1) / 2) if s > 1 else 0.0
                c = basket_class(s, q)
                held = classes.setdefault(c, [0, 0.0, 0.0])
                held[0] += 1
                held[1] += s
                held[2] += q
            if len(counts) + len(hot_rows) > HELD:
                yield from handed_on()
        yield from handed_on()
        if classes:
            yield rows(1, code=list(classes), n=[v[0] for v in classes.values()], s=[v[1] for v in classes.values()], q=[v[2] for v in classes.values()])

    found = spread.select("b", "hot", "t").mapInArrow(count_items, "kind int, b string, item string, code long, n long, s double, q double")
    first = checkpointed(found.groupBy("kind", "b", "item", "code").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    items = (
        first.where("kind = 0").select("item", "n")
        .unionByName(first.where("kind = 2").select("item", F.lit(1).cast("long").alias("n")))
        .groupBy("item").agg(F.sum("n").alias("n"))
    )
    classes = [(r["n"], r["s"], r["q"]) for r in first.where("kind = 1").select("n", "s", "q").collect()]
    for r in _hot_classes(first).collect():
        classes.append((r["n"], r["s"], r["q"]))
    schema = "item_a string, item_b string, n_a long, n_b long, n_ab long, baskets long, expected double, log10_p double, items long"
    baskets = sum(c[0] for c in classes)
    filled = [c for c in classes if c[1] > 0]
    if not filled:
        return spark.createDataFrame([], schema)
    least = max(min_count, math.ceil((min_share or 0) * baskets - 1e-9), 1)
    bins = items.groupBy(F.floor(F.log("n") / math.log(FREQUENCY_STEP)).alias("bin")).agg(F.count("*").alias("items"), F.avg("n").alias("n")).collect()
    null = fit([c[1] / c[0] for c in filled], [c[0] for c in filled], [min(1.0, c[2] / c[0]) for c in filled], [r["n"] for r in bins], [r["items"] for r in bins])
    all_items = sum(r["items"] for r in bins)
    if min_share is None:
        return _scored(_counted_by_name(spread, items, hot, min_length, window, least), null, baskets, all_items, schema)
    frequent = sorted((r["item"], r["n"]) for r in items.where(F.col("n") >= least).collect())
    names, n_of = [i for i, _ in frequent], np.array([n for _, n in frequent], np.int64)
    shared = spark.sparkContext.broadcast((names, n_of, null))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {i: k for k, i in enumerate(shared.value[0])}
        held, size = [], 0

        def handed_on():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["b", "code", "n"])

        for name, is_hot, texts in by_basket(batches, min_length):
            codes = close_codes([np.array([ids.get(i, -1) for i in t], np.int64) for t in texts], window)
            if is_hot:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(np.ones(len(codes), np.int64))], ["b", "code", "n"])
                continue
            held.append(codes)
            size += len(codes)
            if size > 2 * HELD:
                yield handed_on()
                held, size = [], 0
        if held:
            yield handed_on()

    partial = spread.select("b", "hot", "t").mapInArrow(count_pairs, "b string, code long, n long")
    if hot:
        partial = partial.where("b IS NULL").unionByName(partial.where("b IS NOT NULL").distinct())
    counted = partial.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n_of, null = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                code, n = (batch.column(i).slice(at, 2000).to_numpy() for i in range(2))
                a, b = code >> 32, code & 0xFFFFFFFF
                mean, tail = log_tail(null.chance(n_of[a]) * null.chance(n_of[b]) * null.close, null.baskets, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in a]), pa.array([names[i] for i in b]), pa.array(n_of[a]), pa.array(n_of[b]), pa.array(n),
                     pa.array(np.full(len(n), baskets)), pa.array(mean), pa.array(tail / math.log(10)), pa.array(np.full(len(n), all_items))],
                    ["item_a", "item_b", "n_a", "n_b", "n_ab", "baskets", "expected", "log10_p", "items"],
                )

    return counted.mapInArrow(score, schema)


def _hot_classes(first: DataFrame) -> DataFrame:
    """n, s, q of the hot baskets, brought together by class; there are at most as many classes as of others."""
    each = first.where("kind IN (2, 3, 4)").groupBy("b").agg(F.count_if(F.col("kind") == 2).cast("double").alias("s"), F.count_if(F.col("kind") == 3).alias("m"))
    each = each.select("s", (F.col("m") / F.greatest(F.lit(1.0), F.col("s") * (F.col("s") - 1) / 2)).alias("q"))
    step = lambda c, size: F.floor(F.log(c) / math.log(size))
    return each.groupBy(F.when(F.col("s") >= 1, step(F.col("s"), SIZE_STEP)), F.when(F.col("q") > 0, step(F.col("q"), CLOSE_STEP))).agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def _counted_by_name(spread: DataFrame, items: DataFrame, hot: bool, length: int, window: int, least: int) -> DataFrame:
    """item_a, item_b, n_a, n_b, n_ab of all pairs in at least ``least`` baskets; ids are a task's own and never leave it."""

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        held, size = [], 0

        def named(codes, n, basket=None):
            names = np.array(list(ids), dtype=object)
            a, b = names[codes >> 32], names[codes & 0xFFFFFFFF]
            swap = a > b
            return pa.RecordBatch.from_arrays(
                [pa.array([basket] * len(codes), pa.string()), pa.array(np.where(swap, b, a), pa.string()), pa.array(np.where(swap, a, b), pa.string()), pa.array(n.astype(np.int64))],
                ["b", "item_a", "item_b", "n"],
            )

        for name, is_hot, texts in by_basket(batches, length):
            codes = close_codes([np.array([ids.setdefault(i, len(ids)) for i in t], np.int64) for t in texts], window)
            if is_hot:
                yield named(codes, np.ones(len(codes)), name)
            else:
                held.append(codes)
                size += len(codes)
            if size > 2 * HELD or len(ids) > HELD:
                if held:
                    yield named(*np.unique(np.concatenate(held), return_counts=True))
                ids, held, size = {}, [], 0
        if held:
            yield named(*np.unique(np.concatenate(held), return_counts=True))

    partial = spread.select("b", "hot", "t").mapInArrow(count_pairs, "b string, item_a string, item_b string, n long")
    if hot:
        partial = partial.where("b IS NULL").unionByName(partial.where("b IS NOT NULL").distinct())
    counted = partial.groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    for side in ("a", "b"):
        counted = counted.join(items.select(F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}")), f"item_{side}")
    return counted.select("item_a", "item_b", "n_a", "n_b", "n_ab")


def _scored(counted: DataFrame, null: Null, baskets: int, all_items: int, schema: str) -> DataFrame:
    """``counted`` with the columns that the null model gives. Pairs of equal frequencies and count are scored once."""
    shared = counted.sparkSession.sparkContext.broadcast(null)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        null = shared.value
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in (2, 3, 4))
            kinds, which = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), n], 1), axis=0, return_inverse=True)
            mean, tail = (
                np.concatenate(x)
                for x in zip(
                    (np.empty(0), np.empty(0)),
                    *(log_tail(null.chance(k[:, 0]) * null.chance(k[:, 1]) * null.close, null.baskets, k[:, 2]) for k in (kinds[at : at + 2000] for at in range(0, len(kinds), 2000))),
                )
            )
            which = which.ravel()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(np.full(len(n), baskets)), pa.array(mean[which]), pa.array(tail[which] / math.log(10)), pa.array(np.full(len(n), all_items))],
                ["item_a", "item_b", "n_a", "n_b", "n_ab", "baskets", "expected", "log10_p", "items"],
            )

    return counted.mapInArrow(score, schema)


def basket_class(size: int, close: float) -> int:
    """The class of a basket: its size and its share of close pairs, each on a geometric scale."""
    a = 0 if size < 1 else 1 + int(math.log(size) / math.log(SIZE_STEP))
    b = 0 if close <= 0 else 1 + min(40, int(-math.log(close) / math.log(CLOSE_STEP)))
    return a * 64 + b


def discoveries(pairs: DataFrame, rate: float = 0.05) -> DataFrame:
    """``pairs`` with ``significant``: whether the pair is among the discoveries at false-discovery rate ``rate``.

    Benjamini-Hochberg over all pairs of items; pairs that ``pairs`` doesn't list count as tests without a discovery. The
    ranks come from a histogram of log10_p in steps of 0.01 (at most 100,000 of them), each taken at its greater end, so the
    rate holds. An empty input stays empty.
    """
    bins = (
        pairs.groupBy(F.least(F.floor(-F.col("log10_p") * 100), F.lit(100_000)).cast("long").alias("bin"))
        .agg(F.count("*").alias("n"), F.max("items").alias("items"))
        .orderBy(F.desc("bin"))
        .collect()
    )
    rank, least = 0, None
    for r in bins:
        rank += r["n"]
        tests = r["items"] * (r["items"] - 1) / 2
        if -r["bin"] / 100 <= math.log10(rate * rank / max(tests, 1)):
            least = r["bin"]
    if least is None:
        return pairs.withColumn("significant", F.lit(False))
    return pairs.withColumn("significant", F.floor(-F.col("log10_p") * 100) >= least)
