"""Encoding of texts with the public byte-level BPE vocabularies, by Spark's own array functions.

A text is cut into pieces by the vocabulary's pattern. A piece that is a token is looked up; every other distinct piece is
encoded once: a fold over the bytes of the piece merges, again and again, the adjacent pair of lowest rank, looking ranks up
in a constant map. The most frequent encoded pieces, of a fixed number, become a second constant map, so that only rare
pieces are joined back to where they stand. A map is an array of small maps by hash, because a lookup in one large map value
scans it from the start; it is bound once for each row, outside the lambda functions that read it.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalith.session import checkpointed, shuffle_partitions

FOLDER = "/opt/tokenizers"
BUCKETS = 1 << 14
#: The frequent pieces that are constants beside the vocabulary: at most this many, each of at most this many bytes.
FREQUENT, FREQUENT_BYTES = 50_000, 64
#: What stands in an array of ids for a piece whose ids are still to come.
GAP = -1
#: Frequencies are told apart in steps of this ratio when the frequent pieces are chosen.
STEP = 1.1
# The pattern of the vocabulary; (?U) makes \s the white space of Unicode.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(name: str = "byte_bpe_50k", folder: str = FOLDER) -> dict[bytes, int]:
    """The tokens of a vocabulary and their ranks, which are their ids."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def constant_map(entries: DataFrame, key: str, value: str, buckets: int = BUCKETS) -> Column:
    """The constant array of ``buckets`` maps, by hash of the key, with all rows of ``entries``, whose number is bounded."""
    held = entries.groupBy(_bucket(F.col(key), buckets).alias("bucket")).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    every = entries.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(held, "bucket", "left")
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "m")), lambda a, b: a["bucket"] - b["bucket"])
    return every.agg(F.transform(ordered, lambda x: x["m"]).alias("m")).scalar()


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"token": list(ranks), "rank": list(ranks.values())}), "token binary, rank int")


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.hash(token), F.lit(buckets))


def value_of(constant: Column, key: Column, buckets: int = BUCKETS) -> Column:
    """What a constant map has for a key, null if nothing."""
    return F.try_element_at(F.get(constant, _bucket(key, buckets)), key)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def fold_merges(ranks: Column, piece: Column) -> Column:
    """The tokens, as an array of binary, of the binary ``piece`` (1 byte at least). ``ranks`` is bound outside.

    The state is the parts, the ranks of adjacent pairs and the lowest of them. A step merges all occurrences of the pair of
    lowest rank, from the left and without overlap, which gives what merging them one by one gives unless a pair that
    this makes has a still lower rank; then only the leftmost is merged in this step. So the steps are as many as there are
    different merges in the piece. When no pair has a rank the state stays as it is.
    """
    n = F.length(piece)
    none = F.array().cast("array<int>")
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(piece, i, F.lit(1)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: value_of(ranks, F.substring(piece, i, F.lit(2))))).otherwise(none)

    def state(p: Column, r: Column) -> Column:
        return bound(r, lambda x: F.struct(p.alias("p"), x.alias("r"), F.array_min(x).alias("m")))

    def merged(s: Column, at: Column, here: Callable[[Column], Column]) -> Column:
        """The state with the pairs merged that begin at the places ``at`` (from 0), which are those for which ``here`` holds."""
        places = F.array_except(F.sequence(F.lit(0), F.size(s["p"]) - 1), F.transform(at, lambda i: i + 1))

        def with_places(k: Column) -> Column:
            joined = F.transform(k, lambda i: F.when(here(i), F.concat(F.get(s["p"], i), F.get(s["p"], i + 1))).otherwise(F.get(s["p"], i)))

            def with_parts(p: Column) -> Column:
                def rank(j: Column) -> Column:
                    new = here(F.get(k, j)) | here(F.get(k, j + 1))
                    return F.when(new, value_of(ranks, F.concat(F.get(p, j), F.get(p, j + 1)))).otherwise(F.get(s["r"], F.get(k, j)))

                return state(p, F.when(F.size(k) > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size(k) - 2, F.lit(0))), rank)).otherwise(none))

            return bound(joined, with_parts)

        return bound(places, with_places)

    def step(s: Column, _: Column) -> Column:
        lowest = lambda i: F.get(s["r"], i).eqNullSafe(s["m"])

        def one(c: Column) -> Column:
            return bound(F.get(c, 0), lambda first: merged(s, F.array(first), lambda i: i == first))

        def every(c: Column) -> Column:
            # runs of places one after the other are equal parts in a row: every second place of a run is merged; the
            # others are second parts of those, so of the places that stay ``lowest`` holds for the chosen ones
            starts = F.filter(c, lambda i: (i == 0) | ~lowest(i - 1))
            ends = F.filter(c, lambda i: ~lowest(i + 1))
            chosen = F.flatten(F.zip_with(starts, ends, lambda a, b: F.sequence(a, b, F.lit(2))))
            part = lambda i: F.get(s["p"], F.get(c, 0) + i)
            again = value_of(ranks, F.concat(part(0), part(1), part(0)))
            safe = lambda t: F.coalesce(t["m"] >= s["m"], F.lit(True)) & F.coalesce(again > s["m"], F.lit(True))
            return bound(merged(s, chosen, lowest), lambda t: F.when(safe(t), t).otherwise(one(c)))

        places = F.filter(F.sequence(F.lit(0), F.size(s["r"]) - 1), lowest)
        return F.when(s["m"].isNull(), s).otherwise(bound(places, lambda c: F.when(F.size(c) == 1, one(c)).otherwise(every(c))))

    return F.aggregate(F.sequence(F.lit(1), n), state(parts, pairs), step)["p"]


def one_text(df: DataFrame, ident: str, text: str) -> DataFrame:
    """id, text: one row for each identifier; of several texts the greatest counts.

    Identifiers are counted first, without texts; only if one comes twice do the texts travel. The filter holds for every row.
    It keeps the optimizer from merging what follows into the aggregate, where constants would be carried by each row.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.max("text").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) >= 0)


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def with_constants(df: DataFrame, body: Callable[..., Column], alias: str, **constants: Column) -> DataFrame:
    """``df`` with the column ``body``(constants...). ``body`` names each constant once, so that the optimizer puts it in place
    and no row carries it; a subquery may not stand in a higher-order function before that."""
    held = df.select("*", *(c.alias(f"_{k}") for k, c in constants.items()))
    return held.select(*df.columns, body(*(F.col(f"_{k}") for k in constants)).alias(alias))


def encoded_pieces(df: DataFrame, text: str, ranks: Column) -> DataFrame:
    """piece, n (occurrences in all rows), ids: each distinct piece, encoded once; no ids if it is itself a token."""
    counted = df.where(F.col(text) != "").select(F.explode(pieces_of(F.col(text))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    b = F.col("piece").cast("binary")
    encode = lambda m: F.when(value_of(m, b).isNull(), F.transform(fold_merges(m, b), lambda t: value_of(m, t)))
    return with_constants(counted.repartition(shuffle_partitions(df.sparkSession)), lambda m: bound(m, encode), "ids", ranks=ranks)


def frequent_pieces(encoded: DataFrame, most: int) -> DataFrame:
    """The rows of ``encoded`` for the most frequent pieces, ``most`` at most, found by a histogram of the frequencies."""
    short = encoded.where(F.col("ids").isNotNull() & (F.octet_length("piece") <= FREQUENT_BYTES)).withColumn("bin", F.floor(F.log("n") / math.log(STEP)).cast("int"))
    bins = short.groupBy("bin").agg(F.count("*").alias("pieces")).orderBy(F.desc("bin")).collect()
    held, least = 0, None
    for r in bins:
        held += r["pieces"]
        if held > most:
            break
        least = r["bin"]
    return short.where(F.col("bin") >= least) if least is not None else short.where(F.lit(False))


def _looked_up(df: DataFrame, ident: str, text: str, name: str, folder: str, frequent: int, ids: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(id, found: ``ids`` of each piece of the text, null if it is rare, and the piece), and the encoded pieces."""
    table = rank_table(df.sparkSession, read_ranks(name, folder))
    encoded = checkpointed(encoded_pieces(df.select(text), text, constant_map(table, "token", "rank")))
    entries = table.select(F.col("token").cast("string").alias("piece"), F.array("rank").alias("ids")).unionByName(frequent_pieces(encoded, frequent).select("piece", "ids"))
    known = constant_map(entries.select("piece", ids(F.col("ids")).alias("ids")), "piece", "ids")
    pieces = F.coalesce(pieces_of(F.col("text")), F.array().cast("array<string>"))  # names the text once, see with_constants
    found = lambda k: F.transform(pieces, lambda t: F.struct(value_of(k, t).alias("ids"), t.alias("piece")))
    return with_constants(one_text(df, ident, text), found, "found", known=known).select("id", "found"), encoded


def _rare(found: Column) -> Column:
    return F.transform(F.filter(found, lambda x: x["ids"].isNull()), lambda x: x["piece"])


def encode_texts(df: DataFrame, ident: str, text: str, name: str = "byte_bpe_50k", folder: str = FOLDER, frequent: int = FREQUENT) -> DataFrame:
    """``ident``, ids: the token ids of each text, without special tokens; what looks like one is plain text.

    Null and empty texts give an empty list. Repeated rows count once; of several texts of an identifier the greatest in
    byte order counts. A null identifier is one like others. Extra columns are ignored. Of the pieces only the ``frequent``
    ones are constants; the others are joined, sorted on both sides, whatever their number.
    """
    looked, encoded = _looked_up(df, ident, text, name, folder, frequent, lambda ids: ids)
    # ids in one array, with GAP where a rare piece stands
    ids = F.flatten(F.transform("found", lambda x: F.coalesce(x["ids"], F.array(F.lit(GAP)))))
    held = checkpointed(looked.select("id", ids.alias("ids"), _rare(F.col("found")).alias("rare")))
    open_ = held.where(F.size("rare") > 0)
    placed = (
        open_.select("id", F.posexplode("rare").alias("at", "piece"))
        .hint("merge")
        .join(encoded.select("piece", F.col("ids").alias("each")), "piece")
        .groupBy("id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "each"))), lambda x: x["each"]).alias("late"))
        .withColumnRenamed("id", "late_id")
    )
    gaps = F.filter(F.transform("ids", lambda x, i: F.when(x == GAP, i)), lambda i: i.isNotNull())

    def stretch(at: Column, k: Column) -> Column:
        """The ids of the rare piece at a gap, and those up to the next one."""
        before = F.when(k > 0, F.get("late", k - 1)).otherwise(F.array().cast("array<int>"))
        return F.concat(before, F.slice("ids", at + 2, F.coalesce(F.get("gaps", k), F.size("ids")) - at - 1))

    filled = (
        open_.select("id", "ids", gaps.alias("gaps"))
        .hint("merge")
        .join(placed, F.col("id").eqNullSafe(F.col("late_id")))
        .select("id", F.flatten(F.transform(F.concat(F.array(F.lit(-1)), "gaps"), stretch)).alias("ids"))
    )
    return held.where(F.size("rare") == 0).select("id", "ids").unionByName(filled).select(F.col("id").alias(ident), "ids")


def count_tokens(df: DataFrame, ident: str, text: str, name: str = "byte_bpe_50k", folder: str = FOLDER, frequent: int = FREQUENT) -> DataFrame:
    """``ident``, tokens: the number of ids that ``encode_texts`` gives."""
    looked, encoded = _looked_up(df, ident, text, name, folder, frequent, lambda ids: F.size(ids))
    total = F.aggregate("found", F.lit(0), lambda a, x: a + F.coalesce(x["ids"], F.lit(0)))
    held = checkpointed(looked.select("id", total.alias("tokens"), _rare(F.col("found")).alias("rare")))
    late = (
        held.select("id", F.explode("rare").alias("piece"))
        .hint("merge")
        .join(encoded.select("piece", F.size("ids").alias("tokens")), "piece")
        .select("id", "tokens")
    )
    whole = held.select("id", "tokens").unionByName(late).groupBy("id").agg(F.sum("tokens").cast("int").alias("tokens"))
    return whole.select(F.col("id").alias(ident), "tokens")


def decode_ids(df: DataFrame, ident: str, ids: str, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``ident``, text: the binary pieces of the ids of each row, one after the other.

    The vocabulary that is broadcast has a fixed size. An unknown id gives nothing; empty ids give an empty text, null ids a
    null one. ``ident`` is unique in ``df``; extra columns are ignored.
    """
    spark = df.sparkSession
    ranks = read_ranks(name, folder)
    rows = spark.createDataFrame(pd.DataFrame({"token": [t.hex() for t in ranks], "rank": list(ranks.values())}), "token string, rank int")
    spelled = (
        df.select(F.col(ident).alias("id"), F.posexplode(ids).alias("at", "rank"))
        .join(F.broadcast(rows), "rank")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("parts"))
        .select("id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda x: x["token"]), "")), "UTF-8").alias("text"))
    )
    empty = df.where(F.col(ids).isNull() | (F.size(ids) == 0)).select(F.col(ident).alias("id"), F.when(F.col(ids).isNotNull(), "").alias("text"))
    return spelled.unionByName(empty).select(F.col("id").alias(ident), "text")
