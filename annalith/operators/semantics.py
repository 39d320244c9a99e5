"""Co-occurrence of words, hashed embeddings, nearest neighbours, alignment of years, and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalith import constants as C
from annalith.functions import vectors as V
from annalith.functions.text import words


def forward_pairs(texts: DataFrame, window: int = C.WINDOW, min_length: int = C.MIN_LENGTH, max_tokens: int = C.MAX_TOKENS) -> DataFrame:
    """page_id, year, word, neighbour: each word with the ``window`` words after it, among those kept; equal words skipped.

    Shifted copies of the word array are zipped, so there is no join and no shuffle.
    """
    t = F.slice(words(F.col("text"), min_length), 1, max_tokens)
    shifted = F.concat(*(F.arrays_zip(F.col("t").alias("word"), F.slice(F.col("t"), gap + 1, max_tokens).alias("neighbour")) for gap in range(1, window + 1)))
    return (
        texts.select("page_id", "year", t.alias("t"))
        .select("page_id", "year", F.inline(shifted))
        .where("neighbour IS NOT NULL AND word IS NOT NULL AND word <> neighbour")
    )


def cooccurrence(
    texts: DataFrame, window: int = C.WINDOW, min_length: int = C.MIN_LENGTH, per_text: int = C.MAX_NEIGHBOURS, top: int = C.NEIGHBOURS
) -> DataFrame:
    """year, word, place_no, neighbour, count: the neighbours of each word of a year, most frequent first, ties by neighbour.

    Of each text the ``per_text`` most frequent neighbours of a word count, ties by neighbour.
    """
    of_text = Window.partitionBy("page_id", "year", "word").orderBy(F.desc("count"), "neighbour")
    order = Window.partitionBy("year", "word").orderBy(F.desc("count"), "neighbour")
    return (
        forward_pairs(texts, window, min_length)
        .groupBy("page_id", "year", "word", "neighbour")
        .agg(F.count("*").alias("count"))
        .withColumn("r", F.row_number().over(of_text))
        .where(F.col("r") <= per_text)
        .groupBy("year", "word", "neighbour")
        .agg(F.sum("count").alias("count"))
        .withColumn("place_no", F.row_number().over(order))
        .where(F.col("place_no") <= top)
        .select("year", "word", "place_no", "neighbour", "count")
    )


def embeddings(
    neighbours: DataFrame, dimension: int = C.DIMENSION, most: int = C.EMBED_NEIGHBOURS, min_count: int = 1, features: int = C.TOP_FEATURES
) -> DataFrame:
    """year, word, vector, norm, feature_count, top_features from co-occurrence rows.

    Words are reduced to a-z and 0-9; of each row's neighbours the ``most`` frequent of at least ``min_count`` count. A
    neighbour adds the logarithm of 1 + its count, with the sign of one hash, at the place of another; the vector has
    length 1 and ``norm`` is its length before (0 gives a zero vector).
    """
    dimension = max(8, dimension)
    fold = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]", "")
    by_count = Window.partitionBy("year", "word").orderBy(F.desc("count"), "neighbour")
    counts = (
        neighbours.select("year", fold("word").alias("word"), fold("neighbour").alias("neighbour"), "count")
        .where((F.col("word") != "") & (F.col("neighbour") != "") & (F.col("count") >= min_count))
        .groupBy("year", "word", "neighbour")
        .agg(F.sum("count").alias("count"))
        .withColumn("r", F.row_number().over(by_count))
        .where(F.col("r") <= most)
    )
    # the hash of a word with a suffix goes on from that of the word
    hashed = counts.withColumn("h", V.compat_hash(F.col("neighbour")))
    sign = F.when(V.compat_hash(F.lit("#sign"), F.col("h")) % 2 == 0, 1.0).otherwise(-1.0)
    weighted = hashed.select(*counts.columns, (F.col("h") % dimension).cast("int").alias("slot"), (F.log1p("count") * sign).alias("weight"))
    feature = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("r", "neighbour", "count"))), lambda x: x["r"] <= features), lambda x: F.struct(x["neighbour"].alias("feature"), x["count"].alias("weight")))
    at = lambda i: F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("weight"))), F.lit(0.0))
    raw = F.array(*(at(i) for i in range(dimension)))
    grouped = weighted.groupBy("year", "word").agg(raw.alias("raw"), F.count("*").cast("int").alias("feature_count"), feature.alias("top_features"))
    length = V.norm(F.col("raw"))
    return grouped.withColumn("norm", length).select(
        "year", "word", F.transform("raw", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(0.0)).alias("vector"), "norm", "feature_count", "top_features"
    )


def nearest(vectors: DataFrame, word: str, k: int = C.NN_LIMIT, ident: str = "word", vector: str = "vector") -> DataFrame:
    """``ident``, score: the ``k`` most similar by cosine, without the word itself; ties by ``ident``. k under 1 counts as 10.

    The word's vector is a scalar subquery; an unknown word gives an empty result.
    """
    k = k if k > 0 else C.NN_LIMIT
    mine = vectors.where(F.col(ident) == word).agg(F.first(vector).alias("v"))
    return (
        vectors.where(F.col(ident) != word)
        .withColumn("_q", mine.scalar())
        .select(ident, F.round(V.cosine(F.col(vector), F.col("_q")), 6).alias("score"))
        .where("score IS NOT NULL")
        .orderBy(F.desc("score"), ident)
        .limit(k)
    )


def shared_vocabulary(vectors: DataFrame, base: int, target: int) -> DataFrame:
    """word, a, b, features_a, features_b: words with a vector in both years."""
    of = lambda y, v, f: vectors.where(F.col("year") == y).select("word", F.col("vector").alias(v), F.col("top_features").alias(f))
    return of(base, "a", "features_a").join(of(target, "b", "features_b"), "word")


def alignment(shared: DataFrame, dimension: int = C.DIMENSION) -> DataFrame:
    """One row: dimension, shared_vocab_size, disparity, signs.

    A dimension's sign is that of the sum of products over the shared words, 0 counting as +1; disparity is the mean squared
    distance after the signs are applied. Vectors of another dimension are left out. Without shared words the row has size
    0, no disparity and all signs +1.
    """
    fit = shared.where((F.size("a") == dimension) & (F.size("b") == dimension))
    sums = [F.sum(F.get("a", F.lit(i)) * F.get("b", F.lit(i))) for i in range(dimension)]
    signs = fit.agg(F.array(*(F.when(s < 0, -1).otherwise(1) for s in sums)).alias("signs"))
    d = V.euclidean(F.col("a"), V.apply_signs(F.col("b"), F.col("signs")))
    return (
        fit.withColumn("signs", signs.scalar())
        .agg(F.count("*").alias("shared_vocab_size"), F.avg(d * d).alias("disparity"))
        .select(F.lit(dimension).alias("dimension"), "shared_vocab_size", "disparity", signs.scalar().alias("signs"))
    )


def drift(shared: DataFrame, aligned: DataFrame) -> DataFrame:
    """word, cosine_shift (1 - cosine), euclidean_shift, rank_shift of each shared word, after the alignment's signs."""
    b = V.apply_signs(F.col("b"), F.col("signs"))
    names = lambda c: F.transform(c, lambda x: x["feature"])
    return shared.withColumn("signs", aligned.select("signs").scalar()).select(
        "word",
        (1 - V.cosine(F.col("a"), b)).alias("cosine_shift"),
        V.euclidean(F.col("a"), b).alias("euclidean_shift"),
        V.rank_shift(names("features_a"), names("features_b")).alias("rank_shift"),
    )


def align_all(vectors: DataFrame, dimension: int = C.DIMENSION) -> DataFrame:
    """base_year, target_year, shared_vocab_size, disparity, signs of every two consecutive years that have vectors, at once.

    All pairs of years are one aggregation; the signs of each pair, one row, are joined back for the disparity.
    """
    nexts = vectors.select("year").distinct().withColumn("next", F.lead("year").over(Window.orderBy("year"))).where("next IS NOT NULL")
    a = vectors.join(nexts, "year").select(F.col("year").alias("base_year"), F.col("next").alias("target_year"), "word", F.col("vector").alias("a"))
    b = vectors.select(F.col("year").alias("target_year"), "word", F.col("vector").alias("b"))
    both = a.join(b, ["target_year", "word"]).where((F.size("a") == dimension) & (F.size("b") == dimension))
    sums = [F.sum(F.get("a", F.lit(i)) * F.get("b", F.lit(i))) for i in range(dimension)]
    signs = both.groupBy("base_year", "target_year").agg(F.array(*(F.when(s < 0, -1).otherwise(1) for s in sums)).alias("signs"))
    d = V.euclidean(F.col("a"), V.apply_signs(F.col("b"), F.col("signs")))
    return (
        both.join(signs, ["base_year", "target_year"])
        .groupBy("base_year", "target_year")
        .agg(F.count("*").alias("shared_vocab_size"), F.avg(d * d).alias("disparity"), F.first("signs").alias("signs"))
    )


def unaligned_shift(shared: DataFrame, drifts: DataFrame, word: str) -> DataFrame:
    """word, cosine_shift, aligned of one word: from ``drifts``, or if it has no row, without alignment."""
    plain = shared.where(F.col("word") == word).select("word", (1 - V.cosine(F.col("a"), F.col("b"))).alias("plain"))
    return plain.join(drifts.where(F.col("word") == word).select("word", "cosine_shift"), "word", "full").select(
        "word", F.coalesce("cosine_shift", "plain").alias("cosine_shift"), F.col("cosine_shift").isNotNull().alias("aligned")
    )


def normalised_word(word: str) -> str:
    """A query's word as the index has it: accents split off, lower case, a-z and 0-9."""
    import re
    import unicodedata

    return re.sub("[^a-z0-9]", "", unicodedata.normalize("NFD", word).lower())


