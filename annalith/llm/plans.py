"""Named queries of this subpackage with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalith.llm import distinctive, lookalike, markup, packing, sentences, together, tokens, topn
from annalith.operators import skew
from annalith.session import checkpointed
from annalith.sources.tables import distinct_year_texts, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Words of an article's year that are characteristic of it: all scored words of 12 occurrences or more, held to the exact definition."""
    scores = distinctive.term_scores(distinct_year_texts(table(spark, folder, "year_history")), "year", "page_id", "text", min_count=12)
    return scores.where("k >= 2 AND f / d * ln(total / k) >= 0.5").select("page_id", "year", F.col("term").alias("word"))


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of every article and year with its score."""
    scores = distinctive.term_scores(distinct_year_texts(table(spark, folder, "year_history")), "year", "page_id", "text")
    return scores.select("page_id", "year", F.col("term").alias("word"), F.round("z", 4).alias("z"))


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most characteristic words of every article and year, best first."""
    scores = distinctive.term_scores(distinct_year_texts(table(spark, folder, "year_history")), "year", "page_id", "text")
    rounded = scores.withColumn("z", F.round("z", 4))
    order = Window.partitionBy("year", "page_id").orderBy(F.desc("z"), "term")
    return rounded.withColumn("place_no", F.row_number().over(order)).where("place_no <= 10").select(
        "page_id", "year", "place_no", F.col("term").alias("word"), "z"
    )


def _marked_rows(spark: SparkSession, folder: str) -> DataFrame:
    """src, page_id, row_ref, text of the revisions and of the year-end texts."""
    revisions = table(spark, folder, "revisions").where("rev_id IS NOT NULL").select(
        F.lit("revisions").alias("src"), "page_id", F.col("rev_id").alias("row_ref"), F.col("content").alias("text")
    )
    history = table(spark, folder, "year_history").select(
        F.lit("year_history").alias("src"), "page_id", F.col("year").cast("string").alias("row_ref"), "text"
    )
    return revisions.unionByName(history)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of which a stream of markup of any language is matched by an inferred wrapper."""
    return markup.marked_rows(_marked_rows(spark, folder), ["src", "page_id", "row_ref"], "text")


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with its clean text, the markup languages found and its blocks."""
    return markup.clean_texts(_marked_rows(spark, folder), "text").select("src", "page_id", "row_ref", "clean_text", "markup", "blocks")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of words that stand close together in more articles than chance gives: all scored pairs of 3 articles and 0.4 % of them
    or more, held to the exact definition."""
    pairs = together.close_pairs(table(spark, folder, "year_history"), "page_id", "text")
    return pairs.where("n_ab * baskets >= 8 * n_a * n_b").select("item_a", "item_b")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of words that stand close in any article, with what chance gives and the false-discovery control.

    The scored pairs are written once, as their ranks are taken before they are marked.
    """
    pairs = together.close_pairs(table(spark, folder, "year_history"), "page_id", "text", min_count=1, min_share=None)
    return together.discoveries(checkpointed(pairs)).drop("items")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of words that stand close in any article, with the number of articles of each word and of the pair."""
    pairs = together.close_pairs(table(spark, folder, "year_history"), "page_id", "text", min_count=1, min_share=None)
    return pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where each sentence of the requested revisions ends.

    The requested contents are written once, as they are counted, sampled and split.
    """
    asked = table(spark, folder, "split_requests").where("rev_id IS NOT NULL").select("rev_id").distinct()
    contents = table(spark, folder, "revisions").select("rev_id", "content").join(asked, "rev_id", "left_semi")
    return sentences.split_sentences(checkpointed(contents), "rev_id", "content")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three articles with the most added and removed occurrences, of every (year, word) with at least 5 records."""
    last = F.col("last")
    positive = lambda c: F.when(last[c] > 0, last[c]).alias(c)
    records = (
        skew.diff_records(table(spark, folder, "diff_emits"))
        .groupBy("year", "word", "article")
        .agg(skew.latest("added", "removed", by="emitted_at").alias("last"))
        .select("year", "word", "article", positive("added"), positive("removed"))
    )
    tops = topn.top_items(records, ["year", "word"], ["added", "removed"], "article", 3).where("records >= 5")
    return topn.placed(tops, ["year", "word"], ["added", "removed"]).select("year", "word", "side", "place_no", F.col("item").alias("article"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p9_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of each capacity, by its number of tokens."""
    sizes = tokens.count_tokens(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack_items(sizes, table(spark, folder, "pack_sizes"), "doc_id", "tokens", "pack_id", "capacity")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same and are not equal."""
    return lookalike.pairs(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class and whether it is written in the class's canonical form."""
    rows = lookalike.classes(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", "class_id", (F.col("text") == F.col("canonical")).alias("is_canonical"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The classes of several spellings, with the numbers of their spellings and documents."""
    return lookalike.class_sizes(table(spark, folder, "documents").select("doc_id", "text"), "text").select("class_id", "spellings", "documents")


QUERIES = {
    f.__name__: f for f in (p2_found, p2_scores, p2_terms, p3_found, p3_clean, p4_found, p4_counts, p4_pairs, p5_found, p6_found, p8_ids, p9_packs, p10_found, p10_forms, p10_classes)
}

_TERMS = """
t AS (SELECT page_id, year, max(text) AS text FROM year_history WHERE page_id IS NOT NULL AND year IS NOT NULL GROUP BY page_id, year),
w AS (SELECT page_id, year, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS word FROM t),
f AS (SELECT page_id, year, word, count(*) AS f FROM w GROUP BY ALL),
r AS (SELECT page_id, year, count(*) AS d, sum(f) AS n FROM f GROUP BY ALL),
g AS (SELECT year, count(*) AS total, sum(n) AS size FROM r GROUP BY year),
c AS (SELECT year, word, sum(f) AS c, count(*) AS k FROM f GROUP BY ALL)
"""

_PAIRS = """WITH t AS (SELECT DISTINCT page_id, text FROM year_history WHERE page_id IS NOT NULL AND text <> ''),
i AS (SELECT page_id, regexp_extract_all(lower(text), '[a-z0-9]{5,}') AS a FROM t),
e AS (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS pos FROM i),
b AS (SELECT DISTINCT page_id, a[pos] AS x FROM e),
n AS (SELECT x, count(*) AS n FROM b GROUP BY x),
p AS (SELECT DISTINCT page_id, least(a[pos], a[pos + gap]) AS x, greatest(a[pos], a[pos + gap]) AS y FROM e, (VALUES (1), (2), (3)) g(gap)
      WHERE pos + gap <= len(a) AND a[pos] <> a[pos + gap]),
c AS (SELECT x, y, count(*) AS n FROM p GROUP BY ALL), total AS (SELECT count(DISTINCT page_id) AS n FROM t)"""

SQL = {
    "p2_found": f"""WITH {_TERMS}
SELECT f.page_id, f.year, f.word FROM f JOIN r USING (page_id, year) JOIN g USING (year) JOIN c USING (year, word)
WHERE f >= 12 AND k >= 2 AND f / d * ln(total / k) >= 0.5""",
    "p2_terms": f"""WITH {_TERMS},
s AS (SELECT f.page_id, f.year, f.word, f::DOUBLE AS f, n::DOUBLE AS n, c::DOUBLE AS c, size::DOUBLE AS size, 500.0 * c / size AS a
      FROM f JOIN r USING (page_id, year) JOIN g USING (year) JOIN c USING (year, word)),
z AS (SELECT page_id, year, word, round((ln((f + a) / greatest(n + 500.0 - f - a, 1e-9)) - ln((c - f + a) / greatest(size - n + 500.0 - c + f - a, 1e-9)))
      / sqrt(1 / (f + a) + 1 / (c - f + a)), 4) AS z FROM s)
SELECT page_id, year, cast(row_number() OVER (PARTITION BY page_id, year ORDER BY z DESC, word) AS INT) AS place_no, word, z FROM z QUALIFY place_no <= 10""",
    "p4_found": f"""{_PAIRS}
SELECT c.x AS item_a, c.y AS item_b FROM c JOIN n a ON a.x = c.x JOIN n b ON b.x = c.y, total
WHERE c.n >= 3 AND c.n >= 0.004 * total.n AND c.n * total.n >= 8 * a.n * b.n""",
    "p4_counts": f"""{_PAIRS}
SELECT c.x AS item_a, c.y AS item_b, a.n AS n_a, b.n AS n_b, c.n AS n_ab FROM c JOIN n a ON a.x = c.x JOIN n b ON b.x = c.y""",
    "p6_found": """
WITH r0 AS (SELECT year, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS word, article, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, emitted_at
            FROM diff_emits WHERE article IS NOT NULL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY year, word, article ORDER BY emitted_at DESC NULLS LAST, added DESC, removed DESC) AS rn FROM r0 WHERE word <> ''),
r AS (SELECT *, count(*) OVER (PARTITION BY year, word) AS n FROM r1 WHERE rn = 1),
s AS (SELECT year, word, article, n, 'added' AS side, added AS score FROM r UNION ALL SELECT year, word, article, n, 'removed', removed FROM r)
SELECT year, word, side, cast(row_number() OVER (PARTITION BY year, word, side ORDER BY score DESC, article) AS INT) AS place_no, article
FROM s WHERE n >= 5 AND score > 0 QUALIFY place_no <= 3""",
}

#: All scores: the twin of the top ten without its places.
SQL["p2_scores"] = SQL["p2_terms"][: SQL["p2_terms"].rindex("SELECT page_id, year, cast(row_number()")] + "SELECT page_id, year, word, CASE WHEN z = 0 THEN 0.0::DOUBLE ELSE z END AS z FROM z"
