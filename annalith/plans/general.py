"""Queries of the general problems over the tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalith.operators import skew, snapshots
from annalith.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The (year, word) keys that own at least a hundredth of all records."""
    return skew.heavy_keys(skew.article_counts(table(spark, folder, "diff_emits"))).select("year", "word")


def p1_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The whole index of the temporal diff."""
    return skew.diff_totals(table(spark, folder, "diff_emits"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """What was added, removed and changed, in year-end snapshots and along revisions."""
    parts = [
        snapshots.year_changes(table(spark, folder, "year_history")).withColumn("src", F.lit("year_history")),
        snapshots.revision_changes(table(spark, folder, "revisions")).withColumn("src", F.lit("revisions")),
    ]
    return parts[0].unionByName(parts[1]).select("src", "page_id", "row_ref", "change_kind")


QUERIES = {"p1_found": p1_found, "p1_totals": p1_totals, "p7_found": p7_found}

_RECORDS = """
r0 AS (SELECT year, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS word, article, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, emitted_at
       FROM diff_emits WHERE article IS NOT NULL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY year, word, article ORDER BY emitted_at DESC NULLS LAST, added DESC, removed DESC) AS rn FROM r0 WHERE word <> ''),
r AS (SELECT year, word, article, added, removed FROM r1 WHERE rn = 1)
"""

SQL = {
    "p1_found": f"""WITH {_RECORDS}
SELECT year, word FROM r GROUP BY year, word HAVING count(*) >= 0.01 * (SELECT count(*) FROM r)""",
    "p1_totals": f"""WITH {_RECORDS}
SELECT year, word, cast(sum(added) AS BIGINT) AS total_added, cast(sum(removed) AS BIGINT) AS total_removed, count(*) AS article_count,
       count(*) FILTER (added > 0) AS articles_added, count(*) FILTER (removed > 0) AS articles_removed
FROM r GROUP BY year, word""",
    "p7_found": r"""
WITH y AS (SELECT page_id, year, max(trim(replace(text, E'\r\n', E'\n'), E' \t\r\n')) AS t FROM year_history WHERE text IS NOT NULL GROUP BY ALL),
yc AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.year, b.year + 1) AS year, b.t AS was, a.t AS now
       FROM y a FULL JOIN y b ON a.page_id = b.page_id AND a.year = b.year + 1),
v AS (SELECT DISTINCT page_id, rev_id, ts, coalesce(trim(replace(content, E'\r\n', E'\n'), E' \t\r\n'), '') AS t
      FROM revisions WHERE rev_id IS NOT NULL AND ts IS NOT NULL),
vc AS (SELECT page_id, rev_id, coalesce(lag(t) OVER (PARTITION BY page_id ORDER BY ts, cast(rev_id AS HUGEINT)), '') AS was, t AS now FROM v)
SELECT 'year_history' AS src, page_id, cast(year AS VARCHAR) AS row_ref,
       CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM yc WHERE year BETWEEN 2009 AND 2019 AND was IS DISTINCT FROM now
UNION ALL
SELECT 'revisions', page_id, rev_id, CASE WHEN was = '' THEN 'added' WHEN now = '' THEN 'removed' ELSE 'changed' END FROM vc WHERE was <> now""",
}
