"""Page dumps in XML, lists of nodes, and saved crawl states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalith.functions.text import file_name, is_article, wiki_links
from annalith.session import replace_folder

#: The columns of a saved frontier.
FRONTIER = "key string, title string, depth int, status string, discovered_from string, enqueued_at timestamp, claimed_at timestamp, retries int"

_S = T.StringType()
PAGE = T.StructType(
    [
        T.StructField("title", _S),
        T.StructField("id", _S),
        T.StructField(
            "revision",
            T.ArrayType(T.StructType([T.StructField("id", _S), T.StructField("parentid", _S), T.StructField("timestamp", _S), T.StructField("text", _S)])),
        ),
    ]
)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """page_id, title, rev_id, parent_id, ts, content, pos of a dump (.xml, .gz or .bz2), one row for each revision.

    The schema is given, so nothing is inferred and ids stay strings; a page whose times can't be read has null ones.
    """
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    return pages.select(F.col("id").alias("page_id"), "title", F.posexplode("revision").alias("pos", "r")).select(
        "page_id",
        "title",
        F.col("r.id").alias("rev_id"),
        F.col("r.parentid").alias("parent_id"),
        F.try_to_timestamp("r.timestamp").alias("ts"),
        F.col("r.text").alias("content"),
        "pos",
    )


def read_articles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """page_id, title, latest content, links of a dump's pages that are articles by their latest revision.

    With ``limit`` the first so many by page number: a feature of partial scans.
    """
    latest = read_dump(spark, path).groupBy("page_id", "title").agg(F.max_by("content", "pos").alias("content"), F.count("*").alias("revision_count"))
    rows = latest.where(is_article(F.col("title"), F.col("content"))).withColumn("links", wiki_links(F.col("content")))
    return rows if limit is None else rows.orderBy(F.length("page_id"), "page_id").limit(limit)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """ip, port of a list of nodes; blank lines and those that begin with # are left out."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(
        F.split_part(line, F.lit(":"), F.lit(1)).alias("ip"), F.split_part(line, F.lit(":"), F.lit(2)).try_cast("int").alias("port")
    )


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """key, status of a saved crawl state: a JSON object with queue, visited and failed. An unreadable file gives no rows."""
    saved = spark.read.option("multiLine", True).schema("queue array<string>, visited array<string>, failed array<string>").json(path)
    lists = F.array(*(F.struct(F.lit(s).alias("status"), F.col(c).alias("keys")) for c, s in (("queue", "pending"), ("visited", "stored"), ("failed", "failed"))))
    return saved.select(F.inline(lists)).select(F.explode("keys").alias("key"), "status")


def write_state(frontier: DataFrame, path: str) -> None:
    """Save a frontier with all its columns as JSON lines. A failed write leaves the state saved before as it is."""
    replace_folder(frontier.sparkSession, path, lambda beside: frontier.write.json(beside))


def read_frontier(spark: SparkSession, path: str, schema: str = FRONTIER) -> DataFrame:
    """A frontier saved with ``write_state``; columns that it lacks are null."""
    return spark.read.schema(schema).json(path)


def write_articles(articles: DataFrame, path: str) -> None:
    """Write articles (page_id, title, ...) as JSON lines, with the title as a file name beside them in ``name``."""
    named = articles.withColumn("name", file_name(F.col("title")))
    replace_folder(articles.sparkSession, path, lambda beside: named.write.json(beside))
