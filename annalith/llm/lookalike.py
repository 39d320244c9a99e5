"""One form for texts that look the same and differ in their characters.

Each text is mapped character by character to what it looks like; texts whose mapped values are equal under accent-sensitive
Unicode collation form a class, one member of which is the canonical one. The mapping takes care of what the collation keeps
apart (width, compatibility forms, look-alike letters, kinds of space), the collation of equivalent sequences of accents.
Each text is first reduced to a hash of its mapped value under the collation, so that only texts which share that hash with
another text are grouped, and travel, as texts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalith.session import checkpointed

# Letters that have the shape of a Latin letter, and that letter.
CYRILLIC = ("АВСЕНІЈКМОРЅТХҮӀѴԌԚԜасеһіјорѕхуӏѵԁԛԝ", "ABCEHIJKMOPSTXYIVGQWacehijopsxylvdqw")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαινορυϲϳ", "ABEZHIKMNOPTYXCJaivopucj")
# Marks that look like a hyphen, beside the ASCII one.
HYPHENS = "\u2010\u2011\u2043\u2212\ufe63\uff0d"
#: Blocks of a class whose documents are paired block by block.
BLOCKS = 8
#: Compatibility forms that can be told from their plain letters at sight.
VISIBLE = {"<super>", "<sub>", "<circle>", "<fraction>", "<square>"}
#: Joiners; between pictographs they are seen, and have a sign of their own, as the collation passes over them.
JOINERS, JOINED = "\u200c\u200d", "\ue000"


@lru_cache(maxsize=1)
def shapes() -> dict[int, str]:
    """What each character looks like, where that isn't the character itself; from the Unicode data by rule.

    Format characters, variation selectors and fillers are invisible (mapped to nothing); space separators are a space;
    width and compatibility forms are their decomposition, but for the kinds in VISIBLE.
    """
    table: dict[int, str] = {}
    for i in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000:
            continue
        ch = chr(i)
        kind = unicodedata.category(ch)
        if ch in JOINERS:
            continue
        if kind == "Cf" or 0xFE00 <= i < 0xFE10 or 0xE0100 <= i < 0xE01F0 or i in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= i < 0x1810:
            table[i] = ""
        elif kind == "Zs":
            table[i] = " "
        elif ch in HYPHENS:
            table[i] = "-"
        elif (parts := unicodedata.decomposition(ch)).startswith("<") and parts.split(" ")[0] not in VISIBLE:
            table[i] = unicodedata.normalize("NFKC", ch)
    for alike, latin in (CYRILLIC, GREEK):
        table |= {ord(a): b for a, b in zip(alike, latin, strict=True)}
    return table


NOT_ASCII = re.compile("[^\x00-\x7f]+")


def same_shape(text: str) -> str:
    """``text`` in the shapes a reader sees, composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", NOT_ASCII.sub(_run_shape, text))


def _run_shape(found: re.Match) -> str:
    return run_shape(found.group())


@lru_cache(maxsize=100_000)
def run_shape(run: str) -> str:
    # accents are split off first, so that a letter with its accent is mapped as its bare letter is; twice, as a
    # compatibility form can stand for a look-alike letter
    s = unicodedata.normalize("NFD", run).translate(shapes())
    if "\u200c" in s or "\u200d" in s:
        seen = lambda i: pictograph(s[i - 1 : i]) and pictograph(s[i + 1 : i + 2])
        s = "".join(c if c not in JOINERS else JOINED if seen(i) else "" for i, c in enumerate(s))
    return unicodedata.normalize("NFD", s).translate(shapes())


def pictograph(ch: str) -> bool:
    return bool(ch) and unicodedata.category(ch) in ("So", "Sk")


@F.pandas_udf(T.StringType())
def shape_of(texts: pd.Series) -> pd.Series:
    return texts.map(same_shape, na_action="ignore")


def classes(df: DataFrame, text: str) -> DataFrame:
    """``df``'s rows with ``class_id`` (the md5 of the canonical member's text) and ``canonical`` (that text).

    The canonical member is the class's smallest text in byte order, so it is the same however rows are spread. A null text
    has a null class. Blank texts are classed like others. Columns of ``df`` named like the new ones are replaced; repeated
    rows stay.
    """
    spellings = checkpointed(hashed(df, text).distinct()).select("variant", "look")
    of_text = grouped(spellings, df, text).select(F.col("variant").alias("_of_text"), "class_id", F.col("canonical").alias("_canonical"))
    kept = df.drop("class_id", "canonical", "_of_text", "_canonical")
    joined = kept.join(of_text.hint("merge"), F.md5(F.col(text)) == F.col("_of_text"), "left")
    return joined.select(*kept.columns, F.coalesce("class_id", F.md5(F.col(text))).alias("class_id"), F.coalesce("_canonical", F.col(text)).alias("canonical"))


def hashed(df: DataFrame, text: str, *more: str) -> DataFrame:
    """``more``, variant (the text's md5) and look (a hash of its shape under the collation), where the text isn't null.

    Equal shapes have equal looks; the few unequal ones that share a look are told apart by the collation itself.
    """
    shape = F.when(F.col("text").rlike("[^\\x00-\\x7f]"), shape_of("text")).otherwise(F.col("text"))
    rows = df.where(F.col(text).isNotNull()).select(*more, F.col(text).alias("text"))
    return rows.select(*more, F.md5("text").alias("variant"), F.xxhash64(F.collate(shape, "UNICODE")).alias("look"))


def grouped(spellings: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """One row for each distinct text that looks like another: variant, class_id, canonical, spellings.

    ``spellings`` has the distinct (variant, look) of the texts of ``df``. Copies of a text are merged before anything is grouped.
    """
    several = spellings.groupBy("look").agg(F.count("*").alias("n")).where("n > 1")
    asked = spellings.join(several, "look", "left_semi").select("variant")
    shaped = checkpointed(
        df.where(F.col(text).isNotNull())
        .select(F.md5(text).alias("variant"), F.col(text).alias("text"))
        .hint("merge")
        .join(asked, "variant", "left_semi")
        .groupBy("variant")
        .agg(F.first("text").alias("text"))
        .select("variant", "text", shape_of("text").alias("shape"))
    )
    return df.sparkSession.sql(
        """
        WITH canon AS (
          SELECT collate(shape, 'UNICODE') AS shape, min(text) AS canonical, count(*) AS spellings
          FROM {shaped} GROUP BY collate(shape, 'UNICODE') HAVING count(*) > 1)
        SELECT s.variant, md5(c.canonical) AS class_id, c.canonical, c.spellings
        FROM {shaped} s JOIN canon c ON collate(s.shape, 'UNICODE') = c.shape
        """,
        shaped=shaped,
    )


def class_sizes(df: DataFrame, text: str) -> DataFrame:
    """One row for each class of several spellings: class_id, canonical, spellings (distinct texts), documents (rows of ``df``)."""
    looks = checkpointed(hashed(df, text).groupBy("variant", "look").agg(F.count("*").alias("n")))
    members = grouped(looks.select("variant", "look"), df, text).hint("merge").join(looks.select("variant", "n"), "variant")
    return members.groupBy("class_id").agg(F.first("canonical").alias("canonical"), F.count("*").alias("spellings"), F.sum("n").alias("documents"))


def pairs(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents whose texts look the same without being equal; blank texts are left out.

    Only classes of several spellings are expanded, spelling by spelling: copies of one text make no pair, however many. A
    class is expanded in blocks of its members, by hash of the identifier, so a large one is work for several tasks.
    """
    rows = df.where(F.col(text).isNotNull() & (F.btrim(F.regexp_replace(text, r"(?U)[\s\p{Cf}]+", " ")) != "")).select(F.col(ident).alias("id"), F.col(text).alias("text"))
    looks = checkpointed(hashed(rows, "text", "id"))
    members = grouped(looks.select("variant", "look").distinct(), rows, "text").select("variant", "class_id")
    held = looks.select("id", "variant").distinct().hint("merge").join(members, "variant").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)))
    # block i meets block j in the cell (i, j), i <= j
    other = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("other")
    cell = held.select("id", "variant", "class_id", "block", other).select(
        "id", "variant", "class_id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    a, b = cell.alias("a"), cell.alias("b")
    same = F.col("a.class_id") == F.col("b.class_id")
    met = (F.col("a.block") == F.col("a.i")) & (F.col("b.block") == F.col("b.j"))
    return (
        a.hint("merge")
        .join(b, same & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & met & (F.col("a.variant") != F.col("b.variant")) & ((F.col("a.i") < F.col("a.j")) | (F.col("a.id") < F.col("b.id"))))
        .select(F.least("a.id", "b.id").alias("doc_a"), F.greatest("a.id", "b.id").alias("doc_b"))
    )
