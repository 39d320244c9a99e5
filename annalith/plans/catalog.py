"""Named queries of the analyses over the tables of a dataset folder, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalith import constants as C
from annalith.functions import text as X
from annalith.functions import udfs as U
from annalith.functions import vectors as V
from annalith.operators import definitions as D
from annalith.operators import frontier as FR
from annalith.operators import inverted as I
from annalith.operators import mapreduce as MR
from annalith.operators import placement as PL
from annalith.operators import revisions as R
from annalith.operators import search as S
from annalith.operators import semantics as M
from annalith.operators import store as K
from annalith.operators import temporal as T
from annalith.session import checkpointed
from annalith.sources.tables import distinct_year_texts, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
BASE, TARGET = 2012, 2013
WORD = "harbour"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def texts(spark: SparkSession, d: str) -> DataFrame:
    return distinct_year_texts(table(spark, d, "year_history"), "title")


def history(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return R.distinct_revisions(table(spark, d, "revisions"), *more)


def changes(spark: SparkSession, d: str) -> DataFrame:
    return T.temporal_diff(texts(spark, d))


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---- SQL pieces that the twins share

Y = "y AS (SELECT page_id, year, max(text) AS text, max(title) AS title FROM year_history WHERE page_id IS NOT NULL AND year IS NOT NULL GROUP BY ALL)"
R_ = """v AS (SELECT page_id, rev_id, max(ts) AS ts, min(pos) AS pos, max(content) AS content, max(title) AS title FROM revisions
      WHERE page_id IS NOT NULL AND rev_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)"""
NO_STOP, NO_STOP_SEARCH = (f"NOT IN ({quoted(s)})" for s in (C.STOP_BASE, C.STOP_SEARCH))


def at_utc(c: str) -> str:
    return f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"


TF = f"""{Y},
w AS (SELECT page_id, coalesce(title, page_id) AS title, year, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS word FROM y),
f AS (SELECT page_id, title, year, word, count(*) AS n FROM w WHERE word {NO_STOP_SEARCH} GROUP BY ALL)"""

IDX = f"""{TF},
t AS (SELECT page_id, title, year, count(*) AS terms FROM f GROUP BY ALL),
k AS (SELECT year, word, count(*) AS records FROM f GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT year, word, records, title, round(max(n / terms * ln({float(C.CORPUS_SIZE)} / records)), 6) AS tfidf
      FROM f JOIN t USING (page_id, title, year) JOIN k USING (year, word) GROUP BY ALL),
postings AS (SELECT *, cast(row_number() OVER g AS INT) AS place_no, count(*) OVER (PARTITION BY year, word) AS doc_count FROM p
             WINDOW g AS (PARTITION BY year, word ORDER BY tfidf DESC, title) QUALIFY place_no <= {C.POSTINGS_CAP})"""

DIFF = f"""{Y},
ch AS (SELECT page_id, coalesce(title, page_id) AS article, year, text, lag(year) OVER p AS py, lag(text) OVER p AS pt FROM y WINDOW p AS (PARTITION BY page_id ORDER BY year)),
pr AS (SELECT page_id, article, year, py FROM ch WHERE coalesce(text, '') <> '' AND coalesce(pt, '') <> ''),
w AS (SELECT page_id, year, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS word FROM y),
f AS (SELECT page_id, year, word, count(*) AS n FROM w WHERE word {NO_STOP} GROUP BY ALL),
u AS (SELECT pr.page_id, article, pr.year, word, n FROM pr JOIN f ON f.page_id = pr.page_id AND f.year = pr.year
      UNION ALL SELECT pr.page_id, article, pr.year, word, -n FROM pr JOIN f ON f.page_id = pr.page_id AND f.year = pr.py),
d AS (SELECT page_id, article, year, word, cast(greatest(sum(n), 0) AS BIGINT) AS added, cast(greatest(-sum(n), 0) AS BIGINT) AS removed
      FROM u GROUP BY page_id, article, year, word HAVING sum(n) <> 0),
totals AS (SELECT year, word, cast(sum(added) AS BIGINT) AS total_added, cast(sum(removed) AS BIGINT) AS total_removed, count(*) AS article_count,
           count(*) FILTER (added > 0) AS articles_added, count(*) FILTER (removed > 0) AS articles_removed FROM d GROUP BY ALL)"""

COOC = f"""{Y},
i AS (SELECT page_id, year, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{5,}}'), lambda x: x {NO_STOP})[1:{C.MAX_TOKENS}] AS a FROM y),
e AS (SELECT page_id, year, a, unnest(range(1, len(a) + 1)) AS pos FROM i),
n AS (SELECT page_id, year, a[pos] AS word, a[pos + gap] AS neighbour FROM e, (VALUES (1), (2), (3)) g(gap) WHERE pos + gap <= len(a) AND a[pos] <> a[pos + gap]),
c1 AS (SELECT page_id, year, word, neighbour, count(*) AS count FROM n GROUP BY ALL),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY page_id, year, word ORDER BY count DESC, neighbour) <= {C.MAX_NEIGHBOURS}),
c3 AS (SELECT year, word, neighbour, cast(sum(count) AS BIGINT) AS count FROM c2 GROUP BY ALL),
cooc AS (SELECT year, word, cast(row_number() OVER (PARTITION BY year, word ORDER BY count DESC, neighbour) AS INT) AS place_no, neighbour, count
         FROM c3 QUALIFY place_no <= {C.NEIGHBOURS})"""


def hash_sql(c: str) -> str:
    """The compatible hash of a column in SQL."""
    return f"""list_reduce(list_transform(range(1, length({c}) + 1), lambda i: ord(({c})[i])::BIGINT),
  lambda h, c: (((CASE WHEN xor(h, c) >= 2147483648 THEN xor(h, c) - 4294967296 ELSE xor(h, c) END)::DOUBLE * {V.FACTOR}.0::DOUBLE)::BIGINT % 4294967296 + 4294967296) % 4294967296,
  {V.START}::BIGINT)"""


EMB = f"""{COOC},
h AS (SELECT w, {hash_sql('w')} % {C.DIMENSION} AS slot, CASE WHEN {hash_sql("(w || '#sign')")} % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign
      FROM (SELECT DISTINCT neighbour AS w FROM cooc)),
s AS (SELECT year, word, slot, sum(sign * ln(1 + count)) AS v FROM cooc JOIN h ON h.w = neighbour GROUP BY ALL),
m AS (SELECT year, word, sqrt(sum(v * v)) AS norm FROM s GROUP BY ALL),
z AS (SELECT year, word, slot, CASE WHEN norm > 1e-12 THEN v / norm ELSE 0 END AS v, norm FROM s JOIN m USING (year, word)),
ab AS (SELECT word, slot, coalesce(a.v, 0) AS a, coalesce(b.v, 0) AS b FROM (SELECT * FROM z WHERE year = {BASE}) a
       FULL JOIN (SELECT * FROM z WHERE year = {TARGET}) b USING (word, slot)
       WHERE word IN (SELECT word FROM z WHERE year = {BASE}) AND word IN (SELECT word FROM z WHERE year = {TARGET})),
sg AS (SELECT dim AS slot, CASE WHEN coalesce(sum(round(a * b, 12)), 0) < 0 THEN -1 ELSE 1 END AS sign FROM range({C.DIMENSION}) r(dim) LEFT JOIN ab ON ab.slot = dim GROUP BY dim)"""


# ---- search

@query(f"WITH {TF} SELECT page_id, title, year, word, n FROM f")
def term_frequency(spark, d):
    return S.term_frequency(texts(spark, d))


@query(f"WITH {IDX} SELECT year, word, place_no, title, tfidf, round(ln({float(C.CORPUS_SIZE)} / records), 6) AS idf, doc_count FROM postings")
def tfidf(spark, d):
    return S.tfidf(texts(spark, d))


@query(f"""WITH {IDX} SELECT title, round(sum(tfidf), 6) AS score FROM postings WHERE year = 2012 AND word IN ('harbour', 'railway', 'meadow')
GROUP BY title ORDER BY score DESC, title LIMIT {C.SEARCH_LIMIT}""")
def search(spark, d):
    return S.search(S.tfidf(texts(spark, d)), 2012, ["Harbour", "railway", "meadow", "harbour"])


# ---- words by year

@query(f"WITH {DIFF} SELECT page_id, article, year, word, added, removed FROM d")
def temporal_diff(spark, d):
    return changes(spark, d)


@query(f"WITH {DIFF} SELECT * FROM totals")
def diff_totals(spark, d):
    return T.diff_totals(changes(spark, d))


@query(f"""WITH {DIFF},
s AS (SELECT year, word, 'added' AS side, page_id, article, added, removed, added AS amount FROM d UNION ALL SELECT year, word, 'removed', page_id, article, added, removed, removed FROM d)
SELECT year, word, side, cast(row_number() OVER (PARTITION BY year, word, side ORDER BY amount DESC, article, page_id) AS INT) AS place_no, article, added, removed
FROM s WHERE amount > 0 QUALIFY place_no <= {C.TOP_WORDS}""")
def diff_tops(spark, d):
    return T.diff_tops(changes(spark, d))


@query(f"""WITH {DIFF},
s AS (SELECT year, word, 'added' AS side, page_id, article, added, removed, added AS amount FROM d UNION ALL SELECT year, word, 'removed', page_id, article, added, removed, removed FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY year, word, side ORDER BY amount DESC, article, page_id) AS r FROM s WHERE amount > 0 QUALIFY r <= {C.TOP_WORDS})
SELECT totals.*, coalesce(string_agg(article || '=' || added || '-' || removed, '; ' ORDER BY r) FILTER (side = 'added'), '') AS top_added,
       coalesce(string_agg(article || '=' || added || '-' || removed, '; ' ORDER BY r) FILTER (side = 'removed'), '') AS top_removed
FROM totals JOIN o USING (year, word) GROUP BY ALL""")
def diff_index(spark, d):
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%s=%d-%d", x["article"], x["added"], x["removed"])), "; ").alias(c)
    rows = T.diff_index(changes(spark, d))
    return rows.select(*(c for c in rows.columns if not c.startswith("top_")), shown("top_added"), shown("top_removed"))


@query()
def diff_by_position(spark, d):
    return T.diff_totals(T.positional_diff(texts(spark, d)))


for _name, _side in (("birth", "added"), ("death", "removed")):
    SQL[_name] = f"""WITH {DIFF}
SELECT year, word, total_{_side} AS total, articles_{_side} AS articles, cast(row_number() OVER (PARTITION BY year ORDER BY total_{_side} DESC, word) AS INT) AS place_no
FROM totals WHERE total_{_side} > 0 QUALIFY place_no <= {C.TOP_WORDS}"""


@query(SQL["birth"])
def birth(spark, d):
    return T.births(T.diff_totals(changes(spark, d)))


@query(SQL["death"])
def death(spark, d):
    return T.deaths(T.diff_totals(changes(spark, d)))


@query(f"WITH {DIFF} SELECT * FROM totals WHERE word = '{WORD}' AND year = 2012")
def diff_point(spark, d):
    return T.diff_range(T.diff_totals(changes(spark, d)), "Harbour", 2012, 2012)


@query(f"WITH {DIFF} SELECT * FROM totals WHERE word = '{WORD}' AND year BETWEEN 2010 AND 2016")
def diff_range(spark, d):
    return T.diff_range(T.diff_totals(changes(spark, d)), WORD, 2010, 2016)


# ---- meaning

@query(f"WITH {COOC} SELECT * FROM cooc")
def cooccurrence(spark, d):
    return M.cooccurrence(texts(spark, d))


def _embeddings(spark, d, *years: int) -> DataFrame:
    """The embeddings of some years, or of all, as a written table, since what follows reads them more than once.

    The years are chosen before the texts are read.
    """
    rows = texts(spark, d)
    return checkpointed(M.embeddings(M.cooccurrence(rows.where(F.col("year").isin(*years)) if years else rows)))


def _shared(spark, d) -> DataFrame:
    return M.shared_vocabulary(_embeddings(spark, d, BASE, TARGET), BASE, TARGET)


@query(f"WITH {EMB} SELECT year, word, slot::INT AS slot, round(v, 6) + 0.0 AS v, round(norm, 6) AS norm FROM z WHERE abs(v) > 1e-9")
def embeddings(spark, d):
    rows = _embeddings(spark, d).select("year", "word", "norm", F.posexplode("vector").alias("slot", "v"))
    return rows.where(F.abs("v") > 1e-9).select("year", "word", "slot", (F.round("v", 6) + 0.0).alias("v"), F.round("norm", 6).alias("norm"))


@query(f"""WITH {COOC} SELECT year, word, cast(count(*) AS INT) AS feature_count, string_agg(neighbour || '=' || count, '; ' ORDER BY place_no) AS features
FROM cooc WHERE year = 2012 AND word = '{WORD}' GROUP BY ALL""")
def embedding_point(spark, d):
    f = F.array_join(F.transform("top_features", lambda x: F.concat_ws("=", x["feature"], x["weight"].cast("string"))), "; ")
    return _embeddings(spark, d, 2012).where(F.col("word") == WORD).select("year", "word", "feature_count", f.alias("features"))


@query(f"""WITH {EMB}, q AS (SELECT slot, v FROM z WHERE year = 2012 AND word = '{WORD}')
SELECT word, round(coalesce(sum(z.v * q.v), 0), 6) + 0.0 AS score FROM z LEFT JOIN q USING (slot) JOIN (SELECT year, word FROM m WHERE norm > 1e-12) USING (year, word)
WHERE year = 2012 AND word <> '{WORD}' GROUP BY word ORDER BY score DESC, word LIMIT {C.NN_LIMIT}""")
def nearest_neighbors(spark, d):
    return M.nearest(_embeddings(spark, d, 2012), M.normalised_word("Hárbour")).select("word", (F.col("score") + 0.0).alias("score"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10""")
def nearest_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return M.nearest(rows, 0, 10, "vec_id")


@query(f"WITH {COOC} SELECT DISTINCT a.word FROM cooc a JOIN cooc b USING (word) WHERE a.year = {BASE} AND b.year = {TARGET}")
def shared_vocab(spark, d):
    return _shared(spark, d).select("word")


@query(f"""WITH {EMB}
SELECT {C.DIMENSION} AS dimension, (SELECT count(DISTINCT word) FROM ab) AS shared_vocab_size,
       round((SELECT sum((a - b * sign) * (a - b * sign)) FROM ab JOIN sg USING (slot)) / (SELECT count(DISTINCT word) FROM ab), 6) AS disparity,
       (SELECT string_agg(sign, ' ' ORDER BY slot) FROM sg) AS signs""")
def alignment(spark, d):
    return M.alignment(_shared(spark, d)).select(
        "dimension", "shared_vocab_size", F.round("disparity", 6).alias("disparity"), F.array_join(F.transform("signs", lambda s: s.cast("string")), " ").alias("signs")
    )


@query(f"WITH {EMB} SELECT slot::INT AS row_no, c::INT AS column_no, CASE WHEN c = slot THEN sign ELSE 0 END AS value FROM sg, range({C.DIMENSION}) r(c)")
def alignment_matrix(spark, d):
    rows = M.alignment(_shared(spark, d))
    return rows.select(F.posexplode(V.diagonal(F.col("signs"))).alias("row_no", "r")).select("row_no", F.posexplode("r").alias("column_no", "value"))


@query(f"""WITH {EMB},
nx AS (SELECT year AS b, lead(year) OVER (ORDER BY year) AS t FROM (SELECT DISTINCT year FROM m)),
sw AS (SELECT b, t, x.word FROM nx JOIN m x ON x.year = b JOIN m w ON w.year = t AND w.word = x.word),
sv AS (SELECT b, t, word, slot, sum(CASE WHEN year = b THEN v ELSE 0 END) AS av, sum(CASE WHEN year = t THEN v ELSE 0 END) AS bv FROM sw JOIN z USING (word) WHERE z.year IN (b, t) GROUP BY ALL),
ss AS (SELECT b, t, dim AS slot, CASE WHEN coalesce(sum(round(av * bv, 12)), 0) < 0 THEN -1 ELSE 1 END AS sign
       FROM (SELECT DISTINCT b, t, dim FROM sw, range({C.DIMENSION}) r(dim)) g LEFT JOIN sv ON sv.b = g.b AND sv.t = g.t AND sv.slot = dim GROUP BY ALL),
sd AS (SELECT b, t, count(DISTINCT word) AS n, sum((av - bv * sign) * (av - bv * sign)) AS q FROM sv JOIN ss USING (b, t, slot) GROUP BY ALL)
SELECT b AS base_year, t AS target_year, n AS shared_vocab_size, round(q / n, 6) AS disparity, (SELECT string_agg(sign, ' ' ORDER BY slot) FROM ss WHERE ss.b = sd.b AND ss.t = sd.t) AS signs FROM sd""".replace("SELECT b, t, dim AS slot", "SELECT g.b, g.t, dim AS slot"))
def align_all_pairs(spark, d):
    signs = F.array_join(F.transform("signs", lambda s: s.cast("string")), " ")
    return M.align_all(_embeddings(spark, d)).withColumns({"disparity": F.round("disparity", 6), "signs": signs})


@query(f"""WITH {EMB},
dr AS (SELECT word, 1 - sum(a * b * sign) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0) AS cosine_shift, sqrt(sum((a - b * sign) * (a - b * sign))) AS euclidean_shift
       FROM ab JOIN sg USING (slot) GROUP BY word),
rk AS (SELECT word, avg(abs(a.place_no - b.place_no)) AS rank_shift FROM cooc a JOIN cooc b USING (word, neighbour) WHERE a.year = {BASE} AND b.year = {TARGET} GROUP BY word)
SELECT word, round(cosine_shift, 6) + 0.0 AS cosine_shift, round(euclidean_shift, 5) + 0.0 AS euclidean_shift, round(rank_shift, 6) AS rank_shift FROM dr LEFT JOIN rk USING (word)""")
def drift(spark, d):
    shared = _shared(spark, d)
    return M.drift(shared, M.alignment(shared)).select(
        "word", (F.round("cosine_shift", 6) + 0.0).alias("cosine_shift"), (F.round("euclidean_shift", 5) + 0.0).alias("euclidean_shift"), F.round("rank_shift", 6).alias("rank_shift")
    )


@query(f"""WITH {COOC}
SELECT word, round(avg(abs(a.place_no - b.place_no)), 6) AS rank_shift FROM cooc a JOIN cooc b USING (word, neighbour) WHERE a.year = {BASE} AND b.year = {TARGET} GROUP BY word""")
def rank_shift(spark, d):
    shared = _shared(spark, d)
    names = lambda c: F.transform(c, lambda x: x["feature"])
    return shared.select("word", F.round(V.rank_shift(names("features_a"), names("features_b")), 6).alias("rank_shift")).where("rank_shift IS NOT NULL")


@query(f"""WITH {EMB} SELECT word, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) + 0.0 AS cosine_shift, false AS aligned FROM ab WHERE word = '{WORD}' GROUP BY word""")
def drift_fallback(spark, d):
    shared = _shared(spark, d)
    none = spark.createDataFrame([], "word string, cosine_shift double")
    return M.unaligned_shift(shared, none, WORD).withColumn("cosine_shift", F.round("cosine_shift", 6) + 0.0)


@query(f"""WITH {COOC}, w AS (SELECT DISTINCT neighbour AS word FROM cooc) SELECT word, {hash_sql('word')} AS hash FROM w""")
def compat_hash(spark, d):
    return M.cooccurrence(texts(spark, d)).select(F.col("neighbour").alias("word")).distinct().select("word", V.compat_hash(F.col("word")).alias("hash"))


# ---- histories of pages

SEG = f"""{R_}, nr AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts, pos, rev_id) AS number, count(*) OVER (PARTITION BY page_id) AS total FROM v)"""


@query(f"""WITH {SEG} SELECT page_id, cast((number - 1) // {C.SEGMENT_SIZE} AS INT) AS segment_id, arg_min(rev_id, number) AS start_rev_id, arg_max(rev_id, number) AS end_rev_id,
{at_utc('min(ts)')} AS start_ts, {at_utc('max(ts)')} AS end_ts, count(*) AS revision_count FROM nr GROUP BY ALL""")
def segments(spark, d):
    return R.segments(history(spark, d)).withColumns({c: stamp(c) for c in ("start_ts", "end_ts")})


@query(f"""WITH {SEG}, o AS (SELECT page_id, (number - 1) // 50 AS s, number, rev_id, ts FROM nr UNION ALL SELECT page_id, (number - 1) // 50 + 1, number, rev_id, ts FROM nr WHERE number % 50 = 0 AND number < total)
SELECT page_id, cast(s AS INT) AS segment_id, arg_min(rev_id, number) AS start_rev_id, arg_max(rev_id, number) AS end_rev_id, {at_utc('min(ts)')} AS start_ts, {at_utc('max(ts)')} AS end_ts, count(*) AS revision_count
FROM o GROUP BY ALL""")
def segments_overlap(spark, d):
    return R.segments(history(spark, d), overlap=True).withColumns({c: stamp(c) for c in ("start_ts", "end_ts")})


@query(f"""WITH {R_} SELECT page_id, arg_max(rev_id, (ts, pos, rev_id)) AS latest_rev_id, {at_utc('min(ts)')} AS first_ts, {at_utc('max(ts)')} AS latest_ts, count(*) AS revision_count,
cast(ceil(count(*) / 50.0) AS INT) AS segment_count, 50 AS segment_size FROM v GROUP BY page_id""")
def article_meta(spark, d):
    return R.article_meta(history(spark, d)).withColumns({c: stamp(c) for c in ("first_ts", "latest_ts")})


@query(f"""WITH {SEG}, s AS (SELECT page_id, (number - 1) // 50 AS s, arg_min(rev_id, number) AS a FROM nr GROUP BY ALL),
t AS (SELECT page_id, max(title) AS title FROM articles WHERE title IS NOT NULL GROUP BY page_id)
SELECT page_id, title, count(*) AS segments, string_agg(a, ' ' ORDER BY s) AS starts FROM s JOIN t USING (page_id) GROUP BY ALL""")
def meta_manifest(spark, d):
    titles = table(spark, d, "articles").where("title IS NOT NULL").groupBy("page_id").agg(F.max("title").alias("title"))
    rows = R.manifest(R.segments(history(spark, d))).join(titles, "page_id")
    return rows.select("page_id", "title", F.size("segments").cast("long").alias("segments"), F.array_join(F.transform("segments", lambda s: s["start_rev_id"]), " ").alias("starts"))


@query(f"WITH {SEG} SELECT page_id, rev_id, number FROM nr")
def sort_revisions(spark, d):
    return R.first_revisions(history(spark, d), 1 << 30).select("page_id", "rev_id", "number")


@query(f"WITH {SEG} SELECT page_id, rev_id, number, total > 100 AS truncated FROM nr WHERE number <= 100")
def revision_fetch(spark, d):
    return R.first_revisions(history(spark, d), 100).select("page_id", "rev_id", "number", "truncated")


@query(f"WITH {R_} SELECT page_id, rev_id, pos FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos DESC, rev_id DESC) <= 50")
def last_n_revisions(spark, d):
    return R.last_revisions(history(spark, d)).select("page_id", "rev_id", "pos")


_TIMES = ["2012-12-31 23:59:59", "2015-06-01 00:00:00", "2019-12-31 23:59:59"]


@query(f"""WITH {R_}, t AS (SELECT unnest([{quoted(_TIMES)}]) AS t)
SELECT page_id, t AS as_of, arg_max(rev_id, (ts, pos, rev_id)) AS rev_id, md5(coalesce(arg_max(coalesce(content, ''), (ts, pos, rev_id)), '')) AS digest
FROM v, t WHERE ts <= (t || '+00')::TIMESTAMPTZ GROUP BY ALL""")
def asof_snapshot(spark, d):
    return R.as_of(history(spark, d, "content"), _TIMES).select("page_id", stamp("as_of").alias("as_of"), "rev_id", F.md5(F.coalesce("content", F.lit(""))).alias("digest"))


@query(f"""WITH {R_}, t AS (SELECT unnest(range(2008, 2020)) AS t)
SELECT page_id, t::INT AS year, arg_max(rev_id, (ts, pos, rev_id)) AS rev_id FROM v, t WHERE ts <= (t || '-12-31 23:59:59+00')::TIMESTAMPTZ GROUP BY ALL""")
def year_end_snapshots(spark, d):
    return R.year_end_ids(history(spark, d), 2008, 2019)


@query(f"""WITH {R_}, w AS (SELECT DISTINCT page_id, rev_id AS wanted FROM split_requests WHERE page_id IS NOT NULL),
l AS (SELECT page_id, arg_max(rev_id, (ts, pos, rev_id)) AS latest FROM v GROUP BY page_id),
c AS (SELECT w.page_id, w.wanted, coalesce(v.rev_id, l.latest) AS rev_id FROM w JOIN l USING (page_id) LEFT JOIN v ON v.page_id = w.page_id AND v.rev_id = w.wanted)
SELECT c.page_id, c.wanted, c.rev_id, md5(coalesce(content, '')) AS digest FROM c JOIN v USING (page_id, rev_id)""")
def reconstruct_revision(spark, d):
    wanted = table(spark, d, "split_requests").select("page_id", "rev_id")
    rows = R.at_revision(history(spark, d, "content"), wanted)
    return rows.select("page_id", "wanted", "rev_id", F.md5(F.coalesce("content", F.lit(""))).alias("digest"))


@query(f"""WITH {R_}, l AS (SELECT page_id, rev_id, coalesce(content, '') AS c, coalesce(lag(coalesce(content, '')) OVER (PARTITION BY page_id ORDER BY ts, pos, rev_id), '') AS p FROM v)
SELECT page_id, rev_id, cast(length(c) - length(p) AS INT) AS length_change, c <> p AS changed FROM l""")
def revision_deltas(spark, d):
    return R.revision_deltas(history(spark, d, "content"))


@query(f"WITH {R_} SELECT page_id, rev_id, md5(coalesce(content, '')) AS digest FROM v")
def delta_round_trip(spark, d):
    rows = R.delta_decode(R.delta_encode(history(spark, d, "content")))
    return rows.select("page_id", "rev_id", F.md5("content").alias("digest"))


@query(f"WITH {Y} SELECT page_id, string_agg(year, ' ' ORDER BY year) AS years FROM y WHERE text <> '' GROUP BY page_id")
def active_years(spark, d):
    return R.active_years(texts(spark, d)).select("page_id", F.array_join(F.transform("years", lambda y: y.cast("string")), " ").alias("years"))


ED = f"""{R_}, e AS (SELECT page_id, cast(year(ts AT TIME ZONE 'UTC') AS INT) AS year, count(*) AS edits FROM v GROUP BY ALL)"""


def _edits(spark, d) -> DataFrame:
    return R.edits(history(spark, d))


@query(f"WITH {ED} SELECT * FROM e")
def edits_page(spark, d):
    return _edits(spark, d)


@query(f"""WITH {SEG} SELECT page_id, cast(year(ts AT TIME ZONE 'UTC') AS INT) AS year, cast(sum(CASE WHEN number % 50 = 0 AND number < total THEN 2 ELSE 1 END) AS BIGINT) AS edits FROM nr GROUP BY ALL""")
def edits_page_overlap(spark, d):
    return R.edits(history(spark, d), 50)


@query(f"WITH {ED} SELECT year, cast(sum(edits) AS BIGINT) AS total_edits, count(*) AS distinct_pages, round(avg(edits), 6) AS mean_edits_per_page FROM e GROUP BY year")
def edits_global(spark, d):
    return R.edits_global(_edits(spark, d))


@query(f"""WITH {ED} SELECT page_id, count(*) AS years, cast(sum(edits) AS BIGINT) AS total, max(edits) AS most, arg_max(year, (edits, -year)) AS most_year, min(edits) AS least, arg_min(year, (edits, year)) AS least_year FROM e GROUP BY page_id""")
def edit_summary(spark, d):
    return R.edit_summary(_edits(spark, d))


@query(f"""WITH {ED}, s AS (SELECT page_id, year, coalesce(abs(edits - lag(edits) OVER w) <= greatest(1.0, 0.1 * avg(edits) OVER (PARTITION BY page_id)), false) AS small FROM e WINDOW w AS (PARTITION BY page_id ORDER BY year)),
t AS (SELECT page_id, year, small AND lag(small, 1, false) OVER w AND lag(small, 2, false) OVER w AS third FROM s WINDOW w AS (PARTITION BY page_id ORDER BY year))
SELECT page_id, CASE WHEN count(*) >= 5 THEN min(year) FILTER (third) END AS equilibrium_year FROM t GROUP BY page_id""")
def equilibrium(spark, d):
    return R.equilibrium(_edits(spark, d))


@query(f"WITH {ED} SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY year DESC) <= 10")
def edits_preview(spark, d):
    return R.edits_preview(_edits(spark, d))


_KEY = r"lower(regexp_replace(trim(translate({c}, '_', ' ')), '\s+', '_', 'g'))"


@query(f"WITH {ED}, t AS (SELECT DISTINCT {_KEY.format(c='title_key')} AS title_key, page_id FROM articles) SELECT title_key, page_id, year, edits FROM t JOIN e USING (page_id)")
def edits_by_title(spark, d):
    return R.edits_by_title(_edits(spark, d), table(spark, d, "articles"))


@query(f"WITH {ED} SELECT year, edits FROM e WHERE page_id = '777'")
def edits_of(spark, d):
    return R.edits_of(_edits(spark, d), table(spark, d, "articles"), "777")


@query("""WITH p AS (SELECT article, word, min(emitted_at) AS a, CASE WHEN count(DISTINCT emitted_at) > 1 THEN max(emitted_at) END AS b FROM diff_emits WHERE article IS NOT NULL AND word IS NOT NULL GROUP BY ALL)
SELECT article, word FROM p WHERE a <= '2016-03-01 00:00:00+00'::TIMESTAMPTZ AND (b IS NULL OR b > '2016-03-01 00:00:00+00'::TIMESTAMPTZ)""")
def active_at(spark, d):
    rows = table(spark, d, "diff_emits").where("article IS NOT NULL AND word IS NOT NULL").groupBy("article", "word").agg(
        F.min("emitted_at").alias("a"), F.when(F.min("emitted_at") < F.max("emitted_at"), F.max("emitted_at")).alias("b")
    )
    return R.active_at(rows, "a", "b", "2016-03-01 00:00:00").select("article", "word")


# ---- texts and titles

def _strip_sql(c: str, order) -> str:
    for k in order:
        pattern, left = X.STRIP[k]
        flags = "g"
        if pattern.startswith("(?s)"):
            pattern, flags = pattern[4:], "gs"
        if pattern.startswith("(?i)"):
            pattern, flags = pattern[4:], "gi"
        left = left.replace("$", "\\").replace("\n", "' || chr(10) || chr(10) || '" if left else "") if "\n" not in left else "' || chr(10) || chr(10) || '"
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{left}', '{flags}')"
    return f"trim({c}, E' \\t\\r\\n')"


@query(f"WITH {Y} SELECT page_id, year, {_strip_sql('text', X.DEFINITION_ORDER)} AS plain FROM y WHERE text <> ''")
def plain_text(spark, d):
    return texts(spark, d).where("text <> ''").select("page_id", "year", X.plain_text(F.col("text")).alias("plain"))


@query(f"WITH {R_} SELECT page_id, rev_id, {_strip_sql('content', X.DUMP_ORDER)} AS plain FROM v WHERE content <> ''")
def plain_text_dump(spark, d):
    return history(spark, d, "content").where("content <> ''").select("page_id", "rev_id", X.plain_text(F.col("content"), X.DUMP_ORDER).alias("plain"))


_ENDS = f"""list_filter(range(1, length(par) + 1), lambda i: par[i] IN ('.', '!', '?') AND (i = length(par) OR par[i + 1] = ' ')
  AND (ltrim(par[i + 2:]) = '' OR regexp_matches(ltrim(par[i + 2:]), '^[A-Z"(\\[]')) AND lower(regexp_extract(par[1:i - 1], '([^ ]*)$', 1)) NOT IN ({quoted(C.ABBREVIATIONS)}))[1]"""


@query(rf"""WITH {Y}, p AS (SELECT page_id, year, coalesce(title, '') AS title, {_strip_sql('text', X.DEFINITION_ORDER)} AS plain FROM y WHERE text <> '' AND year BETWEEN {C.FIRST_YEAR} AND {C.LAST_YEAR}),
l AS (SELECT *, list_transform(string_split(plain, chr(10)), lambda x: trim(x, E' \t\r\n')) AS l FROM p),
n AS (SELECT *, coalesce(nullif(list_position(list_transform(l[2:], lambda x: x = '' OR regexp_matches(x, '^[=#*:;|]')), true), 0), len(l)) - 1 AS n FROM l),
g AS (SELECT page_id, year, title, trim(regexp_replace(array_to_string(l[1:1] || l[2:][1:n], ' '), '\s+', ' ', 'g')) AS par FROM n),
e AS (SELECT *, {_ENDS} AS stop FROM g WHERE par <> '')
SELECT year, title, arg_min(CASE WHEN stop IS NOT NULL THEN trim(par[1:stop]) WHEN length(par) > {C.EXCERPT} THEN par[1:{C.EXCERPT}] || '…' ELSE par END, page_id) AS sentence FROM e GROUP BY year, title""")
def definition(spark, d):
    return D.definitions(texts(spark, d))


@query(rf"""WITH {Y}, l AS (SELECT page_id, year, list_transform(regexp_extract_all(text, '\[\[([^\]|#]+)([|#][^\]]+)?\]\]', 1), lambda x: trim(x)) AS l FROM y WHERE text <> '')
SELECT DISTINCT page_id, year, link FROM (SELECT page_id, year, unnest(l) AS link FROM l) WHERE link <> '' AND NOT regexp_matches(link, '^({"|".join(C.DUMP_PREFIXES)})')""")
def links(spark, d):
    return texts(spark, d).where("text <> ''").select("page_id", "year", F.explode(X.wiki_links(F.col("text"))).alias("link"))


@query(rf"""WITH {R_} SELECT page_id, rev_id FROM v WHERE coalesce(title, '') <> '' AND coalesce(content, '') <> ''
AND NOT regexp_matches(title, '^({"|".join(C.DUMP_PREFIXES)})') AND NOT starts_with(lower(trim(content, E' \t\r\n')), '#redirect')""")
def content_filter(spark, d):
    return history(spark, d, "title", "content").where(X.is_article(F.col("title"), F.col("content"))).select("page_id", "rev_id")


@query(rf"""SELECT DISTINCT title FROM articles WHERE trim(translate(title, '_', ' ')) <> '' AND NOT regexp_matches(trim(translate(title, '_', ' ')), '^({"|".join(C.CRAWL_PREFIXES)})')
AND NOT regexp_matches(trim(translate(title, '_', ' ')), '{"|".join(C.CRAWL_PATTERNS)}', 'i')""")
def followable_titles(spark, d):
    return table(spark, d, "articles").where(X.is_followed(F.col("title"))).select("title").distinct()


@query(f"SELECT DISTINCT title, {_KEY.format(c='title')} AS key, trim(translate(title, '_', ' ')) AS shown FROM articles WHERE title IS NOT NULL")
def title_keys(spark, d):
    rows = table(spark, d, "articles").where("title IS NOT NULL").select("title").distinct()
    shown = X.display_title(F.col("title"))
    return rows.select("title", X.title_key(shown).alias("key"), shown.alias("shown"))


# ---- keyed access

@query("SELECT DISTINCT title_key, page_id, title FROM articles WHERE page_id = '777'")
def point_lookup(spark, d):
    return K.get(table(spark, d, "articles"), "page_id", "777").distinct()


@query("SELECT DISTINCT title_key FROM articles WHERE title_key IS NOT NULL")
def distinct_keys(spark, d):
    return K.keys(table(spark, d, "articles"), "title_key")


@query("SELECT DISTINCT title_key, page_id FROM articles WHERE starts_with(title_key, 'treaty_of_')")
def prefix_scan(spark, d):
    return K.prefix(table(spark, d, "articles"), "title_key", "treaty_of_").select("title_key", "page_id").distinct()


@query("""WITH t AS (SELECT page_id, max(title) AS title FROM articles WHERE page_id IS NOT NULL GROUP BY page_id)
SELECT page_id, sha256('{"page_id":"' || page_id || '","title":"' || replace(replace(title, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}') AS id,
       substr(sha256('{"page_id":"' || page_id || '","title":"' || replace(replace(title, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}'), 1, 5) AS short FROM t WHERE title IS NOT NULL""")
def content_ids(spark, d):
    rows = table(spark, d, "articles").where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("title").alias("title")).where("title IS NOT NULL")
    key = K.content_key("page_id", "title")
    return rows.select("page_id", key.alias("id"), K.short_key(key).alias("short"))


_NODES = sorted(PL.node_id(f"10.0.0.{i}", 8080) for i in range(1, 6))


@query(f"""WITH k AS (SELECT DISTINCT page_id, sha256('"' || page_id || '"') AS id FROM articles WHERE page_id IS NOT NULL),
n AS (SELECT unnest([{quoted(_NODES)}]) AS node),
w AS (SELECT page_id, arg_max(node, sha256(id || node)) AS weight FROM k, n GROUP BY page_id),
r AS (SELECT page_id, coalesce(min(node) FILTER (node >= id), '{_NODES[0]}') AS ring FROM k, n GROUP BY page_id),
m AS (SELECT page_id, list_reduce(list_transform(range(8), lambda i: ('0x' || substr(id, (i * 8 + 1)::INT, 8))::BIGINT), lambda r, p: (r * 4294967296 + p) % 5, 0::BIGINT) AS rest FROM k)
SELECT page_id, id, ring, weight, [{quoted(_NODES)}][rest + 1] AS naive FROM k JOIN m USING (page_id) JOIN w USING (page_id) JOIN r USING (page_id)""")
def placements(spark, d):
    rows = K.keys(table(spark, d, "articles"), "page_id").withColumn("id", PL.key_id(F.col("page_id")))
    return rows.select("page_id", "id", PL.on_ring(F.col("id"), _NODES).alias("ring"), PL.by_weight(F.col("id"), _NODES).alias("weight"), PL.by_remainder(F.col("id"), _NODES).alias("naive"))


@query("""SELECT DISTINCT split_part(k, ':', 1) AS family, cast(split_part(k, ':', 2) AS INT) AS year, substr(k, 7 + length(split_part(k, ':', 2))) AS word
FROM (SELECT 'diff:' || year || ':' || word AS k FROM diff_emits WHERE word IS NOT NULL AND year IS NOT NULL)""")
def key_parts(spark, d):
    rows = table(spark, d, "diff_emits").where("word IS NOT NULL AND year IS NOT NULL").select(F.concat_ws(":", F.lit("diff"), "year", "word").alias("k"))
    return rows.select(*K.key_parts(F.col("k"), ["family", "year", "word"])).withColumn("year", F.col("year").cast("int")).distinct()


_COUNTS = "SELECT word, count(*) AS n FROM diff_emits WHERE word IS NOT NULL AND year = {y} GROUP BY word"


@query(f"WITH o AS ({_COUNTS.format(y=2012)}), n AS ({_COUNTS.format(y=2013)}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE word NOT IN (SELECT word FROM n)")
def upsert(spark, d):
    of = lambda y: table(spark, d, "diff_emits").where((F.col("year") == y) & F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n"))
    return K.put(of(2012), of(2013), ["word"])


@query("""WITH n AS (SELECT word, year, count(*) AS n FROM diff_emits WHERE word IS NOT NULL AND year IN (2012, 2013) GROUP BY ALL)
SELECT word, string_agg(n, ' ' ORDER BY year) AS n FROM n GROUP BY word""")
def append_lists(spark, d):
    rows = table(spark, d, "diff_emits").where("word IS NOT NULL").groupBy("word", "year").agg(F.count("*").alias("n"))
    old = rows.where("year = 2012").select("word", F.array("n").alias("n"))
    out = K.append(old, rows.where("year = 2013").select("word", "n"), ["word"], "n")
    return out.select("word", F.array_join(F.transform("n", lambda x: x.cast("string")), " ").alias("n"))


@query(f"WITH o AS ({_COUNTS.format(y=2012)}), n AS ({_COUNTS.format(y=2013)}) SELECT * FROM o WHERE word NOT IN (SELECT word FROM n)")
def delete_keys(spark, d):
    of = lambda y: table(spark, d, "diff_emits").where((F.col("year") == y) & F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n"))
    return K.delete(of(2012), of(2013), ["word"])[0]


@query("SELECT source AS key, cast(sum(n_chars) AS BIGINT) AS value FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source")
def map_reduce(spark, d):
    rows = table(spark, d, "documents").select("source", "n_chars").where("source IS NOT NULL AND n_chars IS NOT NULL")
    return MR.map_reduce(rows, lambda r: [(r["source"], int(r["n_chars"]))], lambda _, v: int(sum(v)), "long", "long", combine=True)


@query("SELECT source AS key, cast(sum(n_chars) AS BIGINT) AS value FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source")
def map_reduce_lists(spark, d):
    rows = table(spark, d, "documents").select("source", "n_chars").where("source IS NOT NULL AND n_chars IS NOT NULL")
    return MR.map_reduce(rows, lambda r: [(r["source"], int(r["n_chars"]))], lambda _, v: int(sum(v)), "long", "long")


@query("""SELECT DISTINCT title, regexp_replace(title, '[^a-zA-Z0-9._-]', '_', 'g') AS file_name, coalesce(nullif(title, ''), page_id, '') AS shown,
concat_ws('&', 'page=' || page_id, CASE WHEN title <> '' THEN 'title=' || replace(replace(url_encode(title), '%20', '+'), '~', '%7E') END) AS query
FROM articles WHERE page_id IS NOT NULL AND (title IS NULL OR regexp_full_match(title, '[A-Za-z0-9 ._~-]*'))""")
def names_of_titles(spark, d):
    rows = table(spark, d, "articles").where("page_id IS NOT NULL").where(F.col("title").isNull() | F.col("title").rlike(r"^[A-Za-z0-9 ._~-]*$")).select("title", "page_id").distinct()
    params = F.create_map(F.lit("page"), F.col("page_id"), F.lit("title"), F.col("title"))
    return rows.select("title", X.file_name(F.col("title")).alias("file_name"), X.first_filled(F.col("title"), F.col("page_id")).alias("shown"), X.query_string(params).alias("query")).distinct()


# ---- frontier

def frontier(spark, d) -> DataFrame:
    """A frontier over the article index: a page's number decides depth, status and times."""
    rows = table(spark, d, "articles").where("page_id IS NOT NULL AND title IS NOT NULL").groupBy(X.title_key(F.col("title")).alias("key")).agg(
        F.max("title").alias("title"), F.max(F.col("page_id").cast("long")).alias("no")
    )
    at = F.timestamp_micros(F.lit(1577836800000000) + F.col("no") % 100000 * 60000000)
    status = F.element_at(F.array(*(F.lit(s) for s in FR.STATUSES)), (F.col("no") % 4 + 1).cast("int"))
    return rows.select(
        "key", "title", (F.floor(F.col("no") / 4) % 4).cast("int").alias("depth"), status.alias("status"), F.lit("seed").alias("discovered_from"), at.alias("enqueued_at"),
        F.when(status == "inflight", at).alias("claimed_at"), F.lit(0).alias("retries"),
    )


FRONT = f"""fr AS (SELECT {_KEY.format(c='title').replace("translate(title, '_', ' ')", 'title')} AS key, max(title) AS title, max(page_id::BIGINT) AS no FROM articles WHERE page_id IS NOT NULL AND title IS NOT NULL GROUP BY 1),
frontier AS (SELECT key, title, cast(no // 4 % 4 AS INT) AS depth, ['pending', 'inflight', 'stored', 'failed'][no % 4 + 1] AS status, 'seed' AS discovered_from,
  make_timestamp(1577836800000000 + no % 100000 * 60000000) AS enqueued_at FROM fr)"""


@query(f"WITH {FRONT} SELECT key, depth FROM frontier WHERE status = 'pending' AND depth <= 2 ORDER BY depth, enqueued_at, key LIMIT 300")
def frontier_batch(spark, d):
    return FR.batch(frontier(spark, d)).select("key", "depth")


@query(f"""WITH {FRONT} SELECT key, CASE WHEN status = 'inflight' AND enqueued_at <= TIMESTAMP '2020-01-20 00:00:00' - INTERVAL 5 MINUTE THEN 'pending' ELSE status END AS status FROM frontier""")
def frontier_recovered(spark, d):
    return FR.recover_stale(frontier(spark, d), "2020-01-20 00:00:00").select("key", "status")


@query(f"""WITH {FRONT} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'inflight') AS inflight,
count(*) FILTER (status = 'stored') AS stored, count(*) FILTER (status = 'failed') AS failed FROM frontier""")
def status_counts(spark, d):
    return FR.status_counts(frontier(spark, d))


def _edges(spark, d) -> DataFrame:
    t = texts(spark, d)
    link = F.explode(X.wiki_links(F.col("text"))).alias("dst_title")
    return t.where("text <> '' AND title IS NOT NULL").select(F.col("title").alias("src_title"), link).distinct()


@query(rf"""WITH {FRONT}, {Y}, l AS (SELECT title AS src, unnest(list_transform(regexp_extract_all(text, '\[\[([^\]|#]+)([|#][^\]]+)?\]\]', 1), lambda x: trim(x))) AS dst FROM y WHERE text <> '' AND title IS NOT NULL),
g AS (SELECT DISTINCT src, dst FROM l WHERE dst <> '' AND NOT regexp_matches(dst, '^({"|".join(C.DUMP_PREFIXES)})')),
n AS (SELECT {_KEY.format(c='dst').replace("translate(dst, '_', ' ')", 'dst')} AS key, arg_min(dst, (1, src, dst)) AS title, min(src) AS discovered_from FROM g GROUP BY 1),
b AS (SELECT coalesce(f.key, n.key) AS key, f.key IS NULL AS is_new, coalesce(f.status, 'pending') AS status, f.depth AS od, f.title AS ot, f.discovered_from AS of_, n.title AS nt, n.discovered_from AS nf FROM frontier f FULL JOIN n ON n.key = f.key)
SELECT key, CASE WHEN is_new THEN nt ELSE ot END AS title, CASE WHEN is_new OR (nt IS NOT NULL AND status = 'pending' AND od > 1) THEN 1 ELSE od END AS depth, status,
CASE WHEN is_new OR (nt IS NOT NULL AND status = 'pending' AND od > 1) THEN nf ELSE of_ END AS discovered_from FROM b""")
def frontier_merge(spark, d):
    found = FR.discovered(_edges(spark, d).select(F.col("dst_title").alias("title"), F.lit(1).alias("depth"), F.col("src_title").alias("discovered_from")))
    return FR.merge(frontier(spark, d), found).select("key", "title", "depth", "status", "discovered_from")


def _round_sql(n: int, now: str) -> str:
    """One round of the crawl over f{n}: what is claimed, how it ends, what is found, and the frontier after it."""
    t = f"TIMESTAMP '{now}'"
    return f"""b{n} AS (SELECT key FROM f{n} WHERE status = 'pending' AND depth <= 2 ORDER BY depth, enqueued_at, key LIMIT 300),
o{n} AS (SELECT key, length(key) % 3 = 0 AS failed FROM b{n}),
s{n} AS (SELECT key, title, depth, CASE WHEN failed IS NULL THEN status WHEN NOT failed THEN 'stored' WHEN retries + 1 < 2 THEN 'pending' ELSE 'failed' END AS status, discovered_from, enqueued_at,
  CASE WHEN failed IS NULL THEN claimed_at WHEN NOT failed THEN {t} END AS claimed_at, retries + coalesce(failed::INT, 0) AS retries FROM f{n} LEFT JOIN o{n} USING (key)),
l{n} AS (SELECT {_KEY.format(c='dst').replace("translate(dst, '_', ' ')", 'dst')} AS key, depth + 1 AS depth, src, dst FROM g JOIN s{n} ON s{n}.key = g.from_key JOIN o{n} USING (key) WHERE NOT failed AND depth + 1 <= 2),
n{n} AS (SELECT key, min(depth) AS depth, arg_min(src, (depth, src, dst)) AS src, arg_min(dst, (depth, src, dst)) AS dst FROM l{n} WHERE key <> '' GROUP BY key),
m{n} AS (SELECT coalesce(s.key, n.key) AS key, s.key IS NULL AS new, s.key IS NULL OR (n.key IS NOT NULL AND s.status = 'pending' AND n.depth < s.depth) AS taken, s.title, s.depth AS d, s.status, s.discovered_from, s.enqueued_at,
  s.claimed_at, s.retries, n.depth AS nd, n.src, n.dst FROM s{n} s FULL JOIN n{n} n ON n.key = s.key),
f{n + 1} AS (SELECT key, CASE WHEN new THEN dst ELSE title END AS title, CASE WHEN taken THEN nd ELSE d END AS depth,
  CASE WHEN new OR status = 'inflight' AND claimed_at <= {t} - INTERVAL 5 MINUTE THEN 'pending' ELSE status END AS status, CASE WHEN taken THEN src ELSE discovered_from END AS discovered_from,
  CASE WHEN taken THEN {t} ELSE enqueued_at END AS enqueued_at, CASE WHEN status = 'inflight' AND claimed_at <= {t} - INTERVAL 5 MINUTE THEN NULL ELSE claimed_at END AS claimed_at, coalesce(retries, 0) AS retries FROM m{n})"""


_ROUNDS = ["2020-01-20 00:00:00", "2020-02-20 00:00:00"]


@query(rf"""WITH {FRONT}, {Y}, l AS (SELECT title AS src, unnest(list_transform(regexp_extract_all(text, '\[\[([^\]|#]+)([|#][^\]]+)?\]\]', 1), lambda x: trim(x))) AS dst FROM y WHERE text <> '' AND title IS NOT NULL),
g AS (SELECT DISTINCT src, dst, {_KEY.format(c='src').replace("translate(src, '_', ' ')", 'src')} AS from_key FROM l WHERE dst <> '' AND NOT regexp_matches(dst, '^({"|".join(C.DUMP_PREFIXES)})')),
f0 AS (SELECT key, title, depth, status, discovered_from, enqueued_at, CASE WHEN status = 'inflight' THEN enqueued_at END AS claimed_at, 0 AS retries FROM frontier),
{_round_sql(0, _ROUNDS[0])},
{_round_sql(1, _ROUNDS[1])}
SELECT key, title, depth, status, discovered_from, strftime(enqueued_at, '%Y-%m-%d %H:%M:%S') AS enqueued_at, strftime(claimed_at, '%Y-%m-%d %H:%M:%S') AS claimed_at, retries FROM f2""")
def frontier_rounds(spark, d):
    """Two rounds: batch, claim, outcomes, what the stored pages link to, and recovery. A key's length says whether it fails."""
    state, edges = checkpointed(frontier(spark, d)), checkpointed(_edges(spark, d).withColumn("key", X.title_key(F.col("src_title"))))
    for now in _ROUNDS:
        taken = checkpointed(FR.batch(state).select("key", "depth"))
        tried = taken.select("key", "depth", (F.length("key") % 3 == 0).alias("failed"))
        after = FR.settle(FR.claim(state, taken, now), tried, now, 2)
        links = edges.join(tried.where("NOT failed"), "key").select(F.col("dst_title").alias("title"), (F.col("depth") + 1).alias("depth"), F.col("src_title").alias("discovered_from"))
        state = checkpointed(FR.recover_stale(FR.merge(after, FR.discovered(links, now=now)), now))
    return state.withColumns({c: stamp(c) for c in ("enqueued_at", "claimed_at")})


@query(rf"""WITH {FRONT}, t AS (SELECT DISTINCT title_key AS key FROM articles WHERE title_key IS NOT NULL)
SELECT key FROM t WHERE key NOT IN (SELECT key FROM frontier) ORDER BY key LIMIT 100000""")
def frontier_enqueue(spark, d):
    return FR.unseen(table(spark, d, "articles").select(F.col("title_key").alias("key")), frontier(spark, d))


@query(rf"""WITH {FRONT}, s AS (SELECT {_KEY.format(c='dt').replace("translate(dt, '_', ' ')", 'dt')} AS key, min(dt) AS title FROM (SELECT title AS dt FROM documents WHERE title IS NOT NULL) GROUP BY 1)
SELECT key, status, depth FROM frontier UNION ALL SELECT key, 'pending', 0 FROM s WHERE key <> '' AND key NOT IN (SELECT key FROM frontier)""")
def frontier_seeded(spark, d):
    return FR.seed(frontier(spark, d), table(spark, d, "documents").select("title").where("title IS NOT NULL")).select("key", "status", "depth")


_SHOWN = "trim(translate(dst, '_', ' '))"


def _key_sql(c: str) -> str:
    return _KEY.format(c=c).replace(f"translate({c}, '_', ' ')", c)


@query(rf"""WITH RECURSIVE {Y}, l AS (SELECT title AS src, unnest(list_transform(regexp_extract_all(text, '\[\[([^\]|#]+)([|#][^\]]+)?\]\]', 1), lambda x: trim(x))) AS dst FROM y WHERE text <> '' AND title IS NOT NULL),
e AS (SELECT DISTINCT {_key_sql('src')} AS src, {_key_sql('dst')} AS key FROM l WHERE dst <> '' AND NOT regexp_matches(dst, '^({"|".join(C.DUMP_PREFIXES)})')
      AND NOT regexp_matches({_SHOWN}, '^({"|".join(C.CRAWL_PREFIXES)})') AND NOT regexp_matches({_SHOWN}, '{"|".join(C.CRAWL_PATTERNS)}', 'i')),
b(key, depth) AS (SELECT DISTINCT {_key_sql('title')}, 0 FROM year_history WHERE year = 2008 AND title IS NOT NULL UNION SELECT e.key, depth + 1 FROM b JOIN e ON e.src = b.key WHERE depth < 4)
SELECT key, min(depth) AS depth FROM b WHERE key <> '' GROUP BY key""")
def crawl_bfs(spark, d):
    seeds = table(spark, d, "year_history").where("year = 2008 AND title IS NOT NULL").select("title")
    return FR.traverse(_edges(spark, d), seeds, max_depth=4)


# ---- the plain inverted index

_TERMS = rf"""tt AS (SELECT source AS url, list_filter(regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[a-z]+'), lambda x: x {NO_STOP}) AS a FROM documents WHERE text IS NOT NULL),
te AS (SELECT url, a, unnest(range(1, len(a) + 1)) AS pos FROM tt),
tg AS (SELECT url, array_to_string(a[pos:pos + n], ' ') AS term FROM te, (VALUES (0), (1), (2)) g(n) WHERE pos + n <= len(a)),
ix AS (SELECT term, url, count(*) AS freq FROM tg GROUP BY ALL)"""


@query(f"WITH {_TERMS} SELECT * FROM ix")
def invert_index(spark, d):
    return I.local_index(table(spark, d, "documents"), "text", "source")


@query("""SELECT doc_id, cast(greatest(n, 0) + greatest(n - 1, 0) + greatest(n - 2, 0) AS INT) AS grams FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS n FROM documents WHERE text IS NOT NULL)""")
def ngrams(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.runs(F.col("text"), 3).alias("t")).select("doc_id", F.size(X.ngrams(F.col("t"))).alias("grams"))


@query(f"""WITH {_TERMS}, h AS (SELECT term, coalesce(url, 'none') AS url, freq FROM ix) SELECT term, url, cast(2 * freq AS BIGINT) AS freq FROM h""")
def index_merge(spark, d):
    mine = I.local_index(table(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit("none"))), "text", "source")
    return I.merge_indexes(mine, mine)


@query(f"""WITH {_TERMS} SELECT term || ' | ' || string_agg(url || ' ' || freq, ' ' ORDER BY freq DESC, url) AS line FROM ix WHERE url IS NOT NULL AND NOT contains(term, ' ') GROUP BY term""")
def index_lines(spark, d):
    return I.as_lines(I.local_index(table(spark, d, "documents").where("source IS NOT NULL"), "text", "source", most=1))


@query()
def stemmed_index(spark, d):
    return I.local_index(table(spark, d, "documents"), "text", "source", stem=True, most=1)


@query()
def html_texts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", U.html_text("text").alias("plain"))


@query(r"""SELECT DISTINCT page_id, year, url FROM (SELECT DISTINCT page_id, year, unnest(regexp_extract_all(text, '<a\s[^>]*href="([^"]+)"', 1)) AS url FROM year_history WHERE text IS NOT NULL)""")
def html_urls(spark, d):
    rows = table(spark, d, "year_history").where("text IS NOT NULL").select("page_id", "year", "text").distinct()
    return rows.select("page_id", "year", F.explode(U.html_urls("text", F.lit("https://wiki.example/index.html"))).alias("url")).distinct()


@query()
def html_body_links(spark, d):
    rows = texts(spark, d).where("text IS NOT NULL")
    wrapped = F.concat(F.lit('<div class="mw-parser-output"><p>'), F.regexp_replace("text", 'href="https://wiki.example/', 'href="/wiki/'), F.lit("</p></div>"))
    return rows.select("page_id", "year", F.explode(U.html_links(wrapped, F.col("title"))).alias("link"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS INT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_round_trip(spark, d):
    k = F.from_json("props", "k int")
    return table(spark, d, "events").select("event_id", k["k"].alias("k"), F.to_json(k).alias("again"))
