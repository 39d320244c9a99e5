"""How distinctive a term is of a record, against the other records of its group.

The score is the z-value of the log-odds ratio of the record against the rest of the group, with an informative Dirichlet
prior whose pseudo-counts are spread as the terms of the whole group are: a term that is common everywhere has similar odds
on both sides, and a term that is rare has a large standard error unless the record repeats it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalith.session import checkpointed

#: Entries a task gathers before it hands them on; they are added up afterwards.
HELD = 500_000
#: Pseudo-counts of the prior in all, about the length of a record.
PRIOR = 500.0
# Kinds of rows that reading the texts gives.
COLLECTION, SCORED, GROUP = 0, 1, 2


def term_scores(texts: DataFrame, group: str, record: str, text: str, min_length: int = 3, min_count: int = 1, prior: float = PRIOR) -> DataFrame:
    """One row for each (group, record, term): f, n (terms of the record), d (distinct ones), c (count in the group),
    k (records of the group with the term), total (records of the group with any term), z.

    Terms are the longest runs of a-z and 0-9 of at least ``min_length`` characters in the lower-cased text. Counts are
    over all records; terms that occur fewer than ``min_count`` times in a record are counted but not scored, which is
    decided before anything is joined. ``texts`` has one row for each (group, record). Null and empty texts, and
    texts without a term, are no records and give no rows; a null group or record is left out. A group with one record has
    no rest: all its z are about 0.

    Each text is read once and gives its terms' counts, of which the collection's part is added up before the shuffle.
    A group's totals, one row for each group, are joined to the collection's terms, by broadcast only while the measured size of
    the totals allows it; terms are joined by (group, term), where the collection's side has one row for each key.
    """
    source = texts.where(F.col(group).isNotNull() & F.col(record).isNotNull() & F.col(text).isNotNull()).select(
        F.col(group).alias("g"), F.col(record).alias("r"), F.col(text).alias("text")
    )
    long = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    schema = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("g", source.schema["g"].dataType), T.StructField("r", source.schema["r"].dataType),
         T.StructField("term", T.StringType()), *long("a", "b", "c")]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile("[a-z0-9]{%d,}" % min_length).findall
        counts: dict = {}
        sizes: dict = {}
        types = [pa.string(), pa.string()]

        def rows(kind: int, g, r, term, *numbers) -> pa.RecordBatch:
            n = len(g)
            columns = [pa.array([kind] * n, pa.int32()), pa.array(g, types[0]), pa.array(r, types[1]) if r else pa.nulls(n, types[1]),
                       pa.array(term, pa.string()) if term else pa.nulls(n, pa.string())]
            columns += [pa.array(x, pa.int64()) for x in numbers]
            columns += [pa.nulls(n, pa.int64())] * (3 - len(numbers))
            return pa.RecordBatch.from_arrays(columns, ["kind", "g", "r", "term", "a", "b", "c"])

        def handed_on() -> Iterator[pa.RecordBatch]:
            for g, (c, k) in counts.items():
                yield rows(COLLECTION, [g] * len(c), None, list(c), list(c.values()), [k[t] for t in c])
            counts.clear()

        held = 0
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type]
            few: list = []
            for g, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                f = Counter(find(t.lower()))
                if not f:
                    continue
                c, k = counts.setdefault(g, (Counter(), Counter()))
                held -= len(c)
                for term, n in f.items():
                    c[term] += n
                    k[term] += 1
                held += len(c)
                n, d = f.total(), len(f)
                size = sizes.setdefault(g, [0, 0])
                size[0] += 1
                size[1] += n
                few += [(g, r, term, x, n, d) for term, x in f.items() if x >= min_count]
            if few:
                yield rows(SCORED, *map(list, zip(*few)))
            if held > HELD:
                yield from handed_on()
                held = 0
        yield from handed_on()
        if sizes:
            yield rows(GROUP, list(sizes), None, None, [x[0] for x in sizes.values()], [x[1] for x in sizes.values()])

    counted = source.mapInArrow(count, schema)
    if min_count > 1:  # few rows then; otherwise they are more than the texts, which are rather read again
        counted = checkpointed(counted)
    collection = counted.where(F.col("kind") == COLLECTION).groupBy("g", "term").agg(F.sum("a").alias("c"), F.sum("b").alias("k"))
    totals = counted.where(F.col("kind") == GROUP).groupBy("g").agg(F.sum("a").alias("total"), F.sum("b").cast("double").alias("size"))
    scored = (
        counted.where(F.col("kind") == SCORED)
        .select("g", "r", "term", F.col("a").alias("f"), F.col("b").alias("n"), F.col("c").alias("d"))
        .join(collection.join(totals, "g"), ["g", "term"])
    )
    a = F.lit(prior) * F.col("c") / F.col("size")
    tiny = F.lit(1e-9)
    here = F.log((F.col("f") + a) / F.greatest(F.col("n") + prior - F.col("f") - a, tiny))
    rest = F.log((F.col("c") - F.col("f") + a) / F.greatest(F.col("size") - F.col("n") + prior - F.col("c") + F.col("f") - a, tiny))
    z = (here - rest) / F.sqrt(1 / (F.col("f") + a) + 1 / (F.col("c") - F.col("f") + a))
    return scored.select(
        F.col("g").alias(group), F.col("r").alias(record), "term", "f", "n", "d", "c", "k", "total", z.alias("z")
    )
