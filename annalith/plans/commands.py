"""The command language: one line, one query."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalith import constants as C
from annalith.operators import definitions, revisions, search, semantics, temporal
from annalith.sources.tables import distinct_year_texts, table

HELP = """<year> <word>             additions and removals of a word in a year
<year>-<year> <word>      the same over a range of years
birth <year>              the words most added
death <year>              the words most removed
def <year> <title>        the first sentence of an article
search <year> <term>...   the best articles
edits <title or number>   a page's edits: years, total, most, least, equilibrium, last years
edits-global <year>       edits of all pages
align <year> <year>       alignment of two years
drift <year> <year> <word>  how far a word moved
nn <year> <word> [k]      the nearest words
embed <year> <word>       a word's vector and features
help, exit, quit"""


class CommandError(ValueError):
    """A line that is no command."""


@dataclass
class Engine:
    """The analyses over one dataset folder, or over indexes written before under ``root``.

    Frames are plans; what ``root`` has is read from there, by year partition, and the rest is computed on demand.
    """

    spark: SparkSession
    folder: str
    root: str | None = None
    indexes: dict[str, DataFrame] = field(default_factory=dict)

    def index(self, name: str) -> DataFrame:
        if name not in self.indexes:
            if self.root and self._written(name):
                self.indexes[name] = self.spark.read.parquet(f"{self.root}/{name}")
            else:
                self.indexes[name] = getattr(self, f"_{name}")()
        return self.indexes[name]

    def _written(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @cached_property
    def texts(self) -> DataFrame:
        return distinct_year_texts(table(self.spark, self.folder, "year_history"), "title")

    @cached_property
    def history(self) -> DataFrame:
        return revisions.distinct_revisions(table(self.spark, self.folder, "revisions"))

    def _diff(self) -> DataFrame:
        return temporal.diff_totals(temporal.temporal_diff(self.texts))

    def _tfidf(self) -> DataFrame:
        return search.tfidf(self.texts)

    def _definition(self) -> DataFrame:
        return definitions.definitions(self.texts)

    def _cooc(self) -> DataFrame:
        return semantics.cooccurrence(self.texts)

    def _embedding(self) -> DataFrame:
        return semantics.embeddings(self.index("cooc"))

    def _edits(self) -> DataFrame:
        return revisions.edits(self.history)

    def run(self, line: str) -> DataFrame | str:
        """The result of a command line, or the help text. A line that isn't one is an error."""
        parts = line.split()
        if not parts:
            raise CommandError("empty line")
        word, args = parts[0], parts[1:]
        year = lambda s: int(s) if re.fullmatch(r"\d{4}", s) else self._fail(f"no year: {s}")
        if word == "help":
            return HELP
        if word in ("birth", "death") and len(args) == 1:
            totals = self.index("diff").where(F.col("year") == year(args[0]))
            return (temporal.births if word == "birth" else temporal.deaths)(totals).orderBy("place_no")
        if word == "def" and len(args) >= 2:
            title = line.split(None, 2)[2].strip()
            return self.index("definition").where((F.col("year") == year(args[0])) & (F.col("title") == title))
        if word == "search" and len(args) >= 2:
            return search.search(self.index("tfidf"), year(args[0]), args[1:])
        if word.lower() == "edits-global" and len(args) == 1:
            return revisions.edits_global(self.index("edits").where(F.col("year") == year(args[0])))
        if word == "edits" and args:
            return revisions.edit_report(self.index("edits"), table(self.spark, self.folder, "articles"), " ".join(args))
        if word == "align" and len(args) == 2:
            return semantics.alignment(self._shared(*args)).withColumn("matrix", semantics.V.diagonal(F.col("signs")))
        if word == "drift" and len(args) == 3:
            return self._drift_of(year(args[0]), year(args[1]), semantics.normalised_word(args[2]))
        if word == "nn" and len(args) in (2, 3):
            k = int(args[2]) if len(args) == 3 and re.fullmatch(r"-?\d+", args[2]) else C.NN_LIMIT
            return semantics.nearest(self.index("embedding").where(F.col("year") == year(args[0])), semantics.normalised_word(args[1]), k)
        if word == "embed" and len(args) == 2:
            mine = (F.col("year") == year(args[0])) & (F.col("word") == semantics.normalised_word(args[1]))
            return self.index("embedding").where(mine).withColumn("top_features", F.slice("top_features", 1, 10))
        if (m := re.fullmatch(r"(\d{4})-(\d{4})", word)) and args:
            return temporal.diff_range(self.index("diff"), args[0], int(m.group(1)), int(m.group(2)))
        if re.fullmatch(r"\d{4}", word) and args:
            return temporal.diff_range(self.index("diff"), args[0], int(word), int(word))
        raise CommandError(f"not understood: {line}")

    def _drift_of(self, base: int, target: int, word: str) -> DataFrame:
        """The drift of a word, from the index if one is written; where that lacks the word, its shift without alignment."""
        shared = self._shared(base, target)
        mine = shared.where(F.col("word") == word)
        if self.root and self._written("drift"):
            known = self.index("drift").where((F.col("base_year") == base) & (F.col("target_year") == target) & (F.col("word") == word))
        else:
            known = semantics.drift(mine, semantics.alignment(shared))
        shift = semantics.unaligned_shift(mine, known, word)
        return shift.join(known.select("word", "euclidean_shift", "rank_shift"), "word", "left")

    def _shared(self, base: str | int, target: str | int) -> DataFrame:
        return semantics.shared_vocabulary(self.index("embedding"), int(base), int(target))

    @staticmethod
    def _fail(message: str) -> int:
        raise CommandError(message)


def main(argv: list[str]) -> int:
    """Read commands from standard input: python -m annalith.plans.commands FOLDER [INDEX_ROOT]"""
    from annalith.session import build_session

    engine = Engine(build_session(), argv[0], argv[1] if len(argv) > 1 else None)
    for line in sys.stdin:
        if line.strip() in ("exit", "quit"):
            break
        try:
            result = engine.run(line)
        except CommandError as e:
            print(e)
            continue
        if isinstance(result, str):
            print(result)
        else:
            result.show(50, truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
