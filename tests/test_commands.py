"""The command language over a small dataset folder."""

import datetime as dt

import pytest

from annalith.operators import store
from annalith.plans.commands import CommandError, Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    years = [("1", "Alpha Town", 2001, "Alpha town stands here. harbour harbour bridge castle"), ("1", "Alpha Town", 2002, "Alpha town stands there. harbour bridge castle garden"), ("2", "Beta", 2001, "Beta has a harbour. bridge castle"), ("2", "Beta", 2002, "Beta has a harbour. bridge castle harbour")]
    spark.createDataFrame(years, "page_id string, title string, year int, text string").write.parquet(f"{d}/year_history.parquet")
    revs = [("1", None, str(i), None, dt.datetime(2000 + i, 1, 1), "x", i) for i in range(1, 7)]
    spark.createDataFrame(revs, "page_id string, title string, rev_id string, parent_id string, ts timestamp, content string, pos int").write.parquet(f"{d}/revisions.parquet")
    spark.createDataFrame([("alpha_town", "1", "Alpha Town")], "title_key string, page_id string, title string").write.parquet(f"{d}/articles.parquet")
    return Engine(spark, str(d), str(tmp_path_factory.mktemp("root")))


@pytest.mark.parametrize(
    "line,n",
    [("2002 Harbour", 1), ("2001-2002 harbour", 1), ("2002 zebra", 0), ("birth 2002", 2), ("death 2002", 1), ("def 2001 Alpha Town", 1), ("def 2001 alpha town", 0), ("search 2001 Harbour bridge", 2),
     ("edits alpha town", 1), ("edits 1", 1), ("edits nowhere", 0), ("edits-global 2003", 1), ("EDITS-GLOBAL 2003", 1), ("align 2001 2002", 1), ("drift 2001 2002 harbour", 1), ("nn 2001 hárbour 2", 2), ("nn 2001 harbour", 3), ("embed 2001 bridge", 1)],
)
def test_commands(engine, line, n):
    assert engine.run(line).count() == n


def test_edit_report(engine):
    r = engine.run("edits alpha town").first()
    assert (r.years, r.total, r.most_year, r.least_year, r.equilibrium_year) == (6, 6, 2001, 2001, 2004)
    assert [tuple(x) for x in r.recent] == [(2000 + i, 1) for i in range(1, 7)]


def test_drift_falls_back(engine, spark, tmp_path):
    assert engine.run("drift 2001 2002 harbour").first().aligned
    rows = spark.createDataFrame([(2001, 2002, "castle", 0.5, 0.1, 0.0)], "base_year int, target_year int, word string, cosine_shift double, euclidean_shift double, rank_shift double")
    store.write_index(rows, str(tmp_path), "drift", None)
    written = Engine(spark, engine.folder, str(tmp_path))
    assert written.run("drift 2001 2002 castle").first().cosine_shift == 0.5
    r = written.run("drift 2001 2002 harbour").first()
    assert not r.aligned and r.cosine_shift is not None and r.rank_shift is None


@pytest.mark.parametrize("line", ["", "2001", "birth", "birth x", "nonsense 1 2", "align 2001"])
def test_errors(engine, line):
    with pytest.raises(CommandError):
        engine.run(line)


def test_help(engine):
    assert "search" in engine.run("help")


def test_written_indexes_are_used(engine, spark):
    store.write_index(engine.index("diff"), engine.root, "diff")
    again = Engine(spark, "/nowhere", engine.root)
    assert again.run("2002 harbour").count() == 1
