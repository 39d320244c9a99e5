"""Markup found and left alone, clean text, and inferred wrappers."""

import pytest

from annalith.llm import markup, wrappers

MARKED = [
    "a <b>bold</b> word", "x<br/>y", "A &amp; B", "&#40;x&#41;", "before <!-- note --> after", "see [[Link]] here", "[[File:a.jpg|thumb|x]]", "it is {{convert|3|kg}}", "'''Name''' is", "''it''", "== Head ==",
    "__NOTOC__", "More at [https://a.example/x the page].", "text\n\n* one\n* two", "text\n\n# one\n# two", "text\n\n: indented", "----", "text <ref name=\"a\" /> more", "{| class=\"w\"\n|-\n| 1 || 2\n|}", "a *word* here",
    "a **word** here", "__strong__ word", "~~gone~~", "run `ls -l`", "[text](https://a.example)", "![alt](a.png)", "note[^1]", "# Head", "Head\n-----\n\ntext", "```\ncode\n```", "> quoted", "| a | b |\n|---|---|\n| 1 | 2 |",
    "text\n\n1. one\n2. two", "text\n\n* * *\n\ntext", "\\section{A}", "\\emph{x} y", "about 5\\% of", "$x^2$ is", "$$\\sum x$$", "\\(x \\le 3\\)", "\\[\nE = mc\n\\]", "\\begin{itemize}\n\\item a\n\\end{itemize}", "text\n\n% comment\n\ntext", "- [x] done",
]
PLAIN = [
    "costs $40 and later $55", "If 5 < 42 and 17 > 3, fine", "The set {2, 3, 5}", "C# tuning", "ranked #3", "R&D office", "fell by 5% - a heavy year", "Half (50 %)", "the rest [about 57] remained", "reads \"x [sic] y\"",
    "About ~35 visitors", "Here 5 * 3 = 15, as shown", "The file village_seed holds", "The ratio a/b is 3 : 4", "He wrapped\n- a line - here", "born 5\n* 3 = 15", "It's the dogs' house", "", "  \n", "1. only one", "a_b_c and d_e", "3 > 2 > 1",
    "at C:\\new\\table", "x = 3", "日本語。テキスト", "170\n> 3, the road", "AT&T; no",
]


@pytest.mark.parametrize("text", MARKED)
def test_found(text):
    c = markup.Cleaner()
    clean, _ = c.clean(text)
    assert c.found, text
    assert clean != text


@pytest.mark.parametrize("text", PLAIN)
def test_left_alone(text):
    c = markup.Cleaner()
    assert c.clean(text)[0] == text and not c.found


@pytest.mark.parametrize(
    "text,clean",
    [
        ("See [[A]] and [[B|the b]].", "See A and the b."),
        ("'''''A''''' is ''b''.", "A is b."),
        ("== Head ==\n\n* a\n** b\n\n<math>x^2</math>", "Head\n\n- a\n  - b\n\nx^2"),
        ("Say <i>yes</i>&nbsp;now<!-- x -->.", "Say yes\u00a0now."),
        ("```\nif a < b:\n    c\n```\n\nend", "    if a < b:\n        c\n\nend"),
        ("\\textbf{A} is $x$ and 5\\%.", "A is x and 5%."),
        ("It weighs {{convert|3|kg}} in all.", "It weighs 3 kg in all."),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "a | b\n1 | 2"),
        ("a<ref>source</ref> b", "a b"),
    ],
)
def test_clean_text(text, clean):
    assert markup.Cleaner().clean(text)[0] == clean


def test_wrappers():
    s = [markup.tokens_of(f"{{{{Box|name={n}|seat=[[{t}]]{x}}}}}") for n, t, x in (("A", "P", ""), ("B", "Q", "|area=5"), ("C", "R", ""))]
    w = wrappers.infer(s)
    assert wrappers.spelled(w) == "{{Box | name= # | seat= [[ # ]] (| area= #)? }}"
    assert wrappers.extract(w, s[1]) == [["name: B", "seat: Q", "area: 5"]]
    lists = [markup.tokens_of("<ul>" + "".join(f"<li>{x}</li>" for x in xs) + "</ul>") for xs in ("ab", "c", "defg")]
    w = wrappers.infer(lists)
    assert wrappers.spelled(w) == "<ul> (<li> # </li>)+ </ul>"
    assert wrappers.extract(w, lists[2]) == [["d"], ["e"], ["f"], ["g"]]
    assert wrappers.extract(w, s[0]) is None and wrappers.infer([]) is None


def test_record_by_wrapper():
    known = {"mediawiki {{Box": wrappers.infer_all([markup.tokens_of("{{Box|name=A|h=1}}"), markup.tokens_of("{{Box|name=B|h=2}}")])}
    assert markup.Cleaner(known).clean("{{Box|name=C|h=3}}")[0] == "name: C\nh: 3"


def test_table_of_texts(spark):
    rows = [(i, t) for i, t in enumerate(MARKED + PLAIN + [None, "x " * 50000, "[[a]] " * 5000])] + [(0, MARKED[0])]
    df = spark.createDataFrame(rows, "i int, text string").selectExpr("*", "1 AS markup", "2 AS blocks", "3 AS kind")
    out = markup.clean_texts(df, "text").collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"i", "text", "kind", "clean_text", "markup", "blocks"}
    for r in out:
        if r.i < len(MARKED):
            assert r.markup, r.text
        elif r.i < len(MARKED) + len(PLAIN):
            assert not r.markup and r.clean_text == r.text
    kinds = {b.kind for r in out for b in r.blocks}
    assert {"heading", "item", "code", "formula", "table", "text"} <= kinds
    assert markup.clean_texts(df.limit(0), "text").collect() == []


def test_wrappers_come_from_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(markup, "HELD", 1)
    box = lambda i, more="": f"{{{{Infobox\n| name = town {i}\n{more}| area = {i} km\n}}}}"
    rows = [(f"a{i}", f"a {i:04d}\n{box(i)}") for i in range(400)] + [(f"z{i}", f"z {i:04d}\n{box(i, f'| mayor = Olson {i}{chr(10)}')}") for i in range(3)]
    df = spark.createDataFrame(rows, "id string, text string")
    known = markup.infer_wrappers(df, "text")
    reader = markup.Cleaner()
    for _, text in rows:
        reader.blocks(text)
        assert all(any(wrappers.extract(w, stream) for w in known[host]) for host, stream in reader.records) and reader.records
    found = {r["id"]: r["clean_text"] for r in markup.clean_texts(df, "text").collect()}
    assert "mayor: Olson 2" in found["z2"] and "name: town 7" in found["a7"]


def test_long_and_deep_signs():
    for text in ("$x_{a} " + "+ b_1 " * 400 + "c$ end", "text\n\n" + " " * 14 + "* deep\n", "&#0000000065; x"):
        c = markup.Cleaner()
        assert c.clean(text)[0] != text and c.found, text[:30]


def test_order_of_streams_does_not_matter():
    odd = markup.tokens_of("<ul><p>x</p><b>y</b></ul>")
    good = [markup.tokens_of("<ul>" + "".join(f"<li>{x}</li>" for x in "abc"[: 1 + i % 3]) + "</ul>") for i in range(50)]
    first, last = wrappers.infer_all([odd, *good]), wrappers.infer_all([*good, odd])
    assert first == last
    assert all(any(wrappers.extract(w, s) is not None for w in first) for s in (odd, *good))
    rows = [markup.tokens_of(f"<table><tr class={c}><td>1</td></tr></table>") for c in "ab"]
    assert len(wrappers.infer_all(rows)) == 1


def test_rows_come_from_wrappers(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(MARKED + PLAIN + [None, ""])]
    df = spark.createDataFrame(rows, "i int, text string").selectExpr("*", "1 AS h", "2 AS host", "3 AS salt")
    found = sorted(r["i"] for r in markup.marked_rows(df.unionByName(df), ["i"], "text").collect())
    assert found == list(range(len(MARKED)))
    assert markup.marked_rows(df.limit(0), ["i"], "text").collect() == []
    monkeypatch.setattr(markup, "cover_hosts", lambda shapes: shapes.limit(0))
    assert markup.marked_rows(df, ["i"], "text").collect() == []


def test_shapes_of_a_host_in_groups(spark):
    texts = [f"{{{{Box {'|' + '|'.join(f'k{i}{j}= v' for j in range(i % 7)) if i % 7 else ''}}}}}" for i in range(120)]
    shapes = markup.host_shapes(markup.read_streams(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"], "text"))
    assert {r["h"] for r in markup.cover_hosts(shapes, aligned=5).collect()} == {r["h"] for r in shapes.collect()}
