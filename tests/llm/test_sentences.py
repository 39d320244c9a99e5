"""Sentence boundaries by a model trained on invented texts, on other texts."""

import random

import pytest

from annalith.llm import sentences

NAMES = ["Smith", "Brown", "Miller", "Olson", "Weber", "Carter"]
TOWNS = ["Norwich", "Leeds", "Hull", "Ripon"]


def english(r):
    return r.choice([
        f"Dr. {r.choice(NAMES)} went to {r.choice(TOWNS)}.", f"The mill was built in {r.randrange(1700, 1999)}.", f"They met Mr. {r.choice(NAMES)} at the river.", f"It lies {r.randrange(1, 90)}.{r.randrange(9)} km from {r.choice(TOWNS)}.",
        f"See No. {r.randrange(1, 99)} of the list.", "The road was closed at 6 p.m. and opened at dawn.", "They sold salt, etc.", "Who built the bridge?", "What a mill!", f"J. K. {r.choice(NAMES)} kept the keys... and left.", "\"Where is it?\" asked the clerk.",
        "The clerk wrote, \"It is lost.\"", "(It was closed in 1835.)", "Its motto is \"Stop! Look.\" in gold.", "It is near the mill.", "It has a river.", f"In spring the road by {r.choice(TOWNS)} is wet.",
    ])


def make(r, n):
    parts = [english(r) for _ in range(n)]
    text, ends = "", []
    for i, p in enumerate(parts):
        text += p
        ends.append(len(text))
        if i + 1 < n:
            text += "\n\n" if r.random() < 0.3 else " "
    return text, ends


@pytest.fixture(scope="module")
def model():
    r = random.Random(12)
    return sentences.train([make(r, 8)[0] for _ in range(400)])


def test_held_out_texts(model):
    r = random.Random(13)
    right = found = wanted = 0
    for _ in range(200):
        text, ends = make(r, 8)
        got = sentences.sentence_ends(text, model)
        right += len(set(got) & set(ends))
        found += len(got)
        wanted += len(ends)
    assert right > 0.97 * found and right > 0.97 * wanted


@pytest.mark.parametrize(
    "parts",
    [
        ["石桥在哪里？", "它很老。", "他说：“不出售。”", "“在哪里？”守门人问。"],
        ["なぜ重要なのか？", "「どこですか。」と番人が尋ねた。", "記録（第2.1版。未刊）には水路がある。"],
        ["पुल कहाँ है? ", "दीवार पर \"रुको! सुनो।\" लिखा है।"],
        ["«Стой! Кто идёт?» — написано на стене. ", "Какая башня!"],
        ["Sie sagte: „Die Chronik bleibt hier.“ ", "Warum?"],
        ["Que bonito! ", "¿Dónde está? ", "¡Qué torre!"],
        ["Πού είναι η αγορά; ", "Τι ωραία!"],
        ["Die Frage »Ist das alt?«, das fragte niemand. ", "Ja!"],
    ],
)
def test_marks_of_other_scripts(model, parts):
    ends, at = [], 0
    for p in parts:
        ends.append(at + len(p.rstrip()))
        at += len(p)
    assert sentences.sentence_ends("".join(parts), model) == ends


def test_layout(model):
    assert sentences.sentence_ends("สะพาน อยู่ที่นี่\nตลาด", model) == [5, 16, 21]
    assert sentences.sentence_ends("No mark here\n\nNext one", model) == [12, 22]
    assert sentences.sentence_ends(" \n lead. \r\n \r\nEnd", model) == [8, 17]
    assert sentences.sentence_ends("", model) == sentences.sentence_ends(" \n", model) == []
    assert sentences.sentence_ends("🙂 Hi!", model) == [5]


def test_split(spark, model):
    r = random.Random(14)
    rows = [(str(i), make(r, 5)[0]) for i in range(50)] + [("n", None), ("b", "  "), ("l", "It is near the mill. " * 5000)]
    df = spark.createDataFrame(rows + rows[:5], "rev_id string, content string").selectExpr("*", "1 AS id", "2 AS text", "3 AS end_pos")
    out = sorted(tuple(x) for x in sentences.split_sentences(df, "rev_id", "content", model).collect())
    assert out == sorted((i, e) for i, t in rows if t for e in sentences.sentence_ends(t, model))
    assert sentences.split_sentences(df, "rev_id", "content").count() > 5000
    assert sentences.split_sentences(df.limit(0), "rev_id", "content").collect() == []


def test_lexicon_has_all_texts(spark, model, monkeypatch):
    r = random.Random(15)
    texts = [make(r, 8)[0] for _ in range(120)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts + texts[:9])], "rev_id string, content string")
    monkeypatch.setattr(sentences, "HELD", 300)
    languages = sentences.count_languages(df, "content")
    assert languages == sentences.read_languages(texts + texts[:9])
    counted = sentences.count_lexicon(df, "content", languages).collect()
    whole = sentences.read_lexicon(texts, languages)
    assert {(x.language, x.token): (x.seen, x.marked, x.final, x.initial) for x in counted} == {
        k: (whole.seen[k], whole.marked[k], whole.final[k], whole.initial[k]) for k in {*whole.seen, *whole.marked, *whole.initial}
    }
    assert sentences.base_rates(spark.createDataFrame(counted)) == whole.base
    alone = sentences.train(texts + texts[:9])
    found = sorted(tuple(x) for x in sentences.split_sentences(df, "rev_id", "content").collect())
    assert found == sorted((str(i), e) for i, t in enumerate(texts + texts[:9]) for e in sentences.sentence_ends(t, alone))
    monkeypatch.setattr(sentences, "LABELLED", 10)  # the lexicon stays that of all texts
    few = {tuple(x) for x in sentences.split_sentences(df, "rev_id", "content").collect()}
    assert len(few & set(found)) > 0.9 * len(found)


def test_every_candidate_is_classified(model):
    """Without weights nothing is a boundary, not even what its context settles."""
    nothing = sentences.Model(model.lexicon, model.weights * 0, model.languages)
    assert sentences.sentence_ends("Who built it? He did.\n\nสะพาน", nothing) == []
    assert sentences.sentence_ends("สะพาน อยู่ที่นี่", nothing) == []


def test_marks_from_unicode_data(model):
    for parts in (["བོད་ཡིག།", " དེ་རིང་།", " ལྷ་ས།"], ["សួស្តី។", " តើអ្នកសុខសប្បាយទេ។"], ["ສະບາຍດີ", " ຂອບໃຈ"], ["Բարեւ։", " Ինչպես ես։"], ["မင်္ဂလာပါ။", " နေကောင်းလား။"]):
        text, ends = "", []
        for p in parts:
            text += p
            ends.append(len(text))
        assert sentences.sentence_ends(text, model) == ends, parts
    assert sentences.script_of("བོད་ཡིག") == "tibetan" and sentences.script_of("ქართული") not in sentences.CASED and "armenian" in sentences.CASED


def test_languages_from_the_corpus(spark):
    r = random.Random(16)
    words = {"en": "the of and in was a is its to at".split(), "de": "der die und im wurde ist nicht am das in".split(), "fr": "le la et les dans une fut est du des".split(), "ru": "и в на не что он".split()}
    texts = []
    for i in range(400):
        k = "en" if i % 2 else r.choice(list(words))
        texts.append((k, " ".join(r.choice(words[k]) if r.random() < 0.5 else r.choice("mill river town bridge road".split()) for _ in range(60))))
    df = spark.createDataFrame(texts + [("none", None), ("none", "")], "k string, content string")
    languages = sentences.count_languages(df, "content")
    assert languages == sentences.read_languages([t for _, t in texts])
    found = {(k, sentences.language_of(t, sentences.script_of(t) if k != "ru" else "cyrillic", languages)) for k, t in texts}
    assert len(found) == 4 and len({x for _, x in found}) == 4
    assert sentences.count_languages(df.limit(0), "content") == {}


def test_long_tokens_are_whole(model):
    word = "Zusammen" * 20
    c = next(c for c in sentences.candidates(f"Es war {word}. {word} war", 0, 2 * len(word) + 13, "latin") if c.mark)
    assert c.prev == word and c.next == word


def test_openers_without_closers(model):
    for opener in ('It has a 5" pipe', "It is a (draft", "It was in the ‘90s", "He said „yes", "See [(a) and (b"):
        text = opener + " there. The mill is old! It has a river (see No. 5). Who built the bridge?"
        ends = [i + 1 for i in range(len(text)) if text[i] in "!?" or text.startswith((". The", ". Who"), i)]
        assert sentences.sentence_ends(text, model) == ends, opener
    text = 'The mill is old." The road is long! It has a river.'
    assert sentences.sentence_ends(text, model) == [17, 35, len(text)]
    assert sentences.unclosed("(" * 20000 + ")", 0, 20001) == set(range(19999))
    assert sentences.unclosed('a ("b" [c]) "d', 0, 14) == {12}
