"""Sentence boundaries in texts of any language and script.

Candidates are sentence marks, closed quotations and brackets, ends of paragraphs, and in Thai and Lao every white space. Each
is decided by a maximum-entropy classifier over the neighbouring tokens, their case, length, digits and script. It is trained
on reliable boundaries: those that the layout or the context settles (a paragraph's end is one; a mark inside a word, number,
quotation or bracket, or before a comma, dash or small letter is none), marks before a word that starts paragraphs and is
otherwise written small, and marks between a token that always carries one but never ends a paragraph and a token that starts
none. What settles a candidate is one of its features; for the others the tokens count.

What tokens mean depends on the language. Languages of a script are told apart by the corpus: its frequent words fall into
groups, each led by a word that occurs in most texts in which the group's words do.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalith.session import checkpointed

#: The classifier's labelled rows are at most this many distinct contexts, those of smallest hash; the lexicon has all texts.
LABELLED = 40_000
#: Contexts a task gathers before it hands them on.
HELD = 500_000
WEIGHTS = 1 << 15
#: Characters on either side that make a context; repeated contexts count once.
CONTEXT = 14
#: The most frequent words of a script that make its languages, and the share of a word's texts in which its language's leader is.
FREQUENT_WORDS, LED = 600, 0.6
#: How far from a mark its tokens begin; a token is always taken whole.
NEAR = 40

# Marks that end sentences by the Unicode property Sentence_Terminal, and the shad of Tibetan; full stops, which
# may also stand elsewhere, are soft. What opens and closes passages.
HARD = "!?։؝؞؟۔܀܁܂߹।॥၊။።፧፨᙮។៕᠃᠉‼‽⁇⁈⁉⸮。꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫﹒﹖﹗！．？｡།༎༏༐༑"
SOFT = ".…"
CLOSE_OF = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "“": "”", "„": "“", "‘": "’", "«": "»", "»": "«", '"': '"', "‚": "‘", "‹": "›"}
QUOTES = set("“”„«»\"「」『』‘‹›")
TAIL = "\"'’”“»«)]）」』》〉】›"
#: First words of the Unicode names of letters that belong to a script of another name.
SCRIPT_NAMES = {"hiragana": "kana", "katakana": "kana", "halfwidth": "kana", "cjk": "han", "ideographic": "han", "fullwidth": "latin"}
#: Scripts in which white space parts sentences.
SPACED = {"thai", "lao"}


@lru_cache(maxsize=None)
def script_of_letter(ch: str) -> str:
    """The script of a letter, by its Unicode name; empty for what is no letter."""
    if unicodedata.category(ch) not in ("Lu", "Ll", "Lt", "Lo"):
        return ""
    first = re.split("[ -]", unicodedata.name(ch, "").lower())[0]
    return SCRIPT_NAMES.get(first, first)


#: Scripts whose sentences begin with a capital: those with capitals, but for Georgian, which has them for headlines only.
CASED = {script_of_letter(chr(i)) for i in range(0x10000) if unicodedata.category(chr(i)) == "Lu"} - {"georgian", ""}


def _combining() -> str:
    """The combining marks of the basic plane as ranges for a character class; they belong to words."""
    out, start = "", 0
    for i in range(0x300, 0x10000):
        mark = unicodedata.category(chr(i)) in ("Mn", "Mc")
        if mark and not start:
            start = i
        elif not mark and start:
            out += f"{chr(start)}-{chr(i - 1)}"
            start = 0
    return out


_L = f"[\\w{_combining()}]"
#: Runs of letters and marks, in a form that Java reads alike.
FREQUENT = re.compile(r"[a-zß-öø-ɏͰ-ϿЀ-ԯ\u0600-\u06ffऀ-ॿ]{1,20}")
#: Scripts of several languages whose words are told apart, with their names in regular expressions.
MANY_LANGUAGES = {"latin": "IsLatin", "greek": "IsGreek", "cyrillic": "IsCyrillic", "arabic": "IsArabic", "devanagari": "IsDevanagari"}
WORD = re.compile(rf"{_L}+(?:[.'’\-]{_L}+)*")
#: The last token, with the short parts of an abbreviation before it.
LAST_WORD = re.compile(rf"(?:(?<![^\W_])[^\W\d_]\.\s?)+[^\W\d_]$|{_L}+(?:[.'’\-]{_L}+)*$")
EVENT = re.compile("[" + re.escape(HARD + SOFT + ";" + "".join(set(CLOSE_OF) | set(CLOSE_OF.values()))) + "]")
PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\r?\n[^\S\n]*)+")


def script_of(text: str) -> str:
    """The script with the most letters; Japanese counts as kana if there is any. Latin without letters."""
    n: Counter = Counter()
    for ch, k in Counter(text).items():
        n[script_of_letter(ch)] += k
    del n[""]
    if n["kana"]:
        n["kana"] += n["han"]
    return min(n, key=lambda k: (-n[k], k)) if n.total() else "latin"


#: Groups of words for each script, one for each language.
Languages = dict[str, list[frozenset]]


def group_words(texts_with: dict[str, int], texts_with_both: dict[tuple[str, str], int]) -> Languages:
    """Languages from the numbers of texts that have each frequent word, and each two of them (in either order).

    A word that several languages share can't lead one: of the frequent words whose texts mostly have it, a fifth of the pairs
    or more hardly ever meet. Of the others the most frequent word of a script leads a language; so does the next one that is in
    less than half the texts of every leader so far, and they in less than half of its own. A word belongs to the leader that most
    of its texts have, if enough have it.
    """
    ordered = sorted(texts_with, key=lambda w: (-texts_with[w], w))
    at = {w: i for i, w in enumerate(ordered)}
    n = np.array([texts_with[w] for w in ordered])
    met = np.zeros((len(n), len(n)))
    for (a, b), k in texts_with_both.items():
        met[at[a], at[b]] = met[at[b], at[a]] = k
    apart = 50 * met < np.minimum.outer(n, n)
    both = lambda a, b: met[at[a], at[b]]

    def is_shared(w: str) -> bool:
        i = at[w]
        with_it = np.flatnonzero((20 * n >= n[i]) & (met[i] >= LED * n))
        pairs = len(with_it) * (len(with_it) - 1)
        return pairs > 0 and (apart[np.ix_(with_it, with_it)].sum() - apart[with_it, with_it].sum()) >= pairs / 5

    leaders: dict[str, list[str]] = {}
    for w in ordered:
        led = leaders.setdefault(script_of(w), [])
        if not is_shared(w) and all(2 * both(w, x) < min(texts_with[w], texts_with[x]) for x in led):
            led.append(w)
    out: Languages = {}
    for script, led in leaders.items():
        groups: dict[str, set] = {x: {x} for x in led}
        for w in ordered:
            if led and script_of(w) == script and w not in groups:
                best = max(led, key=lambda x: both(w, x))
                if both(w, best) >= LED * texts_with[w]:
                    groups[best].add(w)
        out[script] = [frozenset(g) for g in groups.values() if len(g) >= 3]
    return out


def language_of(text: str, script: str, languages: Languages) -> str:
    """The script, with the number of its language of which the text has most words; the script alone if it has none."""
    groups = languages.get(script, ())
    if len(groups) < 2:
        return script
    words = Counter(FREQUENT.findall(text.lower()))
    score = [sum(words[w] for w in g if w in words) for g in groups]
    best = max(range(len(groups)), key=lambda k: score[k])
    return f"{script} {best}" if score[best] else script


def read_languages(texts: Iterable[str]) -> Languages:
    sets = [set(FREQUENT.findall(t.lower())) for t in texts if t]
    counts = Counter(w for x in sets for w in x)
    some: dict[str, list[str]] = {}
    for w in sorted(counts, key=lambda w: (-counts[w], w)):
        held = some.setdefault(script_of(w), [])
        if len(held) < FREQUENT_WORDS:
            held.append(w)
    chosen = {w for held in some.values() for w in held}
    both = Counter(pair for x in sets for pair in combinations(sorted(x & chosen), 2))
    return group_words({w: counts[w] for w in chosen}, both)


def count_languages(df: DataFrame, text: str) -> Languages:
    """``read_languages`` of all texts of ``df``, counted by Spark.

    A task adds up which of the frequent words meet in a text; those counts, of a fixed number of words, reach the driver.
    """
    pattern = FREQUENT.pattern
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))
    sets = df.where(F.col(text).isNotNull()).select(words.alias("words"))
    script = F.lit("other")
    for name, block in MANY_LANGUAGES.items():
        script = F.when(F.col("word").rlike(rf"^\p{{{block}}}"), name).otherwise(script)
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).withColumn("script", script)
    order = Window.partitionBy("script").orderBy(F.desc("n"), "word")
    top = counts.where("script <> 'other'").withColumn("r", F.row_number().over(order)).where(F.col("r") <= FREQUENT_WORDS).collect()
    if not top:
        return {}
    words_of: dict[str, list[str]] = {}
    for r in top:
        words_of.setdefault(r["script"], []).append(r["word"])

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = FREQUENT.findall
        place = {w: (k, i) for k, held in words_of.items() for i, w in enumerate(held)}
        met = {k: np.zeros((len(held), len(held))) for k, held in words_of.items()}
        for batch in batches:
            rows: dict[str, list[list[int]]] = {k: [] for k in words_of}
            for text in batch.column(0).to_pylist():
                mine: dict[str, list[int]] = {}
                for w in set(find(text.lower())) & place.keys():
                    mine.setdefault(place[w][0], []).append(place[w][1])
                for k, at in mine.items():
                    rows[k].append(at)
            for k, sets in rows.items():
                has = np.zeros((len(sets), len(words_of[k])), np.float32)
                for i, at in enumerate(sets):
                    has[i, at] = 1
                met[k] += has.T @ has
        for k, n in met.items():
            a, b = np.nonzero(np.triu(n, 1))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n[a, b].astype(np.int64))], ["script", "a", "b", "n"])

    found = df.where(F.col(text).isNotNull()).select(text).mapInArrow(meetings, "script string, a int, b int, n long").groupBy("script", "a", "b").agg(F.sum("n").alias("n"))
    enough = F.lit(False)  # those that hardly ever meet count as never
    for k in words_of:
        n_of = F.array(*(F.lit(r["n"]) for r in top if r["script"] == k))
        enough = F.when(F.col("script") == k, 50 * F.col("n") >= F.least(F.get(n_of, F.col("a")), F.get(n_of, F.col("b")))).otherwise(enough)
    both = {(words_of[r["script"]][r["a"]], words_of[r["script"]][r["b"]]): r["n"] for r in found.where(enough).collect()}
    return group_words({r["word"]: r["n"] for r in top}, both)


def kind(ch: str) -> str:
    """The class of a character that follows a candidate."""
    if not ch:
        return "end"
    if ch.islower():
        return "lower"
    if ch.isupper() or ch.istitle():
        return "upper"
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        return "caseless"
    if ch in "¡¿":
        return "upper"
    if ch in CLOSE_OF or ch in "'":
        return "open"
    if ch in ",;:،؛、，；：-–—/%&=+":
        return "goes on"
    return "other"


@dataclass
class Candidate:
    end: int  # where the sentence would end
    sure: bool | None  # settled, or None
    prev: str = ""
    before: str = ""  # the token before prev
    next: str = ""
    next_kind: str = ""
    mark: str = ""
    gap: str = ""


def _next(text: str, at: int, stop: int) -> tuple[str, str, str]:
    """(white space, class, token) of what follows ``at``; the token is looked for behind opening marks."""
    i = at
    while i < stop and text[i].isspace():
        i += 1
    m = WORD.search(text, i, stop) if i < stop else None
    return text[at:i], kind(text[i : i + 1] if i < stop else ""), m.group() if m and m.start() < i + NEAR else ""


def _before(text: str, begun: int, at: int) -> tuple[str, str]:
    """The last token before ``at`` and the one before that, not from before ``begun``."""
    low = max(begun, at - 10 * NEAR)
    while low > begun and not text[low - 1].isspace():
        low -= 1
    head = text[low:at].rstrip(TAIL + " ")
    start = len(head)
    for _ in range(3):  # an abbreviation may have a space inside
        start = max(head.rfind(" ", 0, start), head.rfind("\n", 0, start), head.rfind("\t", 0, start), 0)
    near = head[start:]
    last = LAST_WORD.search(near)
    before = LAST_WORD.search((near[: last.start()] if last else near).rstrip().rstrip("."))
    return last.group() if last else "", before.group() if before else ""


def candidates(text: str, start: int, stop: int, script: str) -> Iterator[Candidate]:
    """The candidates of the paragraph text[start:stop], in order; its end comes last. ``sure`` may be None."""
    if script in SPACED:
        for m in re.finditer(r"\s+", text[start:stop]):
            yield Candidate(start + m.start(), True)
        yield Candidate(stop, True)
        return
    cased = script in CASED
    stack: list[tuple[str, int, bool]] = []  # closing mark, where it opened, whether a quotation
    begun = start  # where the sentence in hand began, as far as settled candidates tell
    skip = start
    plain = unclosed(text, start, stop)
    for m in EVENT.finditer(text, start, stop):
        i, ch = m.start(), m.group()
        if i < skip:
            continue
        if stack and ch == stack[-1][0]:
            closing, opened, quote = stack.pop()
            if stack:
                continue
            inner = text[i - 1 : i] if not text[i - 1 : i].isspace() else text[opened:i].rstrip()[-1:]
            end = i + 1
            if (inner in HARD or inner in SOFT or inner == ";" and script == "greek") and inner:
                while end < stop and text[end] in ")]）":
                    end += 1
                gap, what, word = _next(text, end, stop)
                lead = text[begun:opened].strip()
                if what == "end":
                    continue  # the paragraph's end
                if not gap and what in ("lower", "goes on") or what in ("lower", "goes on", "other") or text[end : end + 1] in HARD + SOFT:
                    sure = False
                elif not lead or lead.rstrip(TAIL)[-1:] in HARD + SOFT:  # the passage began the sentence
                    sure = not quote or (what in ("upper", "digit", "open") if cased else what == "open")
                elif lead[-1] in ":：" or cased and lead[-1] in ",،":
                    sure = True
                else:
                    sure = cased and quote and what in ("upper", "open") and bool(gap)
                if not gap and cased:
                    sure = False
                if sure:
                    begun = end
                yield Candidate(end, sure, next_kind=what, mark=inner, gap="space" if gap else "none")
            continue
        if ch in CLOSE_OF and i not in plain and _opens(text, i, ch):
            stack.append((CLOSE_OF[ch], i, ch in QUOTES))
            continue
        if stack or not (ch in HARD or ch in SOFT or ch == ";" and script == "greek"):
            continue
        end = i + 1
        while end < stop and text[end] in HARD + SOFT:
            end += 1
        mark = text[i:end]
        while end < stop and text[end] in TAIL and not (text[end] in CLOSE_OF and end not in plain and _opens(text, end, text[end])):
            end += 1
        skip = end
        gap, what, word = _next(text, end, stop)
        if what == "end":
            continue
        hard = any(c in HARD for c in mark) or ch == ";"
        if not gap and not (hard and not cased) and not (hard and what in ("open",)):
            sure: bool | None = False
        elif what in ("lower", "goes on", "other"):
            sure = False
        elif hard:
            sure = True
        else:
            sure = None
        prev, before = _before(text, begun, i) if sure is None or what == "lower" else ("", "")
        c = Candidate(end, sure, prev, before, word, what, mark, "line" if "\n" in gap else "space" if len(gap) == 1 else "wide" if gap else "none")
        if sure:
            begun = end
        yield c
    yield Candidate(stop, True)


def unclosed(text: str, start: int, stop: int) -> set[int]:
    """Where the paragraph has opening marks that nothing closes; they are text like other signs. Innermost ones are found first."""
    events = [(m.start(), m.group()) for m in EVENT.finditer(text, start, stop)]
    last = {ch: i for i, ch in events}
    plain = {i for i, ch in events if ch in CLOSE_OF and last.get(CLOSE_OF[ch], -1) <= i}
    at, stack = 0, []  # places in events
    while True:
        for k in range(at, len(events)):
            i, ch = events[k]
            if stack and ch == CLOSE_OF[events[stack[-1]][1]]:
                stack.pop()
            elif ch in CLOSE_OF and i not in plain and _opens(text, i, ch):
                stack.append(k)
        if not stack:
            return {i for i in plain if _opens(text, i, text[i])}
        kind = events[stack[-1]][1]
        while stack and events[stack[-1]][1] == kind:  # none of them is closed without the others either
            at = stack.pop()
            plain.add(events[at][0])


def _opens(text: str, i: int, ch: str) -> bool:
    """Whether a mark that can open a passage does so here."""
    if ch in "‘»":  # also an apostrophe, and a closing mark
        before = text[i - 1 : i]
        return (not before or before.isspace() or before in "([„“«") and not text[i + 1 : i + 2].isspace()
    if ch == "“":
        return True
    return True


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between empty lines, without the white space around them."""
    at = 0
    for m in [*PARAGRAPH.finditer(text), None]:
        stop = m.start() if m else len(text)
        part = text[at:stop]
        start, end = at + len(part) - len(part.lstrip()), at + len(part.rstrip())
        if start < end:
            yield start, end
        at = m.end() if m else len(text)


@dataclass
class Lexicon:
    """What texts tell of tokens, by language."""

    marked: Counter = field(default_factory=Counter)  # before a soft mark
    final: Counter = field(default_factory=Counter)  # before a soft mark at a paragraph's end
    seen: Counter = field(default_factory=Counter)
    initial: Counter = field(default_factory=Counter)  # first of a paragraph
    base: dict = field(default_factory=dict)  # by language, how often a soft mark is at a paragraph's end

    def of_prev(self, language: str, token: str) -> str:
        key = (language, shape_or(token))
        return prev_class(self.marked[key], self.final[key], self.base.get(language, 0.1))

    def always_marked(self, language: str, token: str) -> bool:
        key = (language, shape_or(token))
        return self.marked[key] >= 0.9 * self.seen[key]

    def of_next(self, language: str, token: str) -> str:
        return next_class(token, self.seen[(language, token.lower())], self.seen[(language, token)], self.initial[(language, token)])


def prev_class(marked: int, final: int, base: float) -> str:
    if not marked:
        return "new"
    expected = marked * max(base, 0.02)
    if final == 0:
        return "never" if expected >= 2 else "rarely" if marked >= 4 else "seldom"
    return "often" if final >= expected / 4 else "now and then"


def next_class(token: str, low: int, seen: int, initial: int) -> str:
    if not token:
        return "none"
    if token != token.lower() and low:
        return "starter" if initial else "common"
    return ("starts" if initial else "named" if seen >= 4 else "scarce") if seen else "new"


def shape_or(token: str) -> str:
    """A token as the lexicon keys it: numbers by their length, single capitals as one."""
    token = "".join(token.split())
    if token.isdigit():
        return f"#{min(len(token), 4)}"
    if any(c.isdigit() for c in token):
        return "#mixed"
    return "^" if token.isupper() and all(len(x) == 1 for x in token.split(".")) else token


def features(c: Candidate, script: str, lexicon: Lexicon) -> list[int]:
    """The classifier's features as places of the weight vector."""
    if c.sure is not None:
        return settled_places(script, c.sure, c.mark[:1], c.next_kind, c.gap)
    return places(c, script, lexicon.of_prev(script, c.prev), lexicon.always_marked(script, c.prev), lexicon.of_next(script, c.next))


def settled_places(script: str, sure: bool, mark: str, next_kind: str, gap: str) -> list[int]:
    """The features of a candidate that its context settles; what settles it is among them."""
    names = (f"settled {sure}", f"sm {sure} {mark}", f"sk {sure} {next_kind}", f"sg {sure} {gap} {mark}", f"ss {sure} {script}")
    return [zlib.crc32(x.encode()) % WEIGHTS for x in names]


def places(c: Candidate, language: str, prev: str, always: bool, nxt: str) -> list[int]:
    p = c.prev
    shape = "digits" if p.isdigit() else "single" if shape_or(p) == "^" or len(p) == 1 else "inner" if "." in p else "upper" if p[:1].isupper() else "lower"
    names = (
        "bias", f"p {prev}", f"pl {prev} {language}", f"w {language} {shape_or(p)}", f"always {always} {prev}",
        f"s {shape} {min(len(p), 6)}", f"sn {shape} {c.next_kind}", f"n {c.next_kind} {language}", f"x {nxt} {language}", f"pn {prev} {nxt}",
        f"v {language} {c.next}", f"wv {shape_or(p)} {c.next_kind}", f"b {before_class(c.before)} {prev}",
        f"m {c.mark[:2]} {language}", f"g {c.gap}", f"gn {c.mark[:2]} {c.next_kind}",
    )
    return [zlib.crc32(x.encode()) % WEIGHTS for x in names]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    languages: Languages

    def decide(self, c: Candidate, language: str) -> bool:
        return float(self.weights[features(c, language, self.lexicon)].sum()) > 0


def contexts(text: str, languages: Languages, known: set | None = None) -> Iterator[tuple[int, str, str, str]]:
    """(kind, language, token, context) of a text's tokens: 0 seen, 1 before a soft mark, 2 so at a paragraph's end, 3 first of a paragraph.

    Paragraphs that are in ``known`` are passed over, others are added to it.
    """
    language = language_of(text, script_of(text), languages)
    for start, stop in paragraphs(text):
        if known is not None:
            key = (language, text[start : stop + CONTEXT], stop - start)
            if key in known:
                continue
            known.add(key)
        first = True
        for m in WORD.finditer(text, start, stop):
            w = m.group()
            context = text[max(start, m.start() - CONTEXT) : m.end() + CONTEXT]
            shape = shape_or(w)
            yield 0, language, shape, context
            if w != shape:
                yield 0, language, w, context
            if first:
                yield 3, language, w, ""
                first = False
        for m in re.finditer(r"[.…]+(?=[^\w]|$)", text[start:stop]):
            at = start + m.start()
            last = _before(text, start, at)[0] if text[at - 1 : at] not in TAIL + " " else ""
            if last:
                yield 1 + (start + m.end() == stop), language, shape_or(last), text[max(start, at - len(last) - CONTEXT) : start + m.end() + CONTEXT]


def lexicon_of(rows: Iterable[tuple[str, str, int, int, int, int]], ends: dict[str, tuple[int, int]]) -> Lexicon:
    """From (language, token, seen, marked, final, initial), and each language's (final, marked) over all tokens."""
    lexicon = Lexicon(base={k: final / marked for k, (final, marked) in ends.items() if marked})
    for language, token, *counts in rows:
        for counter, n in zip((lexicon.seen, lexicon.marked, lexicon.final, lexicon.initial), counts):
            if n:
                counter[(language, token)] = n
    return lexicon


def read_lexicon(texts: list[str], languages: Languages) -> Lexicon:
    """Counts over distinct contexts, since revisions of a page repeat their sentences."""
    counts: dict[tuple[str, str], list[int]] = {}
    ends: dict[str, list[int]] = {}
    known: set = set()
    for kind, language, token, _ in {x for t in texts for x in contexts(t, languages, known)}:
        n = counts.setdefault((language, token), [0, 0, 0, 0])
        n[(0, 1, 2, 3)[kind]] += 1
        if kind == 2:
            n[1] += 1
        if kind in (1, 2):
            e = ends.setdefault(language, [0, 0])
            e[0] += kind == 2
            e[1] += 1
    return lexicon_of(((*k, *n) for k, n in counts.items()), ends)


def count_lexicon(df: DataFrame, text: str, languages: Languages) -> DataFrame:
    """language, token, seen, marked, final, initial over all texts of ``df``, as ``read_lexicon`` counts them.

    A task hands on each context once; contexts of a token are told apart by 64 bits.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        found: set = set()

        def handed_on() -> pa.RecordBatch:
            columns = zip(*found) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string()))], ["kind", "language", "token", "context"])

        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(contexts(t, languages, known))
                if len(found) > HELD:
                    yield handed_on()
                    found.clear()
                    known.clear()
        yield handed_on()

    rows = df.where(F.col(text).isNotNull()).select(text).mapInArrow(read, "kind int, language string, token string, context string")
    each = rows.select("kind", "language", "token", F.xxhash64("context").alias("context")).distinct()
    n = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    return each.groupBy("language", "token").agg(n("kind = 0", "seen"), n("kind IN (1, 2)", "marked"), n("kind = 2", "final"), n("kind = 3", "initial"))


#: What a row is for: a settled candidate, an open one, and those that are for training alone.
SETTLED, OPEN, LAST, HIDDEN = range(4)


def read_candidates(text: str, languages: Languages) -> Iterator[tuple[int, Candidate, str, str]]:
    """(what it is for, candidate, language, context) of a text's candidates and training examples.

    LAST is the mark at a paragraph's end with what follows it, a reliable boundary; HIDDEN a mark before a small letter, which
    is reliably none, without what follows it.
    """
    script = script_of(text)
    language = language_of(text, script, languages)
    spans = list(paragraphs(text))
    for k, (start, stop) in enumerate(spans):
        for c in candidates(text, start, stop, script):
            context = text[max(start, c.end - CONTEXT) : c.end + CONTEXT]
            yield (OPEN if c.sure is None else SETTLED), c, language, context
            if c.sure is False and c.next_kind == "lower" and c.gap != "none" and c.prev:
                yield HIDDEN, Candidate(c.end, None, c.prev, c.before, "", "hidden", c.mark, c.gap), language, context
        tail = re.search(r"([.…]+)[" + re.escape(TAIL) + r"]*$", text[max(start, stop - NEAR) : stop])
        if tail and k + 1 < len(spans) and script not in SPACED:
            _, what, word = _next(text, *spans[k + 1])
            prev = _before(text, start, max(start, stop - NEAR) + tail.start())
            context = text[max(start, stop - CONTEXT) : spans[k + 1][0] + CONTEXT]
            yield LAST, Candidate(stop, None, *prev, word, what, tail.group(1), "space"), language, context


def label_of(use: int, prev: str, always: bool, nxt: str, base: float) -> int | None:
    """Whether a training example is a boundary, as far as that is reliable; ``base`` is how often marks end paragraphs there."""
    if use == LAST:
        return 1
    if use == HIDDEN or not base:
        return 0  # where no paragraph ends in a full stop, other marks end sentences
    if prev in ("never", "rarely") and always and nxt in ("named", "scarce", "new"):
        return 0
    return 1 if nxt == "starter" else None


def train(texts: list[str], rounds: int = 150, decay: float = 1e-4) -> Model:
    """Fit on reliable boundaries of ``texts``, with the lexicon of the same texts."""
    languages = read_languages(texts)
    lexicon = read_lexicon(texts, languages)
    settled: Counter = Counter()
    examples: dict[tuple[int, str], tuple] = {}
    for text in texts:
        for use, c, script, context in read_candidates(text, languages):
            if use == SETTLED:
                settled[(script, c.sure, c.mark[:1], c.next_kind, c.gap)] += 1
            else:
                row = (script, c.prev, before_class(c.before), c.next, c.next_kind, c.mark[:2], c.gap)
                examples[(use, context)] = min(row, examples.get((use, context), row))
    rows: list[tuple[list[int], int, int]] = []
    for (use, _), (script, prev, before, nxt, what, mark, gap) in examples.items():
        classes = lexicon.of_prev(script, prev), lexicon.always_marked(script, prev), lexicon.of_next(script, nxt)
        label = label_of(use, *classes, lexicon.base.get(script, 1))
        if label is not None:
            rows.append((places(Candidate(0, None, prev, before, nxt, what, mark, gap), script, *classes), label, 1))
    return Model(lexicon, fit_weights(rows + settled_rows(settled.items()), rounds, decay), languages)


def settled_rows(counts: Iterable[tuple[tuple, int]]) -> list[tuple[list[int], int, int]]:
    return [(settled_places(script, sure, mark, what, gap), int(sure), n) for (script, sure, mark, what, gap), n in counts]


def before_class(token: str) -> str:
    """What counts of the token before the last: whether it begins with a digit."""
    return "1" if token[:1].isdigit() else ""


def fit_weights(rows: list[tuple[list[int], int, int]], rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on (features, label, count), full-batch, with adaptive steps and a quadratic penalty.

    Settled and open candidates share no feature, so each kind is balanced by itself. Without rows of a kind its candidates are
    decided as their context says, and open ones are boundaries.
    """
    weights = np.zeros(WEIGHTS + 1)  # the last place fills rows of fewer features and stays 0
    for sure in (True, False):
        weights[zlib.crc32(f"settled {sure}".encode()) % WEIGHTS] = 1.0 if sure else -1.0
    width = max((len(x) for x, _, _ in rows), default=0)
    merged: Counter = Counter()
    for x, label, n in rows:
        merged[(tuple(x + [WEIGHTS] * (width - len(x))), label)] += n
    groups = [[(x, y, n) for (x, y), n in merged.items() if (x[-1] == WEIGHTS) == settled] for settled in (True, False)]
    if not groups[1]:
        weights[zlib.crc32(b"bias") % WEIGHTS] = 1.0
    for group in groups:
        if not group:
            continue
        x, y, n = (np.array(v) for v in zip(*group))
        positive, total = (n * y).sum(), n.sum()
        share = n * np.where(y > 0, total / max(2 * positive, 1), total / max(2 * (total - positive), 1)) / total
        used = np.unique(x)
        grown = np.full(WEIGHTS + 1, 1e-8)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(weights[x].sum(1), -30, 30)))
            g = np.bincount(x.ravel(), np.repeat(share * (p - y), x.shape[1]), WEIGHTS + 1)[used] + decay * weights[used]
            grown[used] += g * g
            weights[used] -= 0.3 * g / np.sqrt(grown[used])
            weights[WEIGHTS] = 0
    return weights


def sentence_ends(text: str, model: Model) -> list[int]:
    """Numbers of characters up to and with the last one of each sentence."""
    if not text or text.isspace():
        return []
    script = script_of(text)
    language = language_of(text, script, model.languages)
    ends: list[int] = []
    for start, stop in paragraphs(text):
        for c in candidates(text, start, stop, script):
            if c.end > start and (not ends or c.end > ends[-1]) and model.decide(c, language):
                ends.append(c.end)
    return ends


def split_sentences(df: DataFrame, ident: str, text: str, model: Model | None = None) -> DataFrame:
    """``ident``, end_pos: one row for each sentence, with the number of characters up to and with its last one.

    Null and blank texts have no sentence. Repeated rows count once; if an identifier has several texts, its rows are those
    of all of them; a null identifier is one like others. Extra columns are ignored. Without ``model`` one is fitted:
    its lexicon on all texts, its weights on LABELLED contexts.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text"))
    kind_of = df.schema[ident].dataType.simpleString()
    if model is None:
        return _split_with_own_lexicon(rows).distinct().select(F.col("id").cast(kind_of).alias(ident), "end_pos")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids: list = []
            ends: list[int] = []
            for i, t in zip(frame["id"], frame["text"]):
                found = sentence_ends(t, shared.value)
                ids += [i] * len(found)
                ends += found
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "end_pos": pd.Series(ends, dtype="int32")})

    return rows.mapInPandas(split, "id string, end_pos int").distinct().select(F.col("id").cast(kind_of).alias(ident), "end_pos")


_KEY = ["language", "prev", "before", "next", "next_kind", "mark", "gap"]
_COUNTS = ["n_marked", "n_final", "n_seen", "n_next", "n_initial", "n_low"]


def candidate_rows(rows: DataFrame, languages: Languages) -> DataFrame:
    """id, end_pos, use, sure, language and tokens of all candidates of ``rows`` (id, text), and training examples, which a task
    hands on once for each context; ``context`` is a hash. Settled candidates carry no tokens."""
    names = ["id", "end_pos", "use", "sure", *_KEY, "token", "low", "context"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), *[pa.string()] * (len(_KEY) + 2), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or text.isspace():
                    continue
                last = 0
                for use, c, script, context in read_candidates(text, languages):
                    if use == SETTLED:
                        if c.end > last:
                            out.append((i, c.end, use, c.sure, script, None, None, None, c.next_kind, c.mark[:1], c.gap, None, None, None))
                        continue
                    h = int.from_bytes(hashlib.blake2b(f"{use} {context}".encode(), digest_size=8).digest(), "big", signed=True)
                    if use != OPEN:
                        if h in known:
                            continue
                        known.add(h)
                    out.append((i, c.end, use, None, script, c.prev, before_class(c.before), c.next, c.next_kind, c.mark[:2], c.gap, shape_or(c.prev), c.next.lower(), h))
            if len(known) > HELD:
                known.clear()
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    kinds = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.int64(): "long"}
    return rows.select("id", "text").mapInArrow(read, ", ".join(f"`{n}` {kinds[t]}" for n, t in zip(names, types)))


def with_counts(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` of open candidates and examples with what the lexicon says of their tokens, joined."""
    of = lambda key, **columns: counted.select("language", F.col("token").alias(key), *(F.col(c).alias(n) for n, c in columns.items()))
    for part in (of("token", n_marked="marked", n_final="final", n_seen="seen"), of("next", n_next="seen", n_initial="initial"), of("low", n_low="seen")):
        rows = rows.join(part, ["language", part.columns[1]], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in _COUNTS})


def classes_of(nxt: str, marked: int, final: int, seen: int, n: int, initial: int, low: int, base: float) -> tuple[str, bool, str]:
    return prev_class(marked, final, base), marked >= 0.9 * seen, next_class(nxt, low, n, initial)


_SETTLED = ["language", "sure", "mark", "next_kind", "gap"]


def settled_kinds(settled: DataFrame) -> list[tuple[tuple, int]]:
    """The features of settled candidates and how many have them; there are at most languages x marks x classes of these."""
    return sorted((tuple(r[:5]), r["n"]) for r in settled.groupBy(*_SETTLED).agg(F.count("*").alias("n")).collect())


def fit_rows(settled: list[tuple[tuple, int]], examples: DataFrame, base: dict[str, float], most: int) -> np.ndarray:
    """The weights, from the counts of settled candidates by their features (see ``settled_kinds``), and of the distinct contexts
    of ``examples`` (see ``with_counts``) at most ``most``, those of smallest hash; so they don't depend on row order."""
    each = examples.groupBy("use", "context").agg(F.min(F.struct(*_KEY, *_COUNTS)).alias("x")).withColumn("h", F.pmod(F.xxhash64("context"), F.lit(1 << 30)))
    n = examples.agg(F.approx_count_distinct("context")).first()[0]
    some = each.where(F.col("h") < min(1 << 30, -(-3 * most * (1 << 30) // max(n, 1)))).orderBy("h", "context", "use").limit(most)
    rows = []
    for r in some.select("use", "x.*").collect():
        script, prev, before, nxt, what, mark, gap, *counts = r[1:]
        classes = classes_of(nxt, *counts, base.get(script, 0.1))
        label = label_of(r["use"], *classes, base.get(script, 1))
        if label is not None:
            rows.append((places(Candidate(0, None, prev, before, nxt, what, mark, gap), script, *classes), label, 1))
    return fit_weights(rows + settled_rows(settled))


def base_rates(counted: DataFrame) -> dict[str, float]:
    """By script, how often a soft mark is at a paragraph's end."""
    sums = counted.groupBy("language").agg(F.sum("final").alias("f"), F.sum("marked").alias("m")).collect()
    return {r["language"]: r["f"] / r["m"] for r in sums if r["m"]}


def _split_with_own_lexicon(rows: DataFrame, most: int | None = None) -> DataFrame:
    """id, end_pos. Candidates and examples are read once and joined with the lexicon of all texts; only the weights are broadcast.

    A later candidate of a text always ends later, so each is decided by itself.
    """
    languages = count_languages(rows, "text")
    counted = checkpointed(count_lexicon(rows, "text", languages))
    found = checkpointed(candidate_rows(rows, languages))
    settled, joined = found.where(F.col("use") == SETTLED), checkpointed(with_counts(found.where(F.col("use") != SETTLED), counted))
    base = base_rates(counted)
    kinds = settled_kinds(settled)
    weights = fit_rows(kinds, joined, base, LABELLED if most is None else most)
    shared = rows.sparkSession.sparkContext.broadcast((weights, base))
    # candidates of equal features are decided alike, so settled ones are decided by their few kinds
    ends = [k for k, _ in kinds if float(weights[settled_places(*k)].sum()) > 0]
    of_kind = rows.sparkSession.createDataFrame(ends, "language string, sure boolean, mark string, next_kind string, gap string")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, base = shared.value
        known: dict[tuple, bool] = {}
        for b in batches:
            keep = []
            if len(known) > HELD:
                known.clear()
            for key in zip(*(b.column(k).to_pylist() for k in range(2, b.num_columns))):
                if key not in known:
                    language, prev, before, nxt, what, mark, gap, *counts = key
                    at = places(Candidate(0, None, prev, before, nxt, what, mark, gap), language, *classes_of(nxt, *counts, base.get(language, 0.1)))
                    known[key] = float(weights[at].sum()) > 0
                keep.append(known[key])
            yield b.filter(pa.array(keep, pa.bool_())).select(["id", "end_pos"])

    by_kind = settled.join(F.broadcast(of_kind), _SETTLED, "left_semi").select("id", "end_pos")
    opened = joined.where(F.col("use") == OPEN).select("id", "end_pos", *_KEY, *_COUNTS)
    return by_kind.unionByName(opened.mapInArrow(decide, "id string, end_pos int"))
