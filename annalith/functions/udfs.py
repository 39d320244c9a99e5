"""Functions that need Python: HTML, stems, and differences of texts. Vectorised."""

from __future__ import annotations

import difflib
import re
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalith import constants as C

STRINGS = T.ArrayType(T.StringType())


class _Text(HTMLParser):
    BLOCK = {"p", "div", "br", "li", "tr", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "section", "article"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        if tag in self.BLOCK:
            self.out.append("\n")
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.hrefs.append(href)

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.silent:
            self.silent -= 1
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def html_to_text(page: str) -> str:
    p = _Text()
    p.feed(page)
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def page_urls(page: str, base: str) -> list[str]:
    """Absolute addresses of a page's anchors in order; what can't be resolved is left out."""
    base = base[: -len("index.html")] if base.endswith("index.html") else base + "/"
    p = _Text()
    p.feed(page)
    out = []
    for href in p.hrefs:
        try:
            url = urljoin(base, href.strip())
            if urlsplit(url).scheme:
                out.append(url)
        except ValueError:
            continue
    return out


class _Links(HTMLParser):
    """Anchors of the paragraphs directly under the root, up to a heading that ends the body."""

    VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "col", "source"}

    def __init__(self, root: str, prefix: str):
        super().__init__(convert_charrefs=True)
        self.root, self.prefix = root, prefix
        self.stack: list[tuple[str, str]] = []
        self.at: int | None = None
        self.heading: list[str] | None = None
        self.done = False
        self.titles: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID or self.done:
            return
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        self.stack.append((tag, a.get("class") or ""))
        depth = len(self.stack)
        if self.at is None:
            if self.root in classes:
                self.at = depth
            return
        if depth == self.at + 1 and ("mw-heading" in classes or tag in ("h1", "h2", "h3")):
            self.heading = []
        inside = depth > self.at and self.stack[self.at : self.at + 1] and self.stack[self.at][0] == "p" and "mw-empty-elt" not in self.stack[self.at][1]
        if tag == "a" and inside and a.get("href") and not any(t == "sup" and "reference" in c for t, c in self.stack):
            href = re.split("[#?]", a["href"])[0]
            if href.startswith(self.prefix):
                self.titles.append(unquote(href[len(self.prefix) :]).replace("_", " ").strip())

    def handle_endtag(self, tag):
        while self.stack:
            top = self.stack.pop()[0]
            if top == tag:
                break
        if self.at is not None and self.heading is not None and len(self.stack) <= self.at:
            if re.sub(r"\[edit\]", "", "".join(self.heading), flags=re.I).strip().lower() in C.STOP_HEADINGS:
                self.done = True
            self.heading = None
        if self.at is not None and len(self.stack) < self.at:
            self.done = True

    def handle_data(self, data):
        if self.heading is not None:
            self.heading.append(data)


def body_links(page: str, current: str | None = None, root: str = "mw-parser-output", prefix: str = "/wiki/") -> list[str]:
    """Titles that an article's body links to, each once, without itself and without what a crawl doesn't follow."""
    p = _Links(root, prefix)
    p.feed(page)
    key = lambda t: re.sub(r"\s+", "_", t.strip()).lower()
    seen = {key(current)} if current else set()
    out = []
    for t in p.titles:
        bad = not t or t.startswith(tuple(C.CRAWL_PREFIXES)) or any(re.search(x, t, re.I) for x in C.CRAWL_PATTERNS)
        if not bad and key(t) not in seen:
            seen.add(key(t))
            out.append(t)
    return out


# The suffixes of the Porter algorithm, step by step, with what replaces them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _shape(stem: str) -> str:
    """A stem as runs of c(onsonants) and v(owels)."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def stem_word(word: str) -> str:
    """The Porter stem of a lower-case word."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((x for x in ("ed", "ing") if w.endswith(x) and "v" in _shape(w[: -len(x)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = next((x for x in sorted(table, key=len, reverse=True) if w.endswith(x)), None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = next((x for x in sorted(STEP4, key=len, reverse=True) if w.endswith(x)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def word_changes(was: list[str], now: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """Words added and removed between two token sequences, by position: a moved word counts on both sides."""
    added: dict[str, int] = {}
    removed: dict[str, int] = {}
    for tag, a1, a2, b1, b2 in difflib.SequenceMatcher(None, was, now, autojunk=False).get_opcodes():
        if tag != "equal":
            for w in was[a1:a2]:
                removed[w] = removed.get(w, 0) + 1
            for w in now[b1:b2]:
                added[w] = added.get(w, 0) + 1
    return added, removed


def make_patch(was: str, now: str) -> list[tuple[int, int, list[str]]]:
    """What turns the lines of one text into those of another: (first line, lines taken out, lines put in)."""
    a, b = was.split("\n"), now.split("\n")
    return [(i1, i2 - i1, b[j1:j2]) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]


def apply_patch(was: str, patch: list[tuple[int, int, list[str]]]) -> str:
    """The text that a patch makes; a patch that reaches past the text is an error."""
    lines = was.split("\n")
    for at, out, put in sorted(patch, key=lambda p: -p[0]):
        if at + out > len(lines):
            raise ValueError("the patch doesn't fit the text")
        lines[at : at + out] = put
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(html_to_text, na_action="ignore")


@F.pandas_udf(STRINGS)
def html_urls(pages: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else page_urls(p, b or "") for p, b in zip(pages, bases)])


@F.pandas_udf(STRINGS)
def html_links(pages: pd.Series, titles: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else body_links(p, t) for p, t in zip(pages, titles)])


@F.pandas_udf(STRINGS)
def stems(terms: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return terms.map(lambda ws: None if ws is None else [known[w] if w in known else known.setdefault(w, stem_word(w)) for w in ws])
