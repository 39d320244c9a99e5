"""Clean text from documents with HTML, Markdown, MediaWiki or LaTeX markup.

A document is cut into blocks; the blocks' signs are lexed into markup tokens and text. Signs count as markup only in a
form in which they are rendered: a price, a comparison, a set or a file name is text. What stands between an opening and a
closing sign, a run of lines of one kind, and a record (template, table, list, environment) are token streams of a host,
which is the language with the kind of sign or the opening token. From all streams of a host wrappers are inferred (see
``wrappers``). A document has markup if a wrapper matches one of its streams. A record that a wrapper of its host matches gives
its text slots, one line for each repetition; other blocks are rendered token by token. A document in which no token is
markup stays as it is.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from html.entities import html5
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalith.llm import wrappers
from annalith.session import checkpointed

#: Shapes of streams a task remembers as handed on.
HELD = 50_000
#: Shapes of a host that are aligned in one place.
ALIGNED = 1_000
#: Wrappers of records that are broadcast, those of most support; records of others are rendered token by token.
MOST_WRAPPERS = 5_000
#: Tasks over which the rows of one frequent shape are spread.
SALTS = 32

# Element names of HTML and of the wiki extensions, behaviour switches, and commands without an argument.
ELEMENTS = set(
    "a abbr address article aside audio b big blockquote body br button canvas caption center cite code col colgroup data dd del "
    "details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup option p param "
    "picture pre q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead time title tr tt u ul var video wbr "
    "ref references nowiki math syntaxhighlight gallery noinclude includeonly onlyinclude poem chem score timeline".split()
)
SWITCHES = "NOTOC|FORCETOC|TOC|NOEDITSECTION|NEWSECTIONLINK|NONEWSECTIONLINK|NOGALLERY|HIDDENCAT|INDEX|NOINDEX|STATICREDIRECT|DISAMBIG|NOTITLECONVERT|NOTC|NOCC"
COMMANDS = (
    "item|ldots|dots|cdots|LaTeX|TeX|maketitle|tableofcontents|newpage|clearpage|par|noindent|hline|centering|quad|qquad|alpha|beta|"
    "gamma|delta|epsilon|theta|lambda|mu|pi|rho|sigma|tau|phi|omega|sum|prod|int|infty|le|leq|ge|geq|ne|neq|times|cdot|pm|approx|"
    "to|rightarrow|left|right|partial|nabla|in|subset|cup|cap|forall|exists"
)
BLOCK_ELEMENTS = "ul|ol|dl|table|blockquote|pre|div|p|h[1-6]|hr|figure"

_ATTR = r"\s+[A-Za-z_:][\w:.\-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+)"
TAG = rf"</?(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:{_ATTR}|\s+(?:checked|disabled|selected|hidden|open|async|defer|readonly|required))*\s*/?>"
INLINE = re.compile(
    "|".join(
        (
            r"(?P<comment><!--.*?-->|<!DOCTYPE[^>]*>|<\?xml[^>]*\?>)",
            r"(?P<script><(?P<s>script|style)\b[^>]*>.*?</(?P=s)\s*>)",
            r"(?P<verb><(?P<v>math|nowiki|syntaxhighlight|chem|pre|code)\b[^>]*>(?P<vb>.*?)</(?P=v)\s*>)",
            r"(?P<cite><ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>)",
            TAG,
            r"(?P<auto><(?P<au>(?:https?|ftp|mailto):[^\s<>]+)>)",
            r"(?P<entity>&(?:#\d+|#[xX][0-9A-Fa-f]+|(?P<en>[A-Za-z][A-Za-z0-9]+));)",
            r"(?P<image>!\[(?P<alt>[^\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\))",
            r"(?P<mdlink>\[(?P<mt>[^\[\]\n]+)\](?:\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\[[^\[\]\n]+\]))",
            r"(?P<note>\[\^[^\]\s]+\]:?)",
            r"(?P<file>\[\[(?:File|Image|Category|Media)\s*:[^\[\]\n]*(?:\[\[[^\[\]\n]*\]\][^\[\]\n]*)*\]\])",
            r"(?P<wlink>\[\[(?P<wt>[^\[\]\n|]+)(?:\|(?P<wl>[^\[\]\n]*))?\]\])",
            r"(?P<xlink>\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]+(?:\s+(?P<xl>[^\[\]\n]*))?\])",
            r"(?P<param>\{\{\{[^{}\n]*\}\}\})",
            r"(?P<tpl>\{\{(?P<tb>\s*[#:\w][^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*)\}\})",
            rf"(?P<switch>__(?:{SWITCHES})__)",
            r"(?P<sign>~{3,5}(?![^\s.,;]))",
            r"(?P<dmath>\$\$(?P<dm>.+?)\$\$|\\\[(?P<dn>.+?)\\\]|\\\((?P<dp>.+?)\\\))",
            r"(?P<imath>(?<![\\$\w])\$(?P<im>[A-Za-z]|(?=[^$\n]*[\\^_{}=])[^\s$](?:[^$\n]*?[^\s$\\])?)\$(?![\d$]))",
            r"(?P<tick>(?P<tk>`{1,3})(?=[^`])(?P<tc>[^`\n]+)(?P=tk)(?!`))",
            r"(?P<quote>(?P<q>'{2,5})(?=[^\s'])(?P<qt>[^\n]+?)(?<![\s'])(?P=q)(?!'))",
            r"(?P<strong>(?<![\\\w*])\*\*(?=[^\s*])(?P<st>[^\n]+?)(?<=[^\s*])\*\*(?![\w*])|(?<![\\\w])__(?=[^\s_])(?P<su>[^\n]+?)(?<=[^\s_])__(?!\w))",
            r"(?P<em>(?<![\\\w*])\*(?=[^\s*])(?P<et>[^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\\\w])_(?=[^\s_])(?P<eu>[^_\n]+?)(?<=[^\s_])_(?!\w))",
            r"(?P<strike>~~(?=\S)(?P<sk>[^~\n]+?)(?<=\S)~~)",
            r"(?P<env>\\(?:begin|end)\{[^{}\n]+\}(?:\[[^\]\n]*\])?)",
            r"(?P<cmd>(?<![A-Za-z]:)\\(?P<cn>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{(?P<ca>[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*)\}(?:\{(?P<cb>[^{}\n]*)\})?)",
            rf"(?P<bare>(?<![A-Za-z]:)(?<![\\\w])\\(?:{COMMANDS})(?![A-Za-z\\]))",
            r"(?P<escape>\\[%&$#_{}](?!\w*\\))",
        )
    ),
    re.S,
)
#: Languages of the inline tokens, by group.
LANGUAGE = {
    **dict.fromkeys(("comment", "script", "verb", "tag", "entity", "auto"), "html"),
    **dict.fromkeys(("cite", "file", "wlink", "xlink", "param", "tpl", "switch", "sign", "quote"), "mediawiki"),
    **dict.fromkeys(("image", "mdlink", "note", "tick", "strong", "em", "strike"), "markdown"),
    **dict.fromkeys(("dmath", "imath", "env", "cmd", "bare", "escape"), "latex"),
}
#: What may hold markup at all; the rest is passed on unread.
SUSPECT = r"(?m)[<&\[{`~\\$|*_]|''|^\s*(?:[-+#:;>%=]|\d+[.)]\s)"

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)\s*([\w+-]*)\s*$")
_HEAD = re.compile(r"^(?P<w>={1,6})\s*(?P<wt>[^=\s](?:.*?[^=\s])?)\s*(?P=w)\s*$|^(?P<m>#{1,6}) +(?P<mt>\S.*?)(?: +#+)?\s*$")
_LIST = re.compile(r"^(?P<i>\s*)(?P<b>[-+*]|[*#:;]+)\s+(?P<t>\S.*)$")
_ORDERED = re.compile(r"^(?P<i>\s*)(?P<n>\d{1,9})[.)]\s+(?P<t>\S.*)$")
_RULE = re.compile(r"^ {0,3}(?:-{3,}|(?:\* *){3,}|(?:_ *){3,}|(?:- +){2,}-)\s*$")
_UNDERLINE = re.compile(r"^(?:={2,}|-{2,})\s*$")
_ROW = re.compile(r"^\s{0,3}\|.*\|\s*$")
_DASHES = re.compile(r"^\s{0,3}\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
_REDIRECT = re.compile(r"^#REDIRECT\b", re.I)


_SIGN = re.compile(
    r"<[^<>]*>|\{\{[^|{}\n]*|\}\}|\[\[|\]\]|^\{\|[^\n]*|^\|\}|^\|-[^\n]*|\|\||!!|(?<=\|)[\w ]+=|\||^!|\\(?:begin|end)\{[^{}]*\}|\\item|^[*#:;]+|^\s*[-+]\s", re.M
)
#: The signs at the edges of an inline token, at most as long as any language's.
_EDGES = re.compile(r"([^\w\s]{0,4})(?:.*?)([^\w\s]{0,4})$", re.S)
#: What an inline token can begin with.
_FIRST = re.compile(r"[<&!\[{_~$\\`'*]")


@dataclass
class Block:
    kind: str  # text, heading, item, code, formula, quote, table, rule, record
    text: str
    level: int = 0
    marked: bool = False
    language: str = ""
    sign: str = ""  # what marks it as a line of its kind; none if it is a record


def tokens_of(text: str) -> list[wrappers.Token]:
    """Markup tokens and the texts between, of a block that is a record."""
    out: list[wrappers.Token] = []
    at = 0
    for m in _SIGN.finditer(text):
        if text[at : m.start()].strip():
            out.append((False, text[at : m.start()].strip()))
        out.append((True, bare_sign(m.group())))
        at = m.end()
    if text[at:].strip():
        out.append((False, text[at:].strip()))
    return out


def bare_sign(sign: str) -> str:
    """A sign without its attributes, which differ from record to record."""
    sign = re.sub(r"\s+", " ", sign.strip())
    if sign.startswith("<") and (m := re.match(r"</?\w+", sign)):
        return m.group() + ">"
    return sign[:2] if sign.startswith(("{|", "|-")) else sign


def host_of(language: str, stream: list[wrappers.Token]) -> str:
    """The language and the opening token, of a template with its name; attributes don't matter."""
    return f"{language} {re.sub(r'(?<=[<|])(\w*)[^\w>].*', r'\1', stream[0][1])}"


class Cleaner:
    """Reads one document at a time. ``known`` has the wrappers of the hosts, those of most support first."""

    def __init__(self, known: dict[str, list[tuple]] | None = None):
        self.known = known or {}
        self.found: set[str] = set()  # languages of the markup of the document in hand
        self.records: list[tuple[str, list[wrappers.Token]]] = []
        self.lines: list[Block] = []
        self.inlines: set[tuple[str, str, str]] = set()  # host, opening and closing sign

    def record(self, language: str, text: str) -> str | None:
        """The lines of a record by the first wrapper of its host that matches, None if there is none."""
        stream = tokens_of(text)
        if not stream:
            return ""
        host = host_of(language, stream)
        self.records.append((host, stream))
        rows = next((r for w in self.known.get(host, ()) if (r := wrappers.extract(w, stream)) is not None), None)
        if rows is None:
            return None
        return "\n".join(" | ".join(self.inline(x) for x in r) for r in rows if r)

    def inline(self, text: str) -> str:
        out: list[str] = []
        at = 0
        first = _FIRST.search(text)
        while first:
            m = INLINE.match(text, first.start())
            clean = self.token(m) if m else None
            if clean is not None:
                out += [text[at : m.start()], clean]
                at = m.end()
            first = _FIRST.search(text, at if clean is not None else first.end())
        out.append(text[at:])
        return "".join(out)

    def token(self, m: re.Match) -> str | None:
        """What a token leaves; None if it is text after all."""
        kind = m.lastgroup if m.lastgroup in LANGUAGE else next(k for k in LANGUAGE if m.group(k) is not None)
        if kind == "tag" and m.group("tag").lower() not in ELEMENTS and f"</{m.group('tag')}>" not in m.string:
            return None
        if kind == "entity" and m.group("en") and m.group("en") + ";" not in html5:
            return None
        self.found.add(LANGUAGE[kind])
        signs = _EDGES.match(m.group())
        name = m.group("tag").lower() if kind == "tag" else m.group("cn") if kind == "cmd" else ""
        self.inlines.add((f"{LANGUAGE[kind]} {kind} {name}".strip(), signs.group(1) + name, signs.group(2)))
        if kind in ("comment", "script", "cite", "file", "param", "switch", "sign", "note", "env"):
            return ""
        if kind == "verb":
            return m.group("vb") if m.group("v") != "code" and m.group("v") != "pre" else html.unescape(re.sub(TAG, "", m.group("vb")))
        if kind == "tag":
            name = m.group("tag").lower()
            if name in ("li", "dt", "dd"):
                return "" if m.group().startswith("</") else "\n- "
            if name in ("td", "th"):
                return " | " if not m.group().startswith("</") else ""
            return "\n" if name in ("br", "p", "div", "tr", "table", "ul", "ol", "dl", "blockquote", "hr", "h1", "h2", "h3", "h4", "h5", "h6") else ""
        if kind == "entity":
            return html.unescape(m.group())
        if kind == "auto":
            return m.group("au")
        if kind == "image":
            return self.inline(m.group("alt"))
        if kind == "mdlink":
            return self.inline(m.group("mt"))
        if kind == "wlink":
            return self.inline(m.group("wl") if m.group("wl") is not None else m.group("wt").lstrip(":"))
        if kind == "xlink":
            return self.inline(m.group("xl") or "")
        if kind == "tpl":
            parts = re.split(r"\|(?![^\[]*\]\])(?![^{]*\}\})", m.group("tb"))[1:]
            return self.inline(" ".join(x.strip() for x in parts if "=" not in x))
        if kind in ("dmath", "imath"):
            return next(g for g in (m.group(x) for x in ("dm", "dn", "dp", "im")) if g is not None).strip()
        if kind == "tick":
            return m.group("tc")
        if kind in ("quote", "strong", "em", "strike"):
            return self.inline(next(g for g in (m.group(x) for x in ("qt", "st", "su", "et", "eu", "sk")) if g is not None))
        if kind == "cmd":
            if m.group("cn") in ("cite", "citep", "citet", "ref", "label", "footnote", "includegraphics", "usepackage", "documentclass", "input"):
                return ""
            if m.group("cn") == "frac" and m.group("cb") is not None:
                return f"{m.group('ca')}/{m.group('cb')}"
            return self.inline(m.group("cb") if m.group("cn") == "href" and m.group("cb") else m.group("ca"))
        if kind == "bare":
            return "\n- " if m.group().endswith("item") else ""
        return m.group()[1:]  # an escape

    def blocks(self, text: str) -> list[Block]:
        """The document's blocks in order; ``found`` says which languages its markup is of."""
        self.found, self.records, self.inlines = set(), [], set()
        lines = text.replace("\r\n", "\n").split("\n")
        out: list[Block] = []
        plain: list[str] = []
        free = True  # a block may begin here: after an empty line, or a line of a block

        def flush() -> None:
            if plain:
                whole = "\n".join(plain)
                before = set(self.found)
                clean = self.inline(whole)
                out.append(Block("text", clean, marked=clean != whole or self.found != before))
                plain.clear()

        def mark(kind: str, content: str, language: str, level: int = 0, sign: str = "") -> None:
            flush()
            self.found.add(language)
            out.append(Block(kind, content, level, True, language, sign or kind))

        k = 0
        while k < len(lines):
            line = lines[k]
            after = lines[k + 1] if k + 1 < len(lines) else ""
            if not line.strip():
                plain.append(line)
                free = True
                k += 1
                continue
            span = self.span(lines, k)
            if free and (m := _FENCE.match(line)):
                end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(m.group(1))), None)
                if end is not None:
                    mark("code", "\n".join(lines[k + 1 : end]), "markdown")
                    k = end + 1
                    continue
            elif span:
                kind, language, end, content = span
                mark(kind, content, language, sign=re.match(r"[^\w\s]*\w*", line.strip()).group())
                k = end
                continue
            elif free and line.startswith("# ") and (after.startswith("# ") or k and lines[k - 1].startswith("# ")):
                mark("item", self.inline(line[2:].strip()), "mediawiki", 1)  # several in a row count, and don't head
                k += 1
                continue
            elif m := _HEAD.match(line) if free or line.startswith("=") else None:
                head = m.group("wt") or m.group("mt")
                mark("heading", self.inline(head), "mediawiki" if m.group("w") else "markdown", len(m.group("w") or m.group("m")))
                k += 1
                continue
            elif free and _RULE.match(line):
                mark("rule", "", "markdown")
                k += 1
                continue
            elif free and _UNDERLINE.match(after) and not _LIST.match(line) and not line.startswith(("|", ">")):
                mark("heading", self.inline(line.strip()), "markdown", 1 if after.startswith("=") else 2)
                k += 2
                continue
            elif free and (m := _LIST.match(line)):
                level = len(m.group("b")) if m.group("b") not in "-+" else 1 + len(m.group("i")) // 2
                content = re.sub(r"^\[[ xX]\]\s+", "", m.group("t"))
                mark("item", self.inline(content), "mediawiki" if m.group("b")[0] in "#:;" or len(m.group("b")) > 1 else "markdown", level)
                k += 1
                continue
            elif free and (m := _ORDERED.match(line)) and (self.counted(after, int(m.group("n")) + 1) or out and not plain and out[-1].kind == "item"):
                mark("item", self.inline(m.group("t")), "markdown", 1 + len(m.group("i")) // 2)
                k += 1
                continue
            elif free and re.match(r"^ {0,3}> ?\S", line):
                mark("quote", self.inline(line.lstrip()[1:].strip()), "markdown")
                k += 1
                continue
            elif free and _ROW.match(line) and _DASHES.match(after):
                end = k + 2
                while end < len(lines) and _ROW.match(lines[end]):
                    end += 1
                rows = [[self.inline(c.strip()) for c in r.strip().strip("|").split("|")] for j, r in enumerate(lines[k:end]) if j != 1]
                mark("table", "\n".join(" | ".join(r) for r in rows), "markdown")
                k = end
                continue
            elif free and re.match(r"^%+\s+\S", line):
                mark("comment", "", "latex")
                k += 1
                continue
            elif _REDIRECT.match(line):
                self.found.add("mediawiki")
                self.inlines.add(("mediawiki redirect", "#REDIRECT", ""))
            plain.append(line)
            free = False
            k += 1
        flush()
        self.lines = out
        return out

    def streams(self) -> Iterator[tuple[str, tuple]]:
        """(host, shape) of all streams of the document read last: its records, runs of marked lines, and inline tokens."""
        for host, stream in self.records:
            yield host, wrappers.slotted(wrappers.start(stream))
        for host, opening, closing in self.inlines:
            yield host, ((True, opening), wrappers.SLOT, *([(True, closing)] if closing else []))
        run: list[Block] = []
        for b in [*self.lines, None]:
            if run and (b is None or not b.sign or (b.kind, b.language) != (run[0].kind, run[0].language)):
                yield f"{run[0].language} {run[0].kind}", wrappers.collapse(tuple(x for r in run for x in ((True, r.sign), wrappers.SLOT)))
                run = []
            if b is not None and b.sign:
                run.append(b)

    @staticmethod
    def counted(line: str, n: int) -> bool:
        m = _ORDERED.match(line)
        return bool(m) and int(m.group("n")) == n

    def span(self, lines: list[str], k: int) -> tuple[str, str, int, str] | None:
        """A block of several lines that its first line opens: (kind, language, next line, content)."""
        line = lines[k].strip()

        def until(pattern: str) -> int | None:
            close = re.compile(pattern)
            return next((j for j in range(k, len(lines)) if close.search(lines[j])), None)

        if line.startswith("{|") and (end := until(r"^\s*\|\}")) is not None:
            whole = "\n".join(lines[k : end + 1])
            by_wrapper = self.record("mediawiki", whole)
            if by_wrapper is None:
                cells = [[c.strip() for c in re.split(r"\|\||!!", x.lstrip("|! "))] for x in lines[k + 1 : end] if x.strip() and not x.startswith("|-")]
                by_wrapper = "\n".join(" | ".join(self.inline(c) for c in r) for r in cells)
            return "table", "mediawiki", end + 1, by_wrapper
        if line.startswith("{{") and (end := until(r"\}\}\s*$")) is not None:
            whole = "\n".join(lines[k : end + 1]).strip()
            inner = INLINE.match(whole)
            if inner and inner.end() == len(whole) and inner.group("tpl"):
                by_wrapper = self.record("mediawiki", whole)
                if by_wrapper is None:
                    by_wrapper = "\n".join(self.inline(x.strip().replace("=", ": ", 1)) for x in re.split(r"\|(?![^\[]*\]\])(?![^{]*\}\})", inner.group("tb"))[1:])
                return "record", "mediawiki", end + 1, by_wrapper.replace(" | ", "\n")
        if (m := re.match(r"<(pre|syntaxhighlight|source|code)\b[^<>]*>", line, re.I)) and (end := until(rf"</{m.group(1)}\s*>")) is not None and lines[end].rstrip().endswith(">"):
            whole = "\n".join(lines[k : end + 1])
            body = re.sub(rf"^\s*<{m.group(1)}\b[^<>]*>\n?|\n?</{m.group(1)}\s*>\s*$", "", whole)
            return "code", "html", end + 1, html.unescape(re.sub(TAG, "", body)) if m.group(1) in ("pre", "code") else body
        if (m := re.match(r"\\begin\{(\w+)\*?\}", line)) and (end := until(rf"\\end\{{{m.group(1)}\*?\}}")) is not None:
            whole = "\n".join(lines[k : end + 1])
            name = m.group(1)
            body = "\n".join(lines[k + 1 : end])
            if name in ("verbatim", "lstlisting", "minted"):
                return "code", "latex", end + 1, body
            if name in ("equation", "align", "gather", "displaymath", "math", "eqnarray"):
                return "formula", "latex", end + 1, body
            by_wrapper = self.record("latex", whole)
            if by_wrapper is not None and name in ("itemize", "enumerate"):
                return "item", "latex", end + 1, "\n".join(f"- {x}" for x in by_wrapper.split("\n") if x)
            return "text", "latex", end + 1, self.inline(body).strip("\n")
        if line.startswith("\\[") and (end := until(r"\\\]\s*$")) is not None or line.startswith("$$") and len(line) > 2 and (end := until(r"\$\$\s*$")) is not None:
            return "formula", "latex", end + 1, re.sub(r"^\s*(?:\\\[|\$\$)\s*|\s*(?:\\\]|\$\$)\s*$", "", "\n".join(lines[k : end + 1]))
        if line == "$$" and (end := next((j for j in range(k + 1, len(lines)) if lines[j].strip() == "$$"), None)) is not None:
            return "formula", "latex", end + 1, "\n".join(lines[k + 1 : end])
        if (m := re.match(r"\\(section|subsection|subsubsection|chapter|part|paragraph|title)\*?\{([^{}]*)\}\s*$", line)):
            return "heading", "latex", k + 1, self.inline(m.group(2))
        if (m := re.match(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>\s*$", line, re.I)):
            return "heading", "html", k + 1, self.inline(m.group(2))
        if (m := re.match(r"<(ul|ol|dl|table)\b[^<>]*>", line, re.I)) and (end := until(rf"(?i)</{m.group(1)}\s*>\s*$")) is not None:
            whole = "\n".join(lines[k : end + 1])
            by_wrapper = self.record("html", whole)
            if by_wrapper is None:
                by_wrapper = "\n".join(x.strip().lstrip("|").strip() for x in self.inline(whole).split("\n") if x.strip())
            elif m.group(1).lower() != "table":
                by_wrapper = "\n".join(f"- {x}" for x in by_wrapper.split("\n") if x)
            return "item" if m.group(1).lower() != "table" else "table", "html", end + 1, by_wrapper
        return None

    def clean(self, text: str) -> tuple[str, list[Block]]:
        """The clean text, and the blocks. Without markup the text comes back unchanged."""
        blocks = self.blocks(text)
        if not self.found:
            return text, [Block("text", text)]
        parts = []
        for b in blocks:
            if b.kind in ("rule", "comment"):
                continue
            if b.kind == "item" and not b.text.startswith("- "):
                parts.append("  " * max(0, b.level - 1) + "- " + b.text)
            elif b.kind == "code":
                parts.append("\n".join("    " + x for x in b.text.split("\n")))
            else:
                parts.append(b.text)
        text = re.sub(r"[^\S\n]+\n", "\n", "\n".join(parts))
        return re.sub(r"\n{3,}", "\n\n", text).strip("\n"), blocks


def suspect(text: Column) -> Column:
    """Whether a text may hold markup; decided in the JVM, so that plain prose isn't sent to Python."""
    return text.rlike(SUSPECT)


def read_streams(df: DataFrame, keys: Sequence[str], text: str, records_only: bool = False) -> DataFrame:
    """``keys``, h, host, shape: one row for each shape of a row's streams; h is a hash of host and shape.

    A task says host and shape (as JSON) of an h once, and again if it has met very many others since.
    """
    source = df.where(suspect(F.col(text))).select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*(source.schema[k] for k in keys), *(T.StructField(n, t) for n, t in (("h", T.LongType()), ("host", T.StringType()), ("shape", T.StringType())))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Cleaner()
        said: dict[tuple, int] = {}
        for batch in batches:
            rows, hs, hosts, shapes = [], [], [], []
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                reader.blocks(t)
                found = set()
                for host, shape in ((a, wrappers.slotted(wrappers.start(b))) for a, b in reader.records) if records_only else reader.streams():
                    h = said.get((host, shape))
                    if h in found:
                        continue
                    new = h is None
                    if new:
                        spelled = json.dumps(wrappers.written(shape))
                        h = int.from_bytes(hashlib.blake2b(f"{host}\0{spelled}".encode(), digest_size=8).digest(), "big", signed=True)
                        if len(said) >= HELD:
                            said.clear()
                        said[(host, shape)] = h
                    found.add(h)
                    rows.append(i)
                    hs.append(h)
                    hosts.append(host if new else None)
                    shapes.append(spelled if new else None)
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hs, pa.int64()), pa.array(hosts, pa.string()), pa.array(shapes, pa.string())], [*keys, "h", "host", "shape"])

    return source.mapInArrow(read, schema)


def host_shapes(streams: DataFrame) -> DataFrame:
    """h, host, shape, n (rows that have it)."""
    return streams.groupBy("h").agg(F.max("host").alias("host"), F.max("shape").alias("shape"), F.count("*").alias("n"))


def cover_hosts(shapes: DataFrame, aligned: int = ALIGNED) -> DataFrame:
    """h, host, wrapper, n: wrappers that together match all shapes of ``shapes`` (h, host, shape, n), and the shapes each matches.

    A host's shapes are aligned in groups of about ``aligned``, by hash, so that no host is work for one task alone.
    """

    def covered(frame: pd.DataFrame) -> pd.DataFrame:
        read = [wrappers.read(json.loads(x)) for x in frame["shape"]]
        found = [(w, json.dumps(wrappers.written(w))) for w, _ in wrappers.cover(list(zip(read, frame["n"])))]
        by = [next((text for w, text in found if wrappers.fits(w, x)), None) for x in read]
        return pd.DataFrame({"h": frame["h"], "host": frame["host"], "wrapper": pd.Series(by, index=frame.index, dtype=object), "n": frame["n"]})

    sizes = shapes.groupBy("host").agg(F.ceil(F.count("*") / aligned).alias("groups"))
    cut = shapes.join(sizes.hint("merge"), "host").withColumn("part", F.pmod("h", "groups")).drop("groups")
    return cut.groupBy("host", "part").applyInPandas(covered, "h long, host string, wrapper string, n long").where("wrapper IS NOT NULL")


def marked_rows(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The distinct ``keys`` of the rows of which a stream is matched by a wrapper of its host, inferred from all rows.

    The texts are read once, into hashes of their streams' shapes; wrappers are aligned from the distinct shapes, and the rows
    of the shapes they match are found by a salted join. Null and empty texts have no streams.
    """
    streams = checkpointed(read_streams(df, keys, text))
    matched = cover_hosts(host_shapes(streams)).select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = streams.select(*keys, "h", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.hint("merge").join(matched, ["h", "salt"], "left_semi").select(*keys).distinct()


def infer_wrappers(df: DataFrame, text: str) -> dict[str, list[tuple]]:
    """The wrappers of the records of each host, from all rows; at most MOST_WRAPPERS in all, those of most support.

    The wrappers of a host's groups of shapes are aligned with each other, as shapes are, until they are one group or as
    many as before.
    """
    shapes = host_shapes(read_streams(df, [], text, records_only=True))
    before = None
    while True:
        found = cover_hosts(shapes).groupBy("host", F.col("wrapper").alias("shape")).agg(F.sum("n").alias("n"))
        shapes = checkpointed(found.withColumn("h", F.xxhash64("host", "shape")))
        most = shapes.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1 or before is not None and most >= before:
            break
        before = most
    out: dict[str, list[tuple]] = {}
    for r in shapes.orderBy(F.desc("n"), "host", "shape").limit(MOST_WRAPPERS).collect():
        out.setdefault(r["host"], []).append(wrappers.read(json.loads(r["shape"])))
    return out


def clean_texts(df: DataFrame, text: str, known: dict[str, list[tuple]] | None = None) -> DataFrame:
    """``df`` with clean_text, markup (the languages found, sorted) and blocks (kind, level, text).

    Null texts have null clean_text and no markup; empty texts and prose without markup stay as they are, with one block of
    kind text. Columns of ``df`` named like the new ones are replaced; repeated rows stay. Without ``known`` the wrappers
    are inferred from all rows of ``df``; those broadcast are MOST_WRAPPERS at most.
    """
    new = ("clean_text", "markup", "blocks")
    kept = df.drop(*new)
    known = known if known is not None else infer_wrappers(kept, text)
    shared = df.sparkSession.sparkContext.broadcast(known)
    kind = "struct<clean_text:string,markup:array<string>,blocks:array<struct<kind:string,level:int,text:string>>>"

    def read(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Cleaner(shared.value)
        for texts in column:
            rows = []
            for t in texts:
                if t is None:
                    rows.append((None, [], []))
                    continue
                clean, blocks = reader.clean(t)
                rows.append((clean, sorted(reader.found), [{"kind": b.kind, "level": b.level, "text": b.text} for b in blocks]))
            yield pd.DataFrame(rows, columns=list(new))

    t = F.col(text)
    plain = F.struct(
        t.alias("clean_text"),
        F.array().cast("array<string>").alias("markup"),
        F.when(t.isNull(), F.array().cast("array<struct<kind:string,level:int,text:string>>"))
        .otherwise(F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("level"), t.alias("text")))).alias("blocks"),
    )
    by_python = F.pandas_udf(read, kind)
    done = kept.withColumn("_suspect", F.coalesce(suspect(t), F.lit(False)))
    marked = done.where("_suspect").withColumn("_read", by_python(t))
    rest = done.where("NOT _suspect").withColumn("_read", plain)
    return marked.unionByName(rest).select(*kept.columns, *(F.col(f"_read.{c}").alias(c) for c in new))
