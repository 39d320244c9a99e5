"""Text functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalith import constants as C

#: White space as the analyses define it, wider than Java's.
WS = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(text: Column, min_length: int) -> Column:
    """The longest runs of a-z and 0-9 of at least ``min_length`` characters in the lower-cased text; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([a-z0-9]{{{min_length},}})"), 1)


def words(text: Column, min_length: int = 3, stop: Sequence[str] = C.STOP_BASE) -> Column:
    """The runs that aren't in the stop list, in order, as an array."""
    return F.filter(runs(text, min_length), lambda w: ~w.isin(*stop))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def title_key(title: Column) -> Column:
    """The form under which a title is stored: trimmed, white space as one underscore, lower case."""
    return F.lower(F.regexp_replace(trim(title), rf"{WS}+", "_"))


def display_title(title: Column) -> Column:
    """A title as shown: trimmed, underscores as spaces."""
    return F.translate(trim(title), "_", " ")


def has_prefix(title: Column, prefixes: Sequence[str]) -> Column:
    return title.rlike("^(?:" + "|".join(p.replace(" ", r"\x20") for p in prefixes) + ")")


def is_article(title: Column, content: Column) -> Column:
    """Whether a dump page is an article: title and content not empty, no other namespace, no redirect."""
    return (
        (F.coalesce(title, F.lit("")) != "")
        & (F.coalesce(content, F.lit("")) != "")
        & ~has_prefix(title, C.DUMP_PREFIXES)
        & ~F.lower(trim(content)).startswith("#redirect")
    )


def is_followed(title: Column) -> Column:
    """Whether a crawl follows a link to the title."""
    shown = display_title(title)
    return (F.coalesce(shown, F.lit("")) != "") & ~has_prefix(shown, C.CRAWL_PREFIXES) & ~shown.rlike("(?i)(?:" + "|".join(C.CRAWL_PATTERNS) + ")")


# The replacements that strip wiki markup, each with what it leaves.
STRIP = {
    "category": (r"(?i)\[\[Category:[^\]]+\]\]", ""),
    "file": (r"(?i)\[\[(?:File|Image):[^\]]+\]\]", ""),
    "template": (r"\{\{[^}]*\}\}", ""),
    "reference": (r"(?s)<ref[^>]*>.*?</ref>", ""),
    "empty reference": (r"<ref[^>]*/>", ""),
    "tag": (r"<[^>]+>", ""),
    "piped link": (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
    "link": (r"\[\[([^\]]+)\]\]", "$1"),
    "external link": (r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"),
    "emphasis": (r"'{2,5}", ""),
    "empty lines": (r"\n{3,}", "\n\n"),
}
# The order of the replacements for definitions, and for dumps, where links go first.
DEFINITION_ORDER = list(STRIP)
DUMP_ORDER = [k for k in STRIP if k not in ("category", "file", "empty lines")] + ["category", "file", "empty lines"]


def plain_text(text: Column, order: Sequence[str] = DEFINITION_ORDER) -> Column:
    """Wiki text without its markup, trimmed. Nested templates leave their tail, as the pattern can't cross the inner end."""
    for name in order:
        text = F.regexp_replace(text, F.lit(STRIP[name][0]), F.lit(STRIP[name][1]))
    return trim(text)


def first_paragraph(text: Column) -> Column:
    """The first line and those after it up to an empty one or one that begins a block; white space as one blank."""

    def of_lines(lines: Column) -> Column:
        rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        stop = F.array_position(F.transform(rest, lambda x: (x == "") | x.rlike(r"^[=#*:;|]")), True).cast("int")
        kept = let(stop, lambda n: F.when(n > 0, F.slice(rest, F.lit(1), n - 1)).otherwise(rest))
        return F.nullif(trim(F.regexp_replace(F.array_join(F.concat(F.slice(lines, 1, 1), kept), " "), rf"{WS}+", " ")), F.lit(""))

    return let(F.transform(F.split(text, "\n"), trim), of_lines)


# What follows a mark that ends a sentence: the end, or a blank and then nothing, a capital, quotation mark or bracket.
_AFTER = r"(?=$|\x20(?:\x20*$|\x20*[A-Z\"(\[]))"


def first_sentence(paragraph: Column) -> Column:
    """The text up to the first mark that ends a sentence and doesn't follow an abbreviation; null if there is none.

    The expression goes from mark to mark, and looks back for abbreviations only there.
    """
    words_ = "|".join(a.replace(".", r"\.") for a in sorted(C.ABBREVIATIONS, key=len, reverse=True))
    pattern = rf"^((?:[^.!?]*+[.!?])+?(?<!(?i)(?:^|\x20)(?:{words_})[.!?]){_AFTER})"
    return F.nullif(trim(F.regexp_extract(paragraph, pattern, 1)), F.lit(""))


def definition(text: Column) -> Column:
    """The first sentence of a wiki text, else its first paragraph, shortened to 500 characters and an ellipsis."""

    def of_paragraph(p: Column) -> Column:
        short = F.when(F.length(p) > C.EXCERPT, F.concat(F.substring(p, 1, C.EXCERPT), F.lit("…"))).otherwise(p)
        return F.coalesce(first_sentence(p), short)

    return let(first_paragraph(plain_text(text)), of_paragraph)


def wiki_links(text: Column) -> Column:
    """Targets of the links of a wiki text, trimmed, other namespaces left out, each once in the order of appearance."""
    targets = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(targets, trim), lambda t: (t != "") & ~has_prefix(t, C.DUMP_PREFIXES)))


def ngrams(terms: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` consecutive terms, joined by blanks; incomplete tails are left out."""
    def runs_of(n: int) -> Column:
        shifted = [F.slice(terms, F.lit(i + 1), F.greatest(F.size(terms) - n + 1, F.lit(0))).alias(f"t{i}") for i in range(n)]
        return F.transform(F.arrays_zip(*shifted), lambda x: F.concat_ws(" ", *(x[f"t{i}"] for i in range(n))))

    return F.concat(*(runs_of(n) for n in range(1, most + 1)))


def legacy_terms(text: Column, stop: Sequence[str] = C.STOP_BASE) -> Column:
    """Runs of letters a-z of the text with the accents of Latin-1 letters taken off, lower case, without stop words."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.regexp_extract_all(plain, F.lit("([a-z]+)"), 1), lambda w: ~w.isin(*stop))


def file_name(title: Column) -> Column:
    """A title as a file name: what isn't a letter, digit, point, hyphen or underscore becomes an underscore."""
    return F.regexp_replace(title, r"[^a-zA-Z0-9._-]", "_")


def first_filled(*texts: Column) -> Column:
    """The first of the texts that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def query_string(params: Column) -> Column:
    """A map of parameters as the query part of an address; null and empty values are left out."""
    kept = F.map_filter(params, lambda _, v: v.isNotNull() & (v != ""))
    return F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")
