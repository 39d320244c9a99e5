"""Union-free regular expressions from token streams of the same host.

A wrapper is a sequence of fixed tokens, text slots, optional groups and repeated groups, without alternatives. It starts as
one stream and is aligned with the others one by one, the most frequent shape first; a stream that can't be aligned with it
starts a wrapper of its own, so a host has as many wrappers as it has templates. A mismatch of two texts becomes a slot; a mismatch that involves
markup is resolved as a repeated group, if what precedes it ends in the same token as a group that follows, or else as an
optional group, if the token one side lacks comes up later on the other.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

Token = tuple[bool, str]  # is it markup, and what it says


@dataclass(frozen=True)
class Slot:
    """Text that differs from stream to stream."""


@dataclass(frozen=True)
class Group:
    """Items that come ``least`` times (0 or 1) up to ``many`` times (once if not many)."""

    items: tuple
    least: int
    many: bool


SLOT = Slot()


def start(stream: list[Token]) -> tuple:
    return collapse(tuple(stream))


def collapse(items: tuple) -> tuple:
    """Adjacent equal stretches that end in markup become a repeated group; longest stretches last, so the smallest fit."""
    at = 0
    out = list(items)
    while at < len(out):
        for size in range(2, (len(out) - at) // 2 + 1):
            if is_markup(out[at]) and out[at] != out[at + size]:
                continue
            first = out[at : at + size]
            if not any(is_markup(x) for x in first) or isinstance(first[0], Group):
                continue
            n, merged = 1, tuple(first)
            while (again := alike(merged, tuple(out[at + n * size : at + (n + 1) * size]))) is not None:
                n, merged = n + 1, again
            if n > 1:
                out[at : at + n * size] = [Group(merged, 1, True)]
                break
        at += 1
    return tuple(out)


def written(items: tuple) -> list:
    """A wrapper as JSON values: markup as a string, texts and slots as 0, a group as [least, many, items]."""
    return [[x.least, x.many, written(x.items)] if isinstance(x, Group) else x[1] if is_markup(x) else 0 for x in items]


def read(values: list) -> tuple:
    return tuple(SLOT if x == 0 else (True, x) if isinstance(x, str) else Group(read(x[2]), x[0], x[1]) for x in values)


def is_markup(x) -> bool:
    return isinstance(x, tuple) and x[0]


def alike(a: tuple, b: tuple) -> tuple | None:
    """``a`` and ``b`` item by item: equal markup, and texts as slots; None if they differ otherwise."""
    if len(a) != len(b) or not a:
        return None
    out = []
    for x, y in zip(a, b):
        if x == y:
            out.append(x)
        elif not is_markup(x) and not is_markup(y) and not isinstance(x, Group) and not isinstance(y, Group):
            out.append(SLOT)
        else:
            return None
    return tuple(out)


def align(wrapper: tuple, stream: tuple) -> tuple | None:
    """A wrapper that covers both, or None if a mismatch can't be resolved. ``stream`` is collapsed too."""
    out: list = []
    i = j = 0
    while i < len(wrapper) or j < len(stream):
        w = wrapper[i] if i < len(wrapper) else None
        s = stream[j] if j < len(stream) else None
        if w is not None and s is not None:
            if isinstance(w, Group) and isinstance(s, Group) and (inner := align(w.items, s.items)) is not None:
                out.append(Group(inner, min(w.least, s.least), w.many or s.many))
                i, j = i + 1, j + 1
                continue
            if isinstance(w, Group) and not isinstance(s, Group) and (inner := alike_group(w, stream[j:])) is not None:
                out.append(inner)
                i, j = i + 1, j + len(w.items)
                continue
            if isinstance(s, Group) and not isinstance(w, Group) and (inner := alike_group(s, wrapper[i:])) is not None:
                out.append(inner)
                i, j = i + len(s.items), j + 1
                continue
            if (same := alike((w,), (s,))) is not None:
                out.append(same[0])
                i, j = i + 1, j + 1
                continue
        later = next((k for k in range(j + 1, len(stream)) if w is not None and matches(w, stream[k])), None)
        sooner = next((k for k in range(i + 1, len(wrapper)) if s is not None and matches(wrapper[k], s)), None)
        if w is None or later is not None and (sooner is None or later - j <= sooner - i):
            end = len(stream) if w is None else later
            out.append(Group(tuple(stream[j:end]), 0, False))
            j = end
        elif s is None or sooner is not None:
            end = len(wrapper) if s is None else sooner
            for x in wrapper[i:end]:
                out.append(Group(x.items, 0, x.many) if isinstance(x, Group) else Group((x,), 0, False))
            i = end
        else:
            return None
    return tuple(out)


def alike_group(group: Group, items: tuple) -> Group | None:
    merged = alike(group.items, tuple(items[: len(group.items)]))
    return None if merged is None else Group(merged, group.least, group.many)


def matches(a, b) -> bool:
    return a == b and (is_markup(a) or isinstance(a, Group))


def infer(streams: list[list[Token]]) -> tuple | None:
    """The wrapper of most support of all streams; None without streams."""
    found = infer_all(streams)
    return found[0] if found else None


def infer_all(streams: list[list[Token]]) -> list[tuple]:
    """Wrappers that together match all streams, whatever their order."""
    counts = Counter(slotted(start(s)) for s in streams)
    return [w for w, _ in cover(list(counts.items()))]


def slotted(items: tuple) -> tuple:
    return tuple(Group(slotted(x.items), x.least, x.many) if isinstance(x, Group) else x if is_markup(x) else SLOT for x in items)


def cover(shapes: list[tuple[tuple, int]]) -> list[tuple[tuple, int]]:
    """(wrapper, support) pairs, so that each of the (shape, count) pairs is matched by a wrapper; most support first.

    A shape is a collapsed stream or a wrapper. It joins the first wrapper that matches it or can be aligned with it so that
    the wrapper still matches what it was made of; those a wrapper has lost by later alignments are covered anew.
    """
    left = sorted(shapes, key=lambda x: (-x[1], str(written(x[0]))))
    out: list[tuple[tuple, int]] = []
    while left:
        found: list[tuple[tuple, list[tuple]]] = []
        for shape, _ in left:
            if any(fits(w, shape) for w, _ in found):
                continue
            for k, (w, made_of) in enumerate(found):
                merged = align(w, shape)
                if merged is not None and all(fits(merged, x) for x in (*made_of, shape)):
                    found[k] = (merged, [*made_of, shape])
                    break
            else:
                found.append((shape, [shape]))
        support = [0] * len(found)
        lost = []
        for shape, n in left:
            at = next((k for k, (w, _) in enumerate(found) if fits(w, shape)), None)
            if at is None:
                lost.append((shape, n))
            else:
                support[at] += n
        out += [(w, n) for (w, _), n in zip(found, support)]
        if len(lost) == len(left):  # shapes that can't be read as they stand are their own wrappers
            return out + lost
        left = lost
    return sorted(out, key=lambda x: (-x[1], str(written(x[0]))))


def fits(wrapper: tuple, shape: tuple) -> bool:
    """Whether the wrapper matches the shape's streams, its groups being there once, twice or, if they may, not at all."""
    return wrapper == shape or all(extract(wrapper, unrolled(shape, n)) is not None for n in (0, 1, 2))


def unrolled(shape: tuple, times: int) -> list[Token]:
    out: list[Token] = []
    for x in shape:
        if isinstance(x, Group):
            out += unrolled(x.items, times) * (max(times, x.least) if x.many else min(1, max(times, x.least)))
        else:
            out.append(x if is_markup(x) else (False, "x"))
    return out


# Markup after which a new line of a record begins.
BREAKS = {"|-", "<tr>", "<li>", "<dt>", "<dd>", "\\item"}


def extract(wrapper: tuple, stream: list[Token]) -> list[list[str]] | None:
    """The texts in the stream's slots, line by line; None if the stream doesn't match.

    A line begins where markup says so. Markup that ends in = labels the text after it. Groups are taken as often as they
    match.
    """

    def take(items: tuple, at: int, out: list[str | None]) -> int | None:
        for x in items:
            if isinstance(x, Group):
                n = 0
                while True:
                    inner: list[str | None] = []
                    end = take(x.items, at, inner)
                    if end is None or end == at:
                        break
                    out += inner
                    at, n = end, n + 1
                    if not x.many:
                        break
                if n < x.least:
                    return None
            elif at >= len(stream) or is_markup(x) and stream[at] != x or not is_markup(x) and stream[at][0]:
                return None
            else:
                token = stream[at][1]
                if not is_markup(x):  # a slot, or a text that was the same so far
                    out.append(token)
                elif token in BREAKS or token.startswith("<tr"):
                    out.append(None)
                elif token.endswith("=") and len(token) > 1:
                    out.append(token)
                at += 1
        return at

    events: list[str | None] = []
    if take(wrapper, 0, events) != len(stream):
        return None
    rows: list[list[str]] = [[]]
    label = ""
    for e in events:
        if e is None:
            rows.append([])
            label = ""
        elif e.endswith("=") and len(e) > 1:
            label = e[:-1].strip() + ": "
        else:
            rows[-1].append(label + e)
            label = ""
    return [r for r in rows if r]


def spelled(wrapper: tuple) -> str:
    """A wrapper as a pattern to read: markup as it is, # for a slot, (...)? and (...)+."""
    out = []
    for x in wrapper:
        if isinstance(x, Group):
            out.append("(" + spelled(x.items) + ")" + ("*" if x.many and not x.least else "+" if x.many else "?"))
        else:
            out.append("#" if isinstance(x, Slot) or not x[0] else x[1])
    return " ".join(out)
