"""Filling containers of fixed capacity with items, by bounded-space online packing.

Items come in as a stream. A fixed number of windows is open in each part of the data; an item goes into the open window
that it fills best; when none has room, the fullest is handed on and a new one is opened. Parts are as many as the items
ask for. What is open at the end of a part, a fixed number of windows, is merged with the leftovers of other parts, whole
windows at a time, in rounds of a fixed number of parts: each round hands on its emptiest windows, as many as a part leaves.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalith.session import checkpointed

OPEN_WINDOWS = 64
#: Items of a part, about; so the number of parts, and with it of tasks, grows with the items.
PART_ITEMS = 20_000
#: Parts whose leftovers are merged in one place.
MERGED_PARTS = 64
#: Pieces of open windows that a task holds back before it hands them on as still open.
HELD = 200_000


class Packer:
    """The windows of one part and one capacity."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.made = 0
        self.handed_on: int | None = None  # the window closed last
        self.open: list[tuple[int, int]] = []  # (room left, window), the fullest first

    def place(self, size: int) -> int:
        """The window that takes an item of at most the capacity."""
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.windows:
                self.handed_on = self.open.pop(0)[1]
            room, window = self.capacity, self.made
            self.made += 1
        if room > size:
            bisect.insort(self.open, (room - size, window))
        return window

    def pieces(self, size: int) -> Iterator[tuple[int, int, int]]:
        """(window, start, length) of an item: one, or if it exceeds the capacity full windows and the rest."""
        start = 0
        while size - start > self.capacity:
            yield self.made, start, self.capacity
            self.made += 1
            start += self.capacity
        yield self.place(size - start), start, size - start


def merge_leftovers(fills: list[tuple[str, int]], capacity: int) -> dict[str, str]:
    """Which leftover window joins which: best fit, largest first; equal fills by name."""
    into: dict[str, str] = {}
    open_: list[tuple[int, str]] = []
    for name, fill in sorted(fills, key=lambda x: (-x[1], x[0])):
        at = bisect.bisect_left(open_, (fill, ""))
        room, home = open_.pop(at) if at < len(open_) else (capacity, name)
        into[name] = home
        if room > fill:
            bisect.insort(open_, (room - fill, home))
    return into


def merged_homes(leftovers: DataFrame, capacities: dict, windows: int, parts: int, width: int) -> DataFrame:
    """pack, window, home: where each leftover window ends up. ``leftovers`` has pack, window, length and part.

    Each round merges the windows of ``width`` parts in one place, at most width x windows of a pack, and hands on the
    ``windows`` of them with most room, until the parts are one.
    """
    kind = leftovers.schema["pack"].dataType.simpleString()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        p = frame["pack"].iloc[0]
        size = dict(zip(frame["window"], frame["length"].astype(int)))
        into = merge_leftovers(list(size.items()), capacities[p])
        fill: dict[str, int] = {}
        for name, home in into.items():
            fill[home] = fill.get(home, 0) + size[name]
        on = set(sorted(fill, key=lambda h: (fill[h], h))[:windows])
        return pd.DataFrame({"pack": p, "part": frame["part"].iloc[0], "window": list(into), "home": list(into.values()), "length": [fill[h] for h in into.values()], "on": [h in on for h in into.values()]})

    left, homes = leftovers, None
    while homes is None or parts > 1:
        parts = -(-parts // width)
        schema = f"pack {kind}, part long, window string, home string, length long, on boolean"
        found = checkpointed(left.withColumn("part", F.floor(F.col("part") / width)).groupBy("pack", "part").applyInPandas(merge, schema))
        step = found.select("pack", F.col("window").alias("home"), F.col("home").alias("next"))
        if homes is None:
            homes = found.select("pack", "window", "home")
        else:
            homes = homes.hint("merge").join(step, ["pack", "home"], "left").select("pack", "window", F.coalesce("next", "home").alias("home"))
        left = found.where(F.col("on") & (F.col("window") == F.col("home"))).select("pack", "part", "window", "length")
    return homes


def pack_items(
    items: DataFrame,
    packs: DataFrame,
    ident: str,
    size: str,
    pack: str,
    capacity: str,
    windows: int = OPEN_WINDOWS,
    part_items: int = PART_ITEMS,
    merged_parts: int = MERGED_PARTS,
) -> DataFrame:
    """One row for each piece of an item in a container, for each pack: pack, container, ``ident``, start, length.

    ``items`` has one row for each ``ident`` with a whole ``size``; a null or negative size counts as 0, and an item of size
    0 lies in a container without using room. ``packs`` is a small table of capacities, of a fixed number of rows (1,000 at
    most, or an error); a capacity that is null or under 1 is left out. Only items larger than the capacity are cut, into
    pieces of the whole capacity and a rest. The result depends on the items alone, not on how rows are spread: an item's
    part is a hash of its identifier, there are (items / ``part_items``) parts, and parts are packed in the order of
    identifiers (as text; a null one is one like others). Empty inputs give an empty result.

    Only rows of windows that are open at a part's end are joined with the merged windows; all others are final.
    """
    if part_items < 1 or windows < 1 or merged_parts < 2:
        raise ValueError("part_items and windows are 1 at least, merged_parts 2")
    sizes = [(r[0], r[1]) for r in packs.select(pack, capacity).distinct().limit(1001).collect() if r[1] is not None and r[1] >= 1]
    if len(sizes) > 1000:
        raise ValueError("more than 1,000 capacities")
    kind = items.schema[ident].dataType.simpleString()
    pack_kind = packs.schema[pack].dataType.simpleString()
    schema = f"pack {pack_kind}, part long, window string, item string, start int, length int, state int"
    closed, still_open, leftover = range(3)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, packers, held, waiting = None, {}, {}, 0

        def rows_of(out: list) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["pack", "part", "window", "item", "start", "length", "state"])

        def drained(p, w: int, state: int) -> list:
            return [(p, part, f"{part}-{w}", item, start, length, state) for item, start, length in held[p].pop(w, ())]

        def leftovers() -> list:
            out = []
            for p, packer in packers.items():
                left = {w for _, w in packer.open}
                out += [(p, part, f"{part}-{w}", None, 0, packer.capacity - room, leftover) for room, w in packer.open]
                for w in list(held[p]):
                    out += drained(p, w, still_open if w in left else closed)
            return out

        for frame in frames:
            out: list = []
            for where, item, n in zip(frame["part"], frame["item"], frame["size"]):
                if where != part:
                    out += leftovers()
                    part, packers, held, waiting = where, {p: Packer(c, windows) for p, c in sizes}, {p: {} for p, _ in sizes}, 0
                for p, packer in packers.items():
                    for w, start, length in packer.pieces(int(n)):
                        held[p].setdefault(w, []).append((item, start, length))
                        waiting += 1
                    if packer.handed_on is not None:
                        out += drained(p, packer.handed_on, closed)
                        packer.handed_on = None
            if waiting > HELD:  # few windows can hold very many items of size 0
                for p, packer in packers.items():
                    left = {w for _, w in packer.open}
                    for w in list(held[p]):
                        out += drained(p, w, still_open if w in left else closed)
                waiting = 0
            yield rows_of(out)
        yield rows_of(leftovers())

    numbered = items.select(F.col(ident).cast("string").alias("item"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).alias("size"))
    parts = max(1, -(-numbered.count() // part_items))
    spread = (
        numbered.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
        .repartitionById(parts, F.col("part").cast("int"))
        .sortWithinPartitions("part", "item")
    )
    filled = checkpointed(spread.mapInPandas(fill, schema))
    left = filled.where(F.col("state") == leftover).select("pack", "part", "window", F.col("length").cast("long").alias("length"))
    homes = merged_homes(left, dict(sizes), windows, parts, merged_parts)
    final = filled.where(F.col("state") == closed).select("pack", F.col("window").alias("container"), "item", "start", "length")
    merged = (
        filled.where(F.col("state") == still_open)
        .hint("merge")
        .join(homes, ["pack", "window"], "left")
        .select("pack", F.coalesce("home", "window").alias("container"), "item", "start", "length")
    )
    return final.unionByName(merged).select(F.col("pack").alias(pack), "container", F.col("item").cast(kind).alias(ident), "start", "length")
