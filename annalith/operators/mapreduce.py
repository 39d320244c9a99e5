"""Generic map and reduce with Python functions, for jobs that column expressions can't say."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Map = Callable[[dict], Iterable[tuple[str, object]]]
Reduce = Callable[[str, list], object]


def map_reduce(df: DataFrame, map_fn: Map, reduce_fn: Reduce, value_type: str, result_type: str, combine: bool = False, on_error: str = "raise") -> DataFrame:
    """key, value: ``map_fn`` gives (key, value) pairs for each row, a dict; ``reduce_fn`` makes one value of a key's list.

    ``combine`` says that ``reduce_fn`` may also be applied to parts of a list and to its own results (so ``value_type`` is
    ``result_type``); it then runs in each task before the shuffle, and a key that owns most pairs stays light. A result of
    None drops the key. With ``on_error`` "skip" a row or key whose function fails is logged and left out; otherwise it
    ends the job. Null keys are dropped.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error is raise or skip")
    if combine and value_type != result_type:
        raise ValueError("what is combined has the type of the result")

    def guarded(f, *args):
        try:
            return f(*args)
        except Exception:
            if on_error == "raise":
                raise
            logging.getLogger(__name__).exception("left out")
            return None

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for f in frames:
            pairs = [(str(k), v) for row in f.to_dict("records") for k, v in (guarded(lambda r: list(map_fn(r)), row) or ()) if k is not None]
            if not combine:
                yield pd.DataFrame(pairs, columns=["key", "value"])
                continue
            for k, v in pairs:
                held.setdefault(k, []).append(v)
                if len(held[k]) > 1000:
                    held[k] = [guarded(reduce_fn, k, held[k])]
            if len(held) > 100_000:
                yield pd.DataFrame([(k, guarded(reduce_fn, k, v)) for k, v in held.items()], columns=["key", "value"])
                held = {}
        if held:
            yield pd.DataFrame([(k, guarded(reduce_fn, k, v)) for k, v in held.items()], columns=["key", "value"])

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame["key"].iloc[0]
        value = guarded(reduce_fn, key, [v for v in frame["value"] if v is not None])
        return pd.DataFrame([(key, value)] if value is not None else [], columns=["key", "value"])

    pairs = df.mapInPandas(emit, f"key string, value {value_type}")
    return pairs.where(F.col("key").isNotNull()).groupBy("key").applyInPandas(finish, f"key string, value {result_type}")
