"""Caches of bounded count, as a pass over a timeline's frames."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered

#: Frames that text recognition remembers, images that the segmenter remembers, and the step of a key's pixels.
TEXT_FRAMES, IMAGES, STEP = 100, 50, 8


def frame_key(pixels: Column, height: Column, width: Column, step: int = STEP) -> Column:
    """md5 of every ``step``-th pixel of every ``step``-th row of an RGB frame, given as bytes; null for a frame of another size."""

    def run(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        def key(p, h, w):
            if p is None or pd.isna(h) or pd.isna(w) or len(p) != int(h) * int(w) * 3:
                return None
            return hashlib.md5(np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3)[::step, ::step].tobytes()).hexdigest()

        return pd.Series([key(*x) for x in zip(pixels, height, width)], dtype=object)

    return F.pandas_udf(run, "string")(pixels, height, width)


class Fifo:
    """A cache of at most ``most`` keys. A miss adds its key and evicts, where it is full, the ``oldest`` one, or the one of the ``least`` frame number; a hit changes nothing. Keys that are null are never found and never kept."""

    def __init__(self, most: int = TEXT_FRAMES, evicts: str = "oldest"):
        self.most, self.evicts = most, evicts
        self.held: OrderedDict[str, int] = OrderedDict()

    def step(self, key: str | None, number: int) -> bool:
        if key is None or key in self.held:
            return key is not None
        while len(self.held) >= self.most:
            if self.evicts == "oldest":
                self.held.popitem(last=False)
            else:
                del self.held[min(self.held, key=self.held.get)]
        self.held[key] = number
        return False

    def state(self) -> dict:
        return {"held": list(self.held.items())}

    def restore(self, state: dict) -> Fifo:
        self.held = OrderedDict((k, n) for k, n in state["held"])
        return self


def lookups(frames: DataFrame, most: int = TEXT_FRAMES, evicts: str = "oldest") -> DataFrame:
    """Frames (timeline_id, seq, key, ...) with ``hit``: whether a cache that has seen the timeline's earlier frames finds the key. A timeline is one pass, a batch at a time; what it remembers is bounded."""
    return ordered.walk(frames, ["timeline_id"], ["seq"], ["key", "seq"], lambda: Fifo(most, evicts).step, "hit", "boolean")
