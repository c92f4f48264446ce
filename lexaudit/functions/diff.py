"""Word diff of two texts: runs of equal, removed and added words."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

_TOKEN = re.compile(r"\S+\s*|\s+")


class _Tails:
    """Lengths of the longest common parts of all tails of two lists of words, by rows; a row follows from the next.

    Kept are every ``step``-th row and the rows of one block, which are made again when the walk comes to it:
    with a step of the square root of the rows the memory is that of twice as many rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.step = max(1, int(len(x) ** 0.5))
        self.block, self.first = np.zeros((0, 0), np.int32), -1
        self.kept = {len(x): np.zeros(len(y) + 1, np.int32)}
        row = self.kept[len(x)]
        for i in range(len(x) - 1, -1, -1):
            row = self._above(i, row)
            if i % self.step == 0:
                self.kept[i] = row

    def _above(self, i: int, below: np.ndarray) -> np.ndarray:
        row = np.zeros_like(below)
        take = np.where(self.y == self.x[i], below[1:] + 1, below[:-1])
        row[:-1] = np.maximum.accumulate(take[::-1])[::-1]
        return row

    def row(self, i: int) -> np.ndarray:
        """The row of tails from word ``i`` of the first list on."""
        if i in self.kept:
            return self.kept[i]
        first = i - i % self.step
        if first != self.first:
            end = min(first + self.step, len(self.x))
            rows, row = [], self.kept[end]
            for k in range(end - 1, first - 1, -1):
                row = self._above(k, row)
                rows.append(row)
            self.block, self.first = rows[::-1], first
        return self.block[i - first]


def word_diff(old: str | None, new: str | None) -> list[dict]:
    """Segments {type, text}; words keep the space behind them, removals stand before additions.

    As many words stay as can. Time grows with the product of the numbers of words, memory with one of
    them times the square root of the other."""
    a, b = _TOKEN.findall(old or ""), _TOKEN.findall(new or "")
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a], np.int64)
    y = np.array([ids.setdefault(w, len(ids)) for w in b], np.int64)
    short = min(len(x), len(y))
    apart = np.flatnonzero(x[:short] != y[:short])
    start = int(apart[0]) if len(apart) else short  # what both begin with stays whatever follows
    tails = _Tails(x[start:], y[start:])
    out: list[dict] = []

    def put(kind: str, word: str) -> None:
        if out and out[-1]["type"] == kind:
            out[-1]["text"] += word
        else:
            out.append({"type": kind, "text": word})

    for word in a[:start]:
        put("same", word)
    i = j = start
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and x[i] == y[j]:
            put("same", a[i])
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or tails.row(i + 1 - start)[j - start] >= tails.row(i - start)[j + 1 - start]):
            put("removed", a[i])
            i += 1
        else:
            put("added", b[j])
            j += 1
    return out


@F.pandas_udf(ArrayType(StructType().add("type", StringType()).add("text", StringType())))
def diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([word_diff(a, b) for a, b in zip(old, new, strict=True)])
