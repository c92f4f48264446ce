"""Fill-in-middle: texts cut at two unit boundaries and put in another order between sentinels.

A text is kept as its maximal runs of one character class, with the number of units up to the end of
each run. A cut after k units is found by a binary search for the run that holds the k-th unit; its
place is the run's start plus the units that are left times the run's bytes per unit. No list of units
is made. Classes and units are

* ``unit="token"``: white space against the rest. A run of the rest, with the white space before it, is
  one unit; white space that ends a text is one too.
* ``unit="char"``: classes by the characters' number of UTF-8 bytes; each code point is a unit.

``h1`` to ``h4`` are the first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``. The prefix ends
after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after the larger. A text is
plain if it is empty, contains a sentinel, or ``h3 % 100 >= rate``; else ``spm`` if ``h4 % 100 < spm``,
else ``psm``. No sentinel can begin inside another, so that the output and its form give the text back.

Defined cases: null text is empty; a null id is an empty string behind the seed; rows that repeat, or share
an id, are transformed one by one; a text of any length is read in whole by one task; an empty table
gives no rows; a column of ``keep`` that clashes with one of the result raises ``ValueError``, other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import arrow_map, by_size

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM, SEED = 50, 80, 42

_SPACES = np.zeros(256, np.uint8)
_SPACES[[0x20, *range(0x09, 0x0E)]] = 1
#: Bytes of a character by its first byte; bytes that continue one have none.
_WIDTHS = np.repeat(np.array([1, 0, 2, 3, 4], np.uint8), [128, 64, 32, 16, 16])


class Runs:
    """The runs of many texts: where each starts and ends, and units up to its end, over all texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        if unit == "token":
            classes, heads = _SPACES[data], np.ones(len(data), bool)
        elif unit == "char":
            classes = _WIDTHS[data]
            heads = classes > 0
        else:
            raise ValueError(f"no such unit: {unit}")
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        kinds = classes[heads]
        edge[np.flatnonzero(heads)[1:]] |= kinds[1:] != kinds[:-1]
        edge[len(data)] = False
        self.offsets = offsets
        self.start = np.flatnonzero(edge)
        self.end = np.append(self.start[1:], len(data))
        kind, size = classes[self.start], self.end - self.start
        if unit == "token":
            last = np.isin(self.end, offsets)
            units = np.where((kind == 0) | last, 1, 0)
        else:
            units = size // np.maximum(kind, 1)
        self.step = size // np.maximum(units, 1)
        self.total = np.cumsum(units)
        #: Units before each text, and the units of each text.
        before = np.concatenate([[0], self.total])[np.searchsorted(self.start, offsets)]
        self.base, self.n = before[:-1], np.diff(before)

    def place(self, cut: np.ndarray) -> np.ndarray:
        """Where the prefix of ``cut`` units of each text ends, in bytes of all texts."""
        if not len(self.start):
            return self.offsets[:-1].copy()
        run = np.minimum(np.searchsorted(self.total, self.base + cut), len(self.start) - 1)
        units = np.diff(self.total, prepend=0)[run]
        at = self.start[run] + (self.base + cut - (self.total[run] - units)) * self.step[run]
        return np.where(cut > 0, at, self.offsets[:-1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each text starts, with the end; nulls are empty."""
    whole = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = whole.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(whole) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def _with_sentinel(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts contain a sentinel."""
    found = np.zeros(len(offsets) - 1, bool)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        mark = np.frombuffer(sentinel.encode(), np.uint8)
        at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
        for k in range(1, len(mark)):
            at = at[data[at + k] == mark[k]]
        text = np.searchsorted(offsets, at, side="right") - 1
        found[text[at + len(mark) <= offsets[text + 1]]] = True
    return found


def _transformed(batch: pa.RecordBatch, kept: list[str], unit: str, rate: int, spm: int) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column("text"))
    runs = Runs(data, offsets, unit)
    h = [batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)]
    one, two = h[0] % (runs.n + 1), h[1] % (runs.n + 1)
    a, b = runs.place(np.minimum(one, two)), runs.place(np.maximum(one, two))
    plain = (np.diff(offsets) == 0) | _with_sentinel(data, offsets) | (h[2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    raw, p, s, m = data.tobytes(), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for kind, start, x, y, end in zip(form.tolist(), offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), strict=True):
        if kind == "plain":
            out.append(raw[start:end])
        elif kind == "psm":
            out.append(b"".join((p, raw[start:x], s, raw[y:end], m, raw[x:y])))
        else:
            out.append(b"".join((s, raw[y:end], p, raw[start:x], m, raw[x:y])))
    first = np.minimum(offsets[:-1], len(data))
    chars = [pa.array(v, pa.int64(), mask=plain) for v in (heads[a] - heads[first], heads[b] - heads[a])]
    columns = [*(batch.column(f"keep_{c}") for c in kept), pa.array(runs.n, pa.int64()), pa.array(form.tolist(), pa.string()), *chars, pa.array(out, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*(f"keep_{c}" for c in kept), "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), unit: str = "token", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """The columns of ``keep``, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and the ``output``."""
    if clash := {"n", "form", "prefix_chars", "middle_chars", "output"} & set(keep):
        raise ValueError(f"columns to keep clash with the result's: {sorted(clash)}")
    if unit not in ("token", "char"):
        raise ValueError(f"no such unit: {unit}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    read = docs.select(*(F.col(c).alias(f"keep_{c}") for c in keep), "text", *groups)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`keep_{c}` {kinds[c]}" for c in keep), "n long, form string, prefix_chars long, middle_chars long, output string"])
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "text"):
                yield _transformed(part, kept, unit, rate, spm)

    return arrow_map(read, run, schema).withColumnsRenamed({f"keep_{c}": c for c in keep})


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from the output and its form by Spark's own functions."""
    part = F.split(F.substr(output, F.lit(1 + len(PREFIX))), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[0], part[2], part[1])).otherwise(F.concat(part[1], part[2], part[0]))


def fim_digest(transformed: DataFrame) -> DataFrame:
    """Digests of the output and of the text rebuilt from it."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
