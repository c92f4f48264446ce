"""Best-fit packing by hierarchical residual packing.

1. Every document becomes ids of a public tokenizer plus an end id; only documents longer than a
   sequence are cut, into full pieces and a shorter last one. Full pieces are sequences already.
2. Each partition best-fits its pieces into bins, longest first in chunks of ``CHUNK`` pieces; bins
   stay open for later chunks. Bins with at most ``slack`` tokens free are done.
3. The underfull bins become items of their own and meet in a tree: each node takes the bins of
   ``FAN_IN`` nodes below it and best-fits them again, until one node is left. A bin that goes into
   another points to it; the few moves are composed and joined to the pieces at the end.

A node takes no more bins of one fill than can find use in the rounds that are left (``reach``; the
others would come out as they went in), so its memory is bounded by the capacity, not by the input.
A leaf holds a chunk of pieces and the fills of its partition's bins. Nothing is dropped: a bin that
no other fits stays a sequence.

Ids are kept by word in each worker; texts with characters beyond printable ASCII, Latin letters
and common punctuation, or with a special token's mark, go through the tokenizer whole.

Defined cases: null text is empty and yields the end id alone; ids that repeat or are null stay
rows of their own; equal pieces are packed one by one, and which of them is where follows the order
of rows; an empty table gives no rows; a long text is tokenized whole, in one task; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import arrow_map, by_size, cut, keep_for_next

CAPACITY = 4096
SLACK = 8
FAN_IN = 8
CHUNK = 200_000
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
_CACHE = 600_000

#: Fixed value: how the tokenizer splits lower-case text into words.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_UNUSUAL = re.compile("[^\\t\\n\\r -~\\u00a1-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]|<\\|")


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer never joins what white space or its word pattern splits, so ids are kept for
    runs of non-space characters and for the words in them. Words are learned as one text: the
    last token of each word is one that ends words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def _learn(self, runs: set[str]) -> None:
        split = {r: _WORDS.findall(r) for r in runs if not r.isalpha()}
        new = {r for r in runs if r not in split}.union(*split.values()).difference(self.known)
        words = list(new)
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            last = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            for word, a, b in zip(some, [0, *last], last, strict=False):
                self.known[word] = raw[a:b]
            if len(last) != len(some):
                raise AssertionError("words and word ends differ in number")
        for r, own in split.items():
            self.known[r] = b"".join(map(self.known.__getitem__, own))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        found: list[tuple] = []
        missing: set[str] = set()
        for text in texts:
            if _UNUSUAL.search(text):
                found.append((None, text, ()))
                continue
            runs = text.lower().split()
            ids = list(map(self.known.get, runs))
            holes = [i for i, own in enumerate(ids) if own is None]
            missing.update([runs[i] for i in holes])
            found.append((ids, [runs[i] for i in holes], holes))
        self._learn(missing)
        for ids, runs, holes in found:
            if ids is None:
                yield np.asarray(self.tokenizer.encode(runs, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            for i, run in zip(holes, runs, strict=True):
                ids[i] = self.known[run]
            yield b"".join(ids)
        if len(self.known) > _CACHE:
            self.known.clear()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for a worker process, until it turns to tasks that use none."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    keep_for_next("word tokenizers", _TOKENIZERS.clear)
    return _TOKENIZERS[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _tokenize(path: str, capacity: int, schema: pa.Schema):
    """Pieces of batches of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for whole in batches:
            for batch in by_size(whole, "text", 2_000_000):
                out: list[list] = [[] for _ in schema]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text").to_pylist()), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row = [doc, n, at // 4, len(part) // 4, zlib.crc32(part)]
                        for column, value in zip(out, [*row, np.frombuffer(part, "<u4")] if "ids" in schema.names else row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _PIECES
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return arrow_map(_texts(docs), _tokenize(path, capacity, schema), kind)


class Bins:
    """Bins that are not full, by free space; a bit mask finds the least free space that is large enough."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.mask = capacity, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fill: list[int] = []

    def put(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each item; longest items first, fullest bin that fits."""
        at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        by_free, fill, mask = self.by_free, self.fill, self.mask
        order = np.argsort(-lengths, kind="stable")
        for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
            fits = mask >> n
            if fits:
                free = n + (fits & -fits).bit_length() - 1
                b = by_free[free].pop()
                if not by_free[free]:
                    mask &= ~(1 << free)
            else:
                free, b = self.capacity, len(fill)
                fill.append(0)
            at[i], offset[i] = b, fill[b]
            fill[b] += n
            left = free - n
            if left:
                by_free[left].append(b)
                mask |= 1 << left
        self.mask = mask
        return at, offset


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin."""
    bins = Bins(capacity)
    at, offset = bins.put(lengths)
    return at, offset, np.asarray(bins.fill, np.int64)


def _places(fill: np.ndarray) -> np.ndarray:
    """Each bin's number among those of its fill."""
    order = np.argsort(fill, kind="stable")
    f = fill[order]
    head = np.concatenate([[True], f[1:] != f[:-1]])
    out = np.empty(len(fill), np.int64)
    out[order] = np.arange(len(f)) - np.maximum.accumulate(np.where(head, np.arange(len(f)), 0))
    return out


def _leaves(capacity: int, slack: int):
    """Pieces with bin and offset, and a row (with ``fill``) for each bin that is not nearly full."""
    kind = pa.schema([*_PIECES, ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("place", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        bins = Bins(capacity)

        def pack(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            b, offset = bins.put(t["length"].to_numpy())
            none = pa.nulls(len(b), pa.int64())
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in t.columns), pa.array((node << 40) + b), pa.array(offset), none, none, none], schema=kind)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:  # bins stay open for the pieces of later chunks
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)
        fill = np.asarray(bins.fill, np.int64)
        some = np.flatnonzero(fill < capacity - slack)
        for a in range(0, len(some), CHUNK):
            own, place = some[a : a + CHUNK], _places(fill[some])[a : a + CHUNK]
            made = [pa.array((node << 40) + own), pa.nulls(len(own), pa.int64()), pa.array(fill[own]), pa.array(place), pa.array(np.full(len(own), node))]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(own), f.type) for f in _PIECES), *made], schema=kind)

    return run


def _node(capacity: int, slack: int):
    """Of bins (bin, fill): a row for each that moves into another (moved, bin, shift), and for each that is still not nearly full (bin, fill, place)."""
    kind = pa.schema([("node", pa.int64()), ("bin", pa.int64()), ("moved", pa.int64()), ("shift", pa.int64()), ("fill", pa.int64()), ("place", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        node, ident = table["node"][0].as_py(), table["bin"].to_numpy()
        b, offset, fill = best_fit(table["fill"].to_numpy(), capacity)
        host = np.empty(len(fill), np.int64)
        host[b[offset == 0]] = ident[offset == 0]
        gone, some = np.flatnonzero(offset > 0), np.flatnonzero(fill < capacity - slack)
        n, none = len(gone), pa.nulls(len(gone), pa.int64())
        moved = pa.Table.from_arrays([pa.array(np.full(n, node)), pa.array(host[b[gone]]), pa.array(ident[gone]), pa.array(offset[gone]), none, none], schema=kind)
        none = pa.nulls(len(some), pa.int64())
        left = pa.Table.from_arrays([pa.array(np.full(len(some), node)), pa.array(host[some]), none, none, pa.array(fill[some]), pa.array(_places(fill[some]))], schema=kind)
        return pa.concat_tables([moved, left])

    return run


def reach(fan_in: int, levels: int) -> int:
    """How many bins of one fill can find use in ``levels`` more rounds.

    Best fit leaves one bin at most that is half full or less: of two, the second would have gone into
    the first. Two bins over half never meet, so a round moves at most one bin from each of ``fan_in``
    nodes and takes as many hosts of a fill at most. Bins beyond that number stay as they are."""
    return fan_in * levels


_LEAVES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, place long, node long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    return _tree(cut(arrow_map(pieces, _leaves(capacity, slack), _LEAVES)), capacity, slack, fan_in)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of documents with sequence_id and offset: as ``pack`` of ``tokenized_pieces``, but one Python worker a task does both."""
    tokenize, fill = _tokenize(path, capacity, _PIECES), _leaves(capacity, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fill(tokenize(batches))

    return _tree(cut(arrow_map(_texts(docs), run, _LEAVES)), capacity, slack, fan_in)


def _tree(leaves: DataFrame, capacity: int, slack: int, fan_in: int) -> DataFrame:
    nodes = leaves.rdd.getNumPartitions()
    levels = 1
    while fan_in**levels < nodes:
        levels += 1
    items = leaves.filter("fill is not null").select("node", "bin", "fill", "place")
    moves = None
    for level in range(levels):
        used = items.filter(F.col("place") < reach(fan_in, levels - level))
        met = used.select(F.floor(F.col("node") / fan_in).alias("node"), "bin", "fill")
        packed = cut(met.groupBy("node").applyInArrow(_node(capacity, slack), "node long, bin long, moved long, shift long, fill long, place long"))
        now = packed.filter("moved is not null").select(F.col("moved").alias("from"), F.col("bin").alias("to"), "shift")
        if moves is None:
            moves = now
        else:  # what went into a bin that moves now goes along
            on = now.select(F.col("from").alias("f"), F.col("to").alias("t"), F.col("shift").alias("more"))
            along = moves.join(on, F.col("to") == F.col("f"), "left")
            moves = along.select("from", F.coalesce("t", "to").alias("to"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")).unionByName(now)
        items = packed.filter("fill is not null").select("node", "bin", "fill", "place")
    placed = leaves.filter("length is not null")
    joined = placed.join(moves, F.col("bin") == F.col("from"), "left")
    return joined.select(
        *_PIECES.names,
        F.coalesce("to", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"),
    )
