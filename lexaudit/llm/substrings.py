"""Exact removal of repeated 50-byte strings by sharded suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id. Documents are cut into super-windows: maximal runs of windows of ``LENGTH`` bytes
with the same minimizer, the least hash of their ``K``-byte substrings. Equal windows have equal
minimizers, so they meet in the shard their minimizer is dealt to, and nowhere else need be looked.

In a shard, super-windows that can share no window with another document are set aside (by the
minimizer and half a window beside it); the distinct others become one text, whose suffix and common-prefix arrays (external induced sorting,
``suffix``) give all windows that are equal, and each such class its smallest doc_id. Ranges of
windows whose class has a smaller doc_id than their own document go back to the documents, each
with a hash of its bytes, so that rows that share a doc_id cannot take each other's ranges.

Shards and blocks are sized by the input's bytes. A text that occurs thousands of times compresses
to references within a map task, and is one entry of its shard's text. A shard's queues spill.

Defined cases: null text is empty; a row without doc_id keeps all and removes nothing elsewhere;
rows that share a doc_id don't remove each other; rows that repeat stay rows of their own; an empty
table gives no rows; texts shorter than ``LENGTH`` bytes stay whole; a long text is cut into
super-windows in one task and dealt out; columns that are not asked for are ignored, and one in
``keep`` must not have a name made here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import arrow_map, by_size, default_parallelism, trim
from lexaudit.llm.suffix import suffix_array

LENGTH = 50
K = 12
RUN = 64
SHARD_BYTES = 6_000_000
BLOCK_BYTES = 4_000_000
FLUSH_BYTES = 6_000_000
SLICE_BYTES = 700_000
HASH_STEP = 500_000
#: Bytes of super-windows for each byte of text: 69 for 20 windows on average.
BLOW_UP = 3.4

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def kmer_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the K bytes at every place; places less than K bytes from the end get padding."""
    padded = np.concatenate([raw, np.zeros(K, np.uint8)])
    out = np.empty(len(raw), np.uint64)
    for a in range(0, len(raw), HASH_STEP):  # piecewise, so that few arrays of this size are held
        n = min(HASH_STEP, len(raw) - a)
        at = np.ndarray((n,), "<u8", padded, a, (1,)).astype(np.uint64)
        after = np.ndarray((n,), "<u8", padded, a + K - 8, (1,)).astype(np.uint64)
        at *= _A
        after *= _B
        at ^= at >> np.uint64(29)
        at += after
        at ^= at >> np.uint64(32)
        at *= _C
        at ^= at >> np.uint64(29)
        out[a : a + n] = at
    return out


def window_minima(h: np.ndarray, width: int = LENGTH - K + 1) -> np.ndarray:
    """Least hash of each window's substrings."""
    m, size = h, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def super_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes; and of each super-window its text, place in the joined bytes, windows, minimizer."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(raw) < LENGTH:
        empty = np.zeros(0, np.int64)
        return raw, empty, empty, empty, np.zeros(0, np.uint64)
    least = window_minima(kmer_hashes(raw))[: len(raw) - LENGTH + 1]
    first = np.cumsum(size) - size
    n = np.maximum(size - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    key = least[start]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    new |= (np.arange(len(key)) - head) % RUN == 0
    at = np.flatnonzero(new)
    return raw, owner[at], start[at], np.diff(np.append(at, len(key))), key[at]


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _dealt(ids: np.ndarray, n: int) -> np.ndarray:
    """The block of each id, by a hash, so that ids in even steps spread too."""
    mixed = ids.astype(np.int64).view(np.uint64) * _A
    mixed ^= mixed >> np.uint64(32)
    mixed *= _C
    mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(n)).astype(np.int64)


def _squeeze(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed string; numbers with their bytes transposed."""
    parts = [len(columns[0]).to_bytes(4, "little")]
    for c in columns:
        data = c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() if c.dtype != np.uint8 else c.tobytes()
        parts.append(len(data).to_bytes(4, "little") + data)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _expand(data: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 4], "little")
        body = np.frombuffer(raw, np.uint8, size, at + 4)
        out.append(body if kind == np.uint8 else np.ascontiguousarray(body.reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel())
        at += 4 + size
    return out


def _deal(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            shard = np.concatenate([h[-1] for h in held])
            part = np.repeat(np.arange(len(held)), [len(h[-1]) for h in held])
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(n_shards + 1))
            doc, place, start, n, _ = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
            shards, payloads = [], []
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[s] : edges[s + 1]]
                texts = [_gather(held[p][0], start[i], n[i] + LENGTH - 1) for p in np.unique(part[own]).tolist() for i in [own[part[own] == p]]]
                ids = doc[own]
                shards.append(s)
                payloads.append(_squeeze(np.diff(ids, prepend=0), place[own].astype(np.uint32), n[own].astype(np.uint8), np.concatenate(texts)))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(payloads, pa.binary())], ["shard", "payload"])

        for whole in batches:
            for batch in by_size(whole, "text", SLICE_BYTES):
                texts = [t.encode() for t in batch.column("text").to_pylist()]
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                raw, owner, start, n, key = super_windows(texts)
                if not len(owner):
                    continue
                lengths = np.fromiter(map(len, texts), np.int64, len(texts))
                first = np.cumsum(lengths) - lengths
                mixed = key * _B
                mixed ^= mixed >> np.uint64(31)
                held.append((raw, ids[owner], start - first[owner], start, n, key, (mixed % np.uint64(n_shards)).astype(np.int64)))
                size += len(raw)
                if size >= FLUSH_BYTES:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return run


def _known_twice(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries' key is found in two documents or more."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key)
        k, d = key[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        out[order] = np.repeat(several, np.diff(np.append(head, len(order))))
    return out


def _may_repeat(doc: np.ndarray, size: np.ndarray, base: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Super-windows that can share a window with another document.

    A shared window holds the minimizer and ``LENGTH - K`` bytes around it, so half of these lie to one
    side: some place of the minimizer, with as many bytes to its left or to its right, must be known
    from two documents. Hashes that reach beyond a super-window are overwritten."""
    side = (LENGTH - K + 1) // 2
    h[((base + size)[:, None] - np.arange(1, K)).ravel()] = np.uint64(0xFFFFFFFFFFFFFFFF)
    key = np.minimum.reduceat(h, base)
    known = _known_twice(doc, key)
    least = np.flatnonzero(h == np.repeat(key, size))
    owner = np.searchsorted(base, least, side="right") - 1
    at = least - base[owner]
    some = known[owner]
    owner, at = owner[some], at[some]
    out = np.zeros(len(key), bool)
    for fits, a, b in ((at + K + side <= size[owner], _A, 1), (at >= side, _C, -1)):
        who = owner[fits]
        p = base[who] + at[fits]
        context = h[p] * a + h[p + b * (side // 2 + 1)] * _B + h[p + b * side] * (a ^ _B)
        out[who[_known_twice(doc[who], context)]] = True
    return out


def repeated_ranges(doc: np.ndarray, n: np.ndarray, raw: np.ndarray, memory: int = 64 << 20) -> tuple[np.ndarray, ...]:
    """Of a shard's super-windows: which have repeated ranges, from which window to which, and the range's hash.

    doc, n: document and number of windows of each super-window; raw: their bytes, joined."""
    size = n + LENGTH - 1
    base = np.cumsum(size) - size
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(raw) < LENGTH:
        return nothing
    pick = np.flatnonzero(_may_repeat(doc, size, base, kmer_hashes(raw)))
    if not len(pick):
        return nothing
    blob = raw.data
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(bytes(blob[a:b]), len(number)) for a, b in zip(base[pick].tolist(), (base + size)[pick].tolist(), strict=True)), np.int64, len(pick))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc[pick])
    text = b"\xff".join(number) + b"\xff"
    length = np.fromiter(map(len, number), np.int64, len(number)) + 1
    begin = np.cumsum(length) - length
    sa, lcp = suffix_array(np.frombuffer(text, np.uint8), LENGTH, memory)
    content = np.repeat(np.arange(len(number)), length)
    is_window = np.arange(len(text)) - begin[content] < (length - LENGTH)[content]
    ok = is_window[sa]
    new = (lcp < LENGTH) | ~ok
    new[1:] |= ~ok[:-1]
    head = np.flatnonzero(new)
    smallest = np.minimum.reduceat(least[content[sa]], head)
    owner = np.empty(len(text), np.int64)
    owner[sa] = np.repeat(smallest, np.diff(np.append(head, len(sa))))
    windows = n[pick]
    first = np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(pick)), windows)
    offset = np.arange(windows.sum()) - first[of]
    gone = owner[begin[which[of]] + offset] < doc[pick][of]
    before = np.concatenate([[False], gone[:-1]]) & (offset > 0)
    after = np.concatenate([gone[1:], [False]]) & (offset < windows[of] - 1)
    lo, hi = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    at = base[pick][of[lo]]
    check = np.fromiter((xxhash.xxh3_64_intdigest(blob[a:b]) for a, b in zip((at + offset[lo]).tolist(), (at + offset[hi] + LENGTH).tolist(), strict=True)), np.uint64, len(lo))
    return pick[of[lo]], offset[lo], offset[hi], check


_DEALT = [np.int64, np.uint32, np.uint8, np.uint8]
_FOUND = [np.int64, np.uint32, np.uint16, np.uint64]


def _search(n_blocks: int, memory: int):
    def searched(table: pa.Table) -> pa.Table:
        parts = [_expand(p, _DEALT) for p in table["payload"].to_pylist()]
        doc = np.concatenate([np.cumsum(p[0]) for p in parts])
        place = np.concatenate([p[1] for p in parts]).astype(np.int64)
        n = np.concatenate([p[2] for p in parts]).astype(np.int64)
        raw = np.concatenate([p[3] for p in parts])
        del parts
        which, lo, hi, check = repeated_ranges(doc, n, raw, memory)
        del raw
        trim()
        ids, start, size = doc[which], place[which] + lo, hi - lo + LENGTH
        block = _dealt(ids, n_blocks)
        order = np.lexsort((start, ids, block))
        if not len(order):  # nothing in this shard repeats
            return pa.table({"block": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})
        edges = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]]))
        blocks, payloads = [], []
        for a, b in zip(edges.tolist(), [*edges.tolist()[1:], len(order)], strict=True):
            own = order[a:b]
            blocks.append(int(block[own[0]]))
            payloads.append(_squeeze(np.diff(ids[own], prepend=0), start[own].astype(np.uint32), size[own].astype(np.uint16), check[own]))
        return pa.table({"block": pa.array(blocks, pa.int64()), "payload": pa.array(payloads, pa.binary())})

    def run(table: pa.Table) -> pa.Table:
        try:
            return searched(table)
        finally:
            trim()  # workers live on and wait for tasks of other stages

    return run


def merged_spans(text: bytes, ranges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs of a text, from ranges (start, size, hash) that hold for it."""
    spans: list[list[int]] = []
    for start, size, check in sorted(ranges):
        end = start + size
        if end > len(text) or xxhash.xxh3_64_intdigest(text[start:end]) != check:
            continue
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans]


def _pack(n_blocks: int):
    """Rows by block, compressed: what the last step needs of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", FLUSH_BYTES):
                block = _dealt(pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False), n_blocks)
                none = np.flatnonzero(pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False))
                if len(none):  # nothing is removed from rows without an id, so any block does
                    salt = TaskContext.get().partitionId()
                    block[none] = [xxhash.xxh3_64_intdigest(batch.column("text")[int(i)].as_py(), salt) % n_blocks for i in none]
                order = np.argsort(block, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]]))
                payloads = []
                for a, b in zip(edges.tolist(), [*edges.tolist()[1:], len(order)], strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                        out.write_batch(batch.take(pa.array(order[a:b])))
                    payloads.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(block[order][edges], pa.int64()), pa.array(payloads, pa.binary())], ["block", "rows"])

    return run


def _apply(keep: tuple[str, ...], with_text: bool):
    def applied(packed: pa.Table, found: pa.Table) -> pa.Table:
        by_doc: dict[int, list] = {}
        for p in found["payload"].to_pylist():
            step, start, size, check = _expand(p, _FOUND)
            for d, s, n, c in zip(np.cumsum(step).tolist(), start.tolist(), size.tolist(), check.tolist(), strict=True):
                by_doc.setdefault(d, []).append((s, n, c))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_text else pa.string()]
        tables = []
        for rows in packed["rows"].to_pylist():
            docs = next(iter(pa.ipc.open_stream(rows)))
            out: list[list] = [[], [], [], []]
            for d, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
                text = t.encode()
                spans = merged_spans(text, by_doc[d]) if d in by_doc else []
                left = text
                if spans:
                    edges = [0, *(x for span in spans for x in span), len(text)]
                    left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (len(text), len(text) - len(left), len(spans), left if with_text else hashlib.sha256(left).hexdigest())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            columns = [docs["doc_id"], *(docs[c] for c in keep), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            tables.append(pa.Table.from_arrays(columns, ["doc_id", *keep, "n_bytes", "n_removed", "n_spans", "kept" if with_text else "kept_sha256"]))
        return pa.concat_tables(tables)

    def run(packed: pa.Table, found: pa.Table) -> pa.Table:
        try:
            return applied(packed, found)
        finally:
            trim()

    return run


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), with_text: bool = False, memory: int = 64 << 20) -> DataFrame:
    """Per row: doc_id, the columns in ``keep``, n_bytes, n_removed, n_spans, and the kept bytes or their SHA-256."""
    spark = docs.sparkSession
    if clash := {"doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"}.intersection(keep):
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    total = flat.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = 2 * default_parallelism(spark)
    n_shards = max(least, int(total * BLOW_UP // SHARD_BYTES)) | 1
    n_blocks = max(least, total // BLOCK_BYTES) | 1
    dealt = arrow_map(flat.filter("doc_id is not null").select("doc_id", "text"), _deal(n_shards), "shard int, payload binary")
    found = dealt.groupBy("shard").applyInArrow(_search(n_blocks, memory), "block long, payload binary")
    packed = arrow_map(flat, _pack(n_blocks), "block long, rows binary")
    ddl = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields if f.name in keep)
    kind = f"doc_id long{ddl}, n_bytes long, n_removed long, n_spans long, " + ("kept binary" if with_text else "kept_sha256 string")
    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_apply(keep, with_text), kind)
