"""Byte-level BPE: ids of texts by a public vocabulary's ranks, and texts of ids.

Texts are split by the vocabulary's pattern; each match becomes ids by itself, in two tiers:

1. **Minimal perfect hash** (``PerfectHash``) over the vocabulary: levels of bit arrays, in each of which
   a key that is alone at its place stays and the others go on; a key's number is the count of set bits
   before its own. All different matches of a batch are looked up at once in numpy, and each hit is
   compared with the key itself, byte by byte, so that no other match passes for it.
2. **Heap over linked bytes** (``merged``) for matches that are no token: their bytes are a linked list, and a
   heap of (rank, place) gives the adjacent pair to merge next, leftmost first among equal ranks. Pairs are
   looked up by their two ids, so a match of n bytes takes n log n steps. Matches of up to ``WIDE`` bytes
   advance together, one entry of each one's heap per numpy step (``merged_together``).

The vocabulary is a file of fixed size, read once by every worker; nothing of the corpus is kept. Decoding
gathers the tokens' bytes.

Defined cases: null text is empty and has no ids; null ids decode to no bytes; rows that repeat, or share
an id, are encoded one by one; a text of any length is encoded in whole by one task, its matches in blocks of
``BLOCK``, so that only the text and its ids are held (and one match's linked bytes, some 200 bytes for each); special tokens' marks are ordinary text; an id
outside the vocabulary raises ``ValueError``; an empty table gives no rows; a column of ``keep`` that
clashes with one of the result raises ``ValueError``, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import arrow_map, by_size

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK = 400_000
#: Longest match whose heap advances with others', and how many do so at once.
WIDE, LANES = 64, 16_384
_NONE = np.iinfo(np.int64).max
_SLICE = 2_000_000


def public_pattern() -> str:
    """How the public tokenizers split texts."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a vocabulary file in the order of their ranks, which are 0 to n - 1."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in lines if x.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"the ranks of {path} have holes")
    return [token for _, token in pairs]


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers of which each bit depends on all (an odd product, folded twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Numbers 0 to n - 1 for n different byte strings, without collisions or holes, and the way back."""

    def __init__(self, keys: list[bytes], load: float = 1.5):
        self.longest = max(map(len, keys))
        for seed in range(1, 100):
            r = np.random.default_rng(seed)
            self.powers = r.integers(1, 1 << 63, self.longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
            hashes = self._hashes(*_joined(keys))
            if len(np.unique(hashes)) == len(keys):
                break
        else:
            raise ValueError("the keys are not all different")
        left, placed = hashes, 0
        while len(left):
            size = max(64, int(load * len(left)))
            at = self._places(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, placed + np.cumsum(alone) - alone, size))
            placed += int(alone.sum())
            left = left[~alone[at]]
        order = np.empty(len(keys), np.int64)
        order[self._numbers(hashes)] = np.arange(len(keys))
        self.order, self.keys = order, pa.array([keys[i] for i in order.tolist()], pa.binary())

    def _hashes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sizes = np.diff(offsets)
        if not len(data):
            return np.zeros(len(sizes), np.uint64)
        place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.powers[place]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return _spread(total[offsets[1:]] - total[offsets[:-1]] + sizes.astype(np.uint64))

    @staticmethod
    def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        own = np.uint64((level + 1) * 0xA24BAED4963EE407 % (1 << 64))
        return (_spread(hashes + own) % np.uint64(size)).astype(np.int64)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """A number for each hash, -1 where no level has its place: of other strings some number or -1."""
        found = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (alone, before, size) in enumerate(self.levels):
            at = self._places(hashes[open_], level, size)
            hit = alone[at]
            found[open_[hit]] = before[at[hit]]
            open_ = open_[~hit]
        return found

    def find(self, strings: pa.Array) -> np.ndarray:
        """The place in the list of keys of each string of a binary array, -1 where it is none of them."""
        sizes = pc.binary_length(strings).to_numpy(zero_copy_only=False)
        out = np.full(len(strings), -1, np.int64)
        short = np.flatnonzero((sizes <= self.longest) & (sizes > 0))
        if not len(short):
            return out
        some = strings if len(short) == len(strings) else strings.take(pa.array(short))
        number = self._numbers(self._hashes(*_buffers(some)))
        hit = np.flatnonzero(number >= 0)
        same = pc.equal(some.take(pa.array(hit)), self.keys.take(pa.array(number[hit]))).to_numpy(zero_copy_only=False)
        hit = hit[same.astype(bool)]
        out[short[hit]] = self.order[number[hit]]
        return out


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _buffers(pa.array(strings, pa.binary()))


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array and where each string starts, with the end."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = strings.buffers()[2]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Vocabulary:
    """Both tiers over one vocabulary, and the tables for decoding."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.hash = PerfectHash(self.tokens)
        self.table = pa.array(self.tokens, pa.binary())
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.singles = [self.rank[bytes([b])] for b in range(256)]
        #: Ids of a token's two parts to its rank, for each cut of each token into two tokens.
        self.pairs = {(self.rank[t[:k]], self.rank[t[k:]]): i for i, t in enumerate(self.tokens) for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank}
        keys = np.fromiter((a << 32 | b for a, b in self.pairs), np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.pairs.values(), np.int64, len(keys))[order]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 of those that are no token."""
        if not len(self.pair_keys):
            return np.full(len(a), -1)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merged(self, match: bytes) -> list[int]:
        """Ids of one match that is no token."""
        n = len(match)
        ids = [self.singles[b] for b in match]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [self.pairs.get(p, -1) for p in zip(ids, ids[1:], strict=False)]
        rank.append(-1)
        heap = [(r, i) for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:  # one of its two parts has been merged since
                continue
            gone = after[i]
            ids[i], rank[gone] = r, -1
            after[i] = right = after[gone]
            if right < n:
                before[right] = i
            for left, second in ((before[i], i), (i, right)):
                if left >= 0:
                    rank[left] = self.pairs.get((ids[left], ids[second]), -1) if second < n else -1
                    if rank[left] >= 0:
                        heapq.heappush(heap, (rank[left], left))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merged_together(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of up to ``WIDE`` bytes, in order, and the number of each one's; like ``merged``, all at once."""
        n, wide = len(size), int(size.max()) + 1
        place = np.arange(wide)
        inside = place < size[:, None]
        ids = np.where(inside, np.asarray(self.singles)[data[np.minimum(start[:, None] + place, len(data) - 1)]], -1)
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        rank = np.full((n, wide), -1)
        row, col = np.nonzero(inside[:, 1:])
        rank[row, col] = self._ranks(ids[row, col], ids[row, col + 1])
        heap = np.full((n, 2 * wide + 1), _NONE)  # of (rank, place) as one number; a merge takes one out and puts two in at most
        heap[:, :wide] = np.sort(np.where(rank >= 0, rank << 8 | place, _NONE), 1)
        held = (rank >= 0).sum(1)
        end = heap.shape[1] - 1

        def push(lane: np.ndarray, entry: np.ndarray) -> None:
            i = held[lane]
            heap[lane, i] = entry
            held[lane] += 1
            while len(lane):
                up = np.maximum(i - 1, 0) >> 1
                above = heap[lane, up]
                rises = np.flatnonzero(entry < above)
                lane, i, up, entry, above = lane[rises], i[rises], up[rises], entry[rises], above[rises]
                heap[lane, i], heap[lane, up] = above, entry
                i = up

        def pop(lane: np.ndarray) -> np.ndarray:
            top = heap[lane, 0]
            held[lane] -= 1
            entry = heap[lane, held[lane]]
            heap[lane, held[lane]] = _NONE
            some = np.flatnonzero(held[lane])
            lane, entry, i = lane[some], entry[some], np.zeros(len(some), np.int64)
            heap[lane, 0] = entry
            while len(lane):
                one = np.minimum(2 * i + 1, end)
                two = np.minimum(one + 1, end)
                least = np.where(heap[lane, two] < heap[lane, one], two, one)
                below = heap[lane, least]
                sinks = np.flatnonzero(below < entry)
                lane, i, least, entry, below = lane[sinks], i[sinks], least[sinks], entry[sinks], below[sinks]
                heap[lane, i], heap[lane, least] = below, entry
                i = least
            return top

        live = np.flatnonzero(held)
        while len(live):
            top = pop(live)
            r, i = top >> 8, top & 255
            ok = np.flatnonzero(rank[live, i] == r)  # else one of its two parts has been merged since
            lane, r, i = live[ok], r[ok], i[ok]
            gone = after[lane, i]
            right, left = after[lane, gone], before[lane, i]
            ids[lane, i], ids[lane, gone], rank[lane, gone] = r, -1, -1
            after[lane, i], before[lane, right] = right, i
            second = ids[lane, right]  # -1 beyond the end
            rank[lane, i] = new = np.where(second >= 0, self._ranks(r, second), -1)
            more = np.flatnonzero(new >= 0)
            push(lane[more], new[more] << 8 | i[more])
            some = np.flatnonzero(left >= 0)
            lane, left = lane[some], left[some]
            rank[lane, left] = new = self._ranks(ids[lane, left], r[some])
            more = np.flatnonzero(new >= 0)
            push(lane[more], new[more] << 8 | left[more])
            live = live[held[live] > 0]
        there = ids >= 0
        return ids[there], there.sum(1)

    def _all_merged(self, matches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches that are no tokens, in order, and the number of each one's; those of like length advance together."""
        data, offsets = _buffers(matches)
        size = np.diff(offsets)
        by_size = np.argsort(size, kind="stable")
        by_size = by_size[size[by_size] > 0]
        short = by_size[: np.searchsorted(size[by_size], WIDE, side="right")]
        groups, counts = [], np.zeros(len(size), np.int64)
        for a in range(0, len(short), LANES):
            own = short[a : a + LANES]
            ids, counts[own] = self.merged_together(data, offsets[own], size[own])
            groups.append((own, ids))
        for i in by_size[len(short) :].tolist():
            ids = np.asarray(self.merged(data[offsets[i] : offsets[i + 1]].tobytes()))
            counts[i] = len(ids)
            groups.append((np.array([i]), ids))
        flat = np.empty(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        for own, ids in groups:
            c = counts[own]
            flat[np.arange(len(ids)) + np.repeat(first[own] - (np.cumsum(c) - c), c)] = ids
        return flat, counts

    def encode_matches(self, matches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches in order, and the number of ids of each match."""
        if not len(matches):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        known = matches.dictionary_encode()
        number = self.hash.find(known.dictionary)
        which = known.indices.to_numpy(zero_copy_only=False)
        missed = np.flatnonzero(number < 0)
        if not len(missed):
            return number[which].astype(np.int32), np.ones(len(which), np.int64)
        own, many = self._all_merged(known.dictionary.take(pa.array(missed)))
        sizes = np.ones(len(number), np.int64)
        sizes[missed] = many
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.empty(starts[-1], np.int32)
        flat[starts[:-1][number >= 0]] = number[number >= 0]
        at = np.arange(int(sizes[missed].sum())) + np.repeat(starts[missed] - np.concatenate([[0], np.cumsum(sizes[missed])[:-1]]), sizes[missed])
        flat[at] = own
        counts = sizes[which]
        ends = np.cumsum(counts)
        return flat[np.arange(int(ends[-1])) + np.repeat(starts[which] - (ends - counts), counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each text."""
        out: list[np.ndarray] = []
        held: list[str] = []
        per_text: list[int] = []
        totals = np.zeros(len(texts), np.int64)
        first = 0

        def flush(upto: int) -> None:
            nonlocal held, per_text, first
            ids, counts = self.encode_matches(pa.array(held, pa.string()).cast(pa.binary()))
            edges = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_text)])]
            totals[first:upto] += np.diff(edges)
            out.append(ids)
            held, per_text = [], []

        for i, text in enumerate(texts):
            if len(text) <= BLOCK:
                found = self.pattern.findall(text)
                held += found
                per_text.append(len(found))
                if len(held) >= BLOCK:
                    flush(i + 1)
                    first = i + 1
                continue
            if per_text:
                flush(i)
            first = i
            found_iter = self.pattern.finditer(text)
            while block := [m.group() for m in islice(found_iter, BLOCK)]:
                held, per_text = block, [len(block)]
                flush(i + 1)
            first = i + 1
        if per_text:
            flush(len(texts))
        return np.concatenate(out) if out else np.zeros(0, np.int32), totals


@functools.cache
def load(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _kept(df: DataFrame, keep: tuple[str, ...], own: set[str]) -> str:
    if clash := own & set(keep):
        raise ValueError(f"columns to keep clash with the result's: {sorted(clash)}")
    kinds = dict(df.dtypes)
    return "".join(f"`keep_{c}` {kinds[c]}, " for c in keep)


def encode(docs: DataFrame, path: str, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``ids`` (array of int) of each row's ``text``."""
    schema = _kept(docs, keep, {"ids"}) + "ids array<int>"
    pattern = public_pattern() if pattern is None else pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path, pattern)
        for batch in batches:
            for part in by_size(batch, "text", _SLICE):
                ids, sizes = vocabulary.encode(part.column("text").fill_null("").to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[*part.schema.names[1:], "ids"])

    return arrow_map(docs.select("text", *(F.col(c).alias(f"keep_{c}") for c in keep)), run, schema).withColumnsRenamed({f"keep_{c}": c for c in keep})


def decode(encoded: DataFrame, path: str, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and the ``decoded`` bytes of each row's ``ids``."""
    schema = _kept(encoded, keep, {"decoded"}) + "decoded binary"
    pattern = public_pattern() if pattern is None else pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path, pattern)
        for batch in batches:
            ids = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            flat = ids.flatten()
            least, most = pc.min_max(flat).as_py().values()
            if least is not None and (least < 0 or most >= len(vocabulary.tokens)):
                raise ValueError(f"ids from {least} to {most}; the vocabulary has 0 to {len(vocabulary.tokens) - 1}")
            data, starts = _buffers(vocabulary.table.take(flat))
            raw, edges = data.tobytes(), starts[np.concatenate([[0], np.cumsum(sizes)])].tolist()
            texts = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.binary())], names=[*batch.schema.names[1:], "decoded"])

    return arrow_map(encoded.select("ids", *(F.col(c).alias(f"keep_{c}") for c in keep)), run, schema).withColumnsRenamed({f"keep_{c}": c for c in keep})


def bpe_digest(encoded: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of each row and of the bytes that they decode to."""
    counted = encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids"
    )
    return decode(counted, path, keep=("doc_id", "n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
