"""Phrase collocations by two passes: merged count-min sketches, then exact counts of what survives.

A text is lower-cased in A-Z and split into pieces at ``.,;:!?`` and line ends, and pieces into words at
spaces and tabs; n-grams never leave a piece. Everything is counted per language.

1. Each task adds the n-grams of 1 to ``max_words`` words of its documents to a sketch of ``DEPTH`` rows
   of ``width`` cells, which stop counting at the threshold. Sketches are dealt out by blocks of
   ``BLOCK`` cells and summed; of each cell one bit stays: whether it reached the threshold.
2. The bits, ``DEPTH * width / 8`` bytes whatever the corpus, go to all tasks. An n-gram is emitted if its
   cells and those of the (n-1)-grams in it are all set, with its count in the batch; Spark sums
   them by the n-gram itself. A sketch never counts too little, so that every n-gram that reaches the
   threshold is among them; what it lets through by mistake goes by its exact count.

Candidates are phrases of two words or more that reach the threshold. A cut after k words scores
``floor(1000000 * a * a / (l * r))`` in decimals of 38 digits; the least score counts, ties to the smallest
k. A candidate goes where a longer one that contains it has at least ``subsume`` percent of its
count. The best of each language are chosen in shares first, so that no task sorts a whole language.

``width`` follows the bytes of text, a cell for each eight of them, up to ``MAX_WIDTH``, which bounds a
worker's sketch to 128 MB and the bits to 8 MB. Beyond some 300 MB of different text, cells fill up:
more n-grams go into the second pass, whose sums are spread over all partitions, and results stay the same.

Defined cases: null text is empty, a null language is ``und``; null ids and rows that repeat count each by
itself; ties in score and count go by the phrase's UTF-8 bytes; a text of any length is read in blocks that end
where a piece ends (a piece is held in whole); an empty table gives no rows; other columns are ignored,
whatever their names. Counts are exact up to 10^12 occurrences. Sketch and counts run while the result
is planned; counts are a table in the shared folder, which goes when the driver ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.llm.common import arrow_map, default_parallelism, stored
from lexaudit.llm.fim import text_bytes

MAX_WORDS, MIN_COUNT, SUBSUME, TOP = 3, 10, 50, 2000
DEPTH = 2
BLOCK = 1 << 16
MIN_WIDTH, MAX_WIDTH = BLOCK, 1 << 25
NO_LANG = "und"
_CHUNK = 4_000_000
_SALTS = {1: 16}
_FEW_SALTS = 4

#: What a byte is: of a word (0), between words (1), between pieces (2).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _chunks(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end where a text or a piece ends."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        stop = int(offsets[np.searchsorted(offsets, end)])
        while end < stop:
            hit = np.flatnonzero(_KIND[data[end : min(stop, end + 65536)]] == 2)
            if len(hit):
                end += int(hit[0])
                break
            end = min(stop, end + 65536)
        yield start, end
        start = end


class Grams:
    """The different n-grams of one length in a block of text: counts, hashes, and their own parts."""

    def __init__(self, counts: np.ndarray, hashes: np.ndarray, first: np.ndarray | None, last: np.ndarray | None, at: np.ndarray):
        self.counts, self.hashes, self.first, self.last, self.at = counts, hashes, first, last, at


class Block:
    """The words of a block of text, and its n-grams by length."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, lang_hashes: np.ndarray, max_words: int):
        kind = _KIND[data]
        word = kind == 0
        edge = np.ones(len(data), bool)
        edge[1:] = word[1:] != word[:-1]
        edge[offsets[offsets < len(data)]] = True
        edges = np.flatnonzero(edge)
        sizes = np.diff(edges, append=len(data))
        mine = word[edges]
        starts, sizes = edges[mine], sizes[mine]
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        letters = _LOWER[data[word]]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        text = np.searchsorted(offsets, starts, side="right") - 1
        piece = np.cumsum(kind == 2)[starts] if len(data) else starts
        self.words = words.dictionary
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = langs[text]
        #: Whether a word follows the one before it in one piece.
        joint = np.zeros(len(starts), bool)
        joint[1:] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
        self.grams: list[Grams] = []
        if not len(starts):
            return
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
        ids, first = self._numbered(self.lang * len(self.words) + self.word)
        every = np.arange(len(starts))
        at = np.empty(len(first), np.int64)
        at[ids] = every
        single = _mixed(hashes[self.word[at]] + lang_hashes[self.lang[at]])
        self.grams.append(Grams(np.bincount(ids), single, None, None, at))
        unit, dense, valid = ids, ids, np.ones(len(starts), bool)
        for n in range(2, max_words + 1):
            valid = valid[: len(starts) - n + 1] & joint[n - 1 :]
            place = np.flatnonzero(valid)
            if not len(place):
                return
            ids, keys = self._numbered(dense[place] * len(first) + unit[place + n - 1])
            at = np.empty(len(keys), np.int64)
            at[ids] = place
            head, tail = keys // len(first), keys % len(first)
            before = self.grams[-1]
            self.grams.append(Grams(np.bincount(ids), _mixed(before.hashes[head] * np.uint64(0xD6E8FEB86659FD93) + single[tail]), head, dense[at + 1], at))
            dense = np.full(len(starts), -1, np.int64)
            dense[place] = ids

    @staticmethod
    def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number from 0 for each key, and the different keys by number."""
        known = pa.array(keys).dictionary_encode()
        return known.indices.to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary.to_numpy(zero_copy_only=False)

    def phrases(self, n: int, which: np.ndarray) -> pa.Array:
        at = self.grams[n - 1].at[which]
        parts = [self.words.take(pa.array(self.word[at + k])) for k in range(n)]
        joined = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
        return joined.cast(pa.string())


def _blocks(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[tuple[Block, list[str]]]:
    """Blocks of text with their languages' names."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        langs = batch.column("lang").fill_null(NO_LANG).dictionary_encode()
        names = langs.dictionary.to_pylist()
        number = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x, seed=1) for x in names), np.uint64, len(names))
        for start, end in _chunks(data, offsets, _CHUNK):
            a, b = np.searchsorted(offsets, start, side="right") - 1, np.searchsorted(offsets, end)
            yield Block(data[start:end], np.clip(offsets[a : b + 1], start, end) - start, number[a:b], hashes, max_words), names


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    own = np.uint64((row + 1) * 0xA24BAED4963EE407 % (1 << 64))
    return (_mixed(hashes + own) & np.uint64(width - 1)).astype(np.int64)


def sketched(docs: DataFrame, width: int, min_count: int, max_words: int) -> DataFrame:
    """The merged sketch: for each block of cells (``slot``: row by row) a bit for each cell that reached ``min_count``."""
    if not 0 < min_count < 256:
        raise ValueError("the threshold of the sketch is 1 to 255")
    block = min(BLOCK, width)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [np.zeros(width, np.uint16) for _ in range(DEPTH)]
        share = min(1 << 20, 16 * width)  # so that no cell can pass 16 bits before it is cut to the threshold
        for found, _ in _blocks(batches, max_words):
            for grams in found.grams:
                least = np.minimum(grams.counts, min_count).astype(np.uint16)
                for a in range(0, len(least), share):
                    for row, sums in enumerate(cells):
                        at = _cells(grams.hashes[a : a + share], row, width)
                        np.add.at(sums, at, least[a : a + share])
                        sums[at] = np.minimum(sums[at], min_count)
        codec = pa.Codec("zstd", 1)
        for row, sums in enumerate(cells):
            for b in range(width // block):
                part = sums[b * block : (b + 1) * block]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"slot": pa.array([row * (width // block) + b], pa.int32()), "cells": pa.array([codec.compress(part.astype(np.uint8).tobytes(), asbytes=True)], pa.binary())})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sums = pa.Codec("zstd", 1), {}
        for batch in batches:
            for slot, cells in zip(batch.column("slot").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                own = np.frombuffer(codec.decompress(cells, decompressed_size=block), np.uint8)
                sums[slot] = own if slot not in sums else np.minimum(sums[slot].astype(np.uint16) + own, min_count).astype(np.uint8)
        for slot, cells in sums.items():
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "bits": pa.array([np.packbits(cells >= min_count, bitorder="little").tobytes()], pa.binary())})

    parts = arrow_map(docs.select("text", F.col("lang").cast("string").alias("lang")), counted, "slot int, cells binary")
    return arrow_map(parts.repartition("slot"), merged, "slot int, bits binary")


def ngram_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, width: int | None = None) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``f`` of all n-grams that occur ``min_count`` times, and all words of a language (``words`` 0)."""
    spark = docs.sparkSession
    if width is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        width = min(max(MIN_WIDTH, 1 << max(0, int(size // 8) - 1).bit_length()), MAX_WIDTH)
    if width < 8 or width & (width - 1):
        raise ValueError("the width of the sketch is a power of two from 8 on")
    block = min(BLOCK, width)
    bits = np.zeros((DEPTH * (width // block), block // 8), np.uint8)
    for row in sketched(docs, width, min_count, max_words).toLocalIterator():  # DEPTH * width / 8 bytes in all
        bits[row["slot"]] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.reshape(DEPTH, width // 8))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for found, names in _blocks(batches, max_words):
            langs = pa.array(names, pa.string())
            if found.grams:
                of = np.bincount(found.lang, minlength=len(names))
                some = np.flatnonzero(of)
                yield _rows(langs.take(pa.array(some)), 0, pa.array([""] * len(some), pa.string()), of[some])
            alive: np.ndarray | None = None
            for n, grams in enumerate(found.grams, 1):
                good = np.ones(len(grams.counts), bool) if alive is None else alive[grams.first] & alive[grams.last]
                for row in range(DEPTH):
                    which = np.flatnonzero(good)
                    at = _cells(grams.hashes[which], row, width)
                    good[which] = (table[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                which = np.flatnonzero(good)
                if len(which):
                    yield _rows(langs.take(pa.array(found.lang[grams.at[which]])), n, found.phrases(n, which), grams.counts[which])
                alive = good

    found = arrow_map(docs.select("text", F.col("lang").cast("string").alias("lang")), survivors, "lang string, words int, phrase string, f long")
    exact = found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter((F.col("words") == 0) | (F.col("f") >= min_count))
    counts, _ = stored(exact, "ngrams")
    shared.destroy()
    return counts


def _rows(langs: pa.Array, words: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(langs), words, np.int32)), phrases, pa.array(counts.astype(np.int64))], names=["lang", "words", "phrase", "f"])


def _salts(words: F.Column) -> F.Column:
    """Shares of the requests for a phrase of so many words: single words are asked for most."""
    out = F.lit(_FEW_SALTS)
    for n, salts in _SALTS.items():
        out = F.when(words == n, F.lit(salts)).otherwise(out)
    return out


def scored(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a`` of every candidate with ``l``, ``r`` and ``score`` of the cut that scores least."""
    parts = F.split("phrase", " ")
    cuts = (
        counts.filter(F.col("words") >= 2)
        .select("lang", "phrase", "words", F.col("f").alias("a"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .withColumn("first", F.array_join(F.slice("parts", 1, F.col("k")), " "))
        .withColumn("rest", F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " "))
        .withColumn("own", F.xxhash64("phrase"))
        .drop("parts")
    )
    asked = counts.filter(F.col("words") >= 1).select("lang", "phrase", "f", F.explode(F.sequence(F.lit(0), _salts(F.col("words")) - 1)).alias("salt"))
    for side, words, name in (("first", F.col("k"), "l"), ("rest", F.col("words") - F.col("k"), "r")):
        known = asked.select(F.col("lang").alias("x_lang"), F.col("phrase").alias("x_phrase"), F.col("salt").alias("x_salt"), F.col("f").alias(name))
        on = (F.col("lang") == F.col("x_lang")) & (F.col(side) == F.col("x_phrase")) & (F.pmod(F.col("own"), _salts(words)).cast("int") == F.col("x_salt"))
        cuts = cuts.join(known, on, "inner").drop("x_lang", "x_phrase", "x_salt")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("up", F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a"))).withColumn("down", wide("l") * wide("r")).withColumn("score", F.expr("up div down"))
    least = cuts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return least.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def subsumed(counts: DataFrame, subsume: int = SUBSUME) -> DataFrame:
    """``lang`` and ``phrase`` of candidates that a longer candidate contains with ``subsume`` percent of their count."""
    parts = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, words - 1), w -> transform(sequence(1, words - w + 1), i -> array_join(slice(parts, i, w), ' '))))")
    longer = counts.filter(F.col("words") >= 3).select("lang", "words", F.col("f").alias("longer"), parts.alias("parts"))
    most = longer.select("lang", F.explode(inner).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = counts.filter(F.col("words") >= 2).select("lang", "phrase", "f")
    return own.join(most, ["lang", "phrase"]).filter(F.lit(100).cast("decimal(3,0)") * F.col("longer") >= F.lit(subsume).cast("decimal(3,0)") * F.col("f")).select("lang", "phrase")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, subsume: int = SUBSUME, top: int = TOP, width: int | None = None
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the best candidates of each language that no longer one subsumes."""
    counts = ngram_counts(docs, min_count, max_words, width)
    left = scored(counts).join(subsumed(counts, subsume), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shares = max(8, min(256, default_parallelism(docs.sparkSession)))
    some = left.withColumn("share", F.pmod(F.xxhash64("phrase", F.lit(3)), F.lit(shares)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top).drop("share", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = counts.filter("words = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n"))
    return best.join(n, F.col("lang") == F.col("n_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
