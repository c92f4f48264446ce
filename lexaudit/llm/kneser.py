"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is of n-grams of characters (or of words, ``unit="word"``), one for each language, trained
on trusted texts: about ``MAX_TRUSTED`` labelled documents at most and ``TRAIN_SHARE`` of a language's
trusted ones, those with the least hash of their id. The languages have equal shares of them; what a
language doesn't need goes to the others. All its counts are tables; nothing of it is held in one place.

Scoring is a sharded count join. Documents are read in blocks of about ``BLOCK_BYTES`` of text, named by
a hash of what is in them. The n-grams that a block has are asked for once a block: they
meet the count tables (an n-gram's count, its context's total and counts of counts, the lower order's
answer) order by order in joins by n-gram, and the answers meet the block that asked, packed from a second
reading of the documents. A task holds one block and its answers; no table is broadcast or passes
through the driver, and there are as many blocks as the input fills. Documents that come in another
order at the second reading are found out, as their blocks have no answers, and raise an error.

Perplexities of short texts say little, so a document's mean negative log probability is shrunk
towards its language's trusted mean with the weight of ``SHRINK`` symbols. Its language's threshold
is a quantile of the same figure over all its trusted documents that the model wasn't trained on (a
language of fewer than ``FEW`` trusted documents is trained and judged by the same ones), times a margin.

Defined cases: null text is empty, has perplexity null, and is kept; a null language is a language
of its own; a language without trusted text has no threshold, and its documents are kept; rows
that repeat are scored one by one; documents that tie with the threshold are kept; an empty table
gives no rows; a text longer than a block is a block of its own, read in whole; columns that are not
asked for are ignored, and columns of the names made here may be in the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import WORD, arrow_map, by_size, cut, pack_rows, small_table, stored, trim, unpack_rows

ORDER = 4
UNIT = "char"
MAX_TRUSTED = 50_000
TRAIN_SHARE = 0.75
FEW = 8
BLOCK_BYTES = 16_000_000
CHUNK_BYTES = 400_000
MERGE_GRAMS = 1_000_000
SHRINK = 64.0
QUANTILE = 0.99
MARGIN = 1.03
#: Stands before a text's first symbol; a code point that Unicode keeps free.
START = "\ufdd0"
_WORD = re.compile(WORD)


class Numbers:
    """Symbols of some texts as small numbers, and n-grams of them as one number each.

    In base of the number of symbols an n-gram's number is exact; where that takes more than 63 bits,
    it is a 64-bit hash."""

    def __init__(self, texts: list[str], unit: str, order: int):
        self.unit, self.order = unit, order
        if unit == "char":
            self.names = sorted(set(START).union(*texts))
            codes = np.array([ord(c) for c in self.names])
            self.lookup = np.zeros(int(codes[-1]) + 1, np.uint64)
            self.lookup[codes] = np.arange(len(codes))
        else:
            self.of: dict[str, int] = {START: 0}
            for t in texts:
                for w in _WORD.findall(t):
                    self.of.setdefault(w, len(self.of))
            self.names = list(self.of)
        self.exact = len(self.names) ** order < 1 << 63
        self.base = np.uint64(len(self.names) if self.exact else 0x9E3779B97F4A7C15)

    def _keys(self, numbers: np.ndarray) -> np.ndarray:
        m = len(numbers) - self.order + 1
        out = np.zeros(m, np.uint64)
        for i in range(self.order):
            out *= self.base
            out += numbers[i : i + m]
        return out

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram that ends at each symbol, texts apart; and each text's number of symbols."""
        lead = self.order - 1
        if self.unit == "char":
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            pad = START * lead
            numbers = self.lookup[np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), "<u4")]
        else:
            words = [_WORD.findall(t) for t in texts]
            n = np.fromiter(map(len, words), np.int64, len(words))
            numbers = np.fromiter((self.of[w] for own in words for w in [START] * lead + own), np.uint64, int(n.sum()) + lead * len(words))
        keys = self._keys(numbers)
        at = np.arange(int(n.sum())) + np.repeat(lead * np.arange(len(texts)), n)
        return keys[at], n

    def of_grams(self, grams: list[str]) -> np.ndarray:
        """Numbers of n-grams that are written out."""
        if self.unit == "char":
            numbers = self.lookup[np.frombuffer("".join(grams).encode("utf-32-le"), "<u4")]
        else:
            numbers = np.fromiter((self.of[w] for g in grams for w in g.split(" ")), np.uint64, len(grams) * self.order)
        table = numbers.reshape(-1, self.order)
        out = np.zeros(len(table), np.uint64)
        for i in range(self.order):
            out *= self.base
            out += table[:, i]
        return out

    def written(self, keys: np.ndarray) -> list[str]:
        """N-grams of exact numbers, written out."""
        digits = np.empty((len(keys), self.order), np.uint64)
        for i in range(self.order - 1, -1, -1):
            keys, digits[:, i] = np.divmod(keys, self.base)
        sep = "" if self.unit == "char" else " "
        return [sep.join(map(self.names.__getitem__, row)) for row in digits.tolist()]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray, list[str]]]:
    """Rows of a batch by language (``_lang``), in chunks of bounded size."""
    langs = batch.column("_lang").to_pylist()
    for lang in sorted(set(langs), key=lambda x: (x is None, x or "")):
        rows = np.array([i for i, x in enumerate(langs) if x == lang])
        own = batch.take(pa.array(rows))
        at = 0
        for part in by_size(own, "text", CHUNK_BYTES):
            yield lang, rows[at : at + part.num_rows], _texts(part)
            at += part.num_rows


def _distinct(batch: pa.RecordBatch, unit: str, order: int) -> Iterator[tuple[str | None, list[str], np.ndarray]]:
    """The n-grams of a block of texts by language, with their number."""
    numbers = Numbers(_texts(batch), unit, order)
    found: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
    hashed: dict[str | None, Counter] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    for lang, _, texts in _by_language(batch):
        keys, _ = numbers.read(texts)
        if not len(keys):
            continue
        if numbers.exact:
            parts = found.setdefault(lang, [])
            parts.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in parts) > MERGE_GRAMS:
                found[lang] = [merged(parts)]
        else:
            lead, sep = [START] * (order - 1), "" if unit == "char" else " "
            for t in texts:
                symbols = lead + (list(t) if unit == "char" else _WORD.findall(t))
                hashed.setdefault(lang, Counter()).update(sep.join(symbols[i : i + order]) for i in range(len(symbols) - order + 1))
    for lang, parts in found.items():
        keys, n = merged(parts)
        yield lang, numbers.written(keys), n
    for lang, counts in hashed.items():
        yield lang, list(counts), np.fromiter(counts.values(), np.int64, len(counts))


def _repeated(value: str | None, n: int) -> pa.Array:
    return pa.array([value], pa.string()).take(pa.array(np.zeros(n, np.int64)))


def corpus_grams(docs: DataFrame, unit: str = UNIT, order: int = ORDER) -> DataFrame:
    """N-grams of texts with their number, combined over slices of a task: lang, gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for lang, grams, n in _distinct(block, unit, order):
                yield pa.RecordBatch.from_arrays([_repeated(lang, len(grams)), pa.array(grams, pa.string()), pa.array(n)], ["lang", "gram", "n"])

    picked = docs.select(F.col("lang").cast("string").alias("_lang"), "text")
    return arrow_map(picked, run, "lang string, gram string, n long")


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in by_size(whole, "text", limit):
            own = batch.column("text").nbytes
            if held and size + own > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _suffix(gram: Column, order: int, unit: str) -> Column:
    """The last ``order`` symbols."""
    if not order:
        return F.lit("")
    return F.right(gram, F.lit(order)) if unit == "char" else F.substring_index(gram, " ", -order)


def _context(gram: Column, order: int, unit: str) -> Column:
    """All symbols but the last."""
    if order == 1:
        return F.lit("")
    return F.substring(gram, 1, order - 1) if unit == "char" else F.substring_index(gram, " ", order - 1)


@dataclass
class Model:
    """Count tables by order (lang, gram, c) and context tables (lang, ctx, total, gamma, discounts, kinds)."""

    counts: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    unit: str
    order: int


def train(grams: DataFrame, unit: str = UNIT, order: int = ORDER) -> Model:
    """From (lang, gram, n) of trusted text. Orders below the highest count distinct left neighbours."""
    counts = {order: cut(grams.groupBy("lang", "gram").agg(F.sum("n").alias("c")))}
    for k in range(order - 1, 0, -1):
        lower = counts[k + 1].groupBy("lang", _suffix(F.col("gram"), k, unit).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        counts[k] = cut(lower)
    contexts = {}
    for k in range(1, order + 1):
        t = counts[k]
        of = t.groupBy(F.col("lang").alias("dl")).agg(*(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        ready = (F.col("n1") > 0) & (F.col("n2") > 0)

        def discount(i: int, fallback: float, ready: Column = ready, y: Column = y) -> Column:
            raw = F.try_divide(F.lit(i + 1.0) * y * F.col(f"n{i + 1}"), F.col(f"n{i}"))
            value = F.when(ready, F.lit(float(i)) - raw)
            return F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(value, F.lit(fallback))))

        d = of.select("dl", discount(1, 0.5).alias("d1"), discount(2, 1.0).alias("d2"), discount(3, 1.5).alias("d3"))
        ctx = t.groupBy("lang", _context(F.col("gram"), k, unit).alias("ctx")).agg(
            F.sum("c").alias("total"),
            F.count_if(F.col("c") == 1).alias("k1"),
            F.count_if(F.col("c") == 2).alias("k2"),
            F.count_if(F.col("c") > 2).alias("k3"),
        )
        joined = ctx.join(d, F.col("lang").eqNullSafe(F.col("dl")))
        gamma = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")
        contexts[k] = cut(joined.select("lang", "ctx", "total", gamma.alias("gamma"), "d1", "d2", "d3", (F.col("k1") + F.col("k2") + F.col("k3")).alias("kinds")))
    return Model(counts, contexts, unit, order)


def probabilities(model: Model, asked: DataFrame) -> DataFrame:
    """(lang, gram, p) for distinct (lang, gram) of the highest order, by joins from the lowest order up."""
    lower: DataFrame | None = None
    requests = {model.order: asked}
    for k in range(model.order - 1, 0, -1):
        requests[k] = requests[k + 1].select("lang", _suffix(F.col("gram"), k, model.unit).alias("gram")).distinct()
    for k in range(1, model.order + 1):
        r = requests[k].withColumn("ctx", _context(F.col("gram"), k, model.unit)).withColumn("low", _suffix(F.col("gram"), k - 1, model.unit))
        c = model.counts[k].select(F.col("lang").alias("cl"), F.col("gram").alias("cg"), "c")
        x = model.contexts[k].select(F.col("lang").alias("xl"), F.col("ctx").alias("xc"), "total", "gamma", "d1", "d2", "d3", "kinds")
        r = r.join(c, F.col("lang").eqNullSafe(F.col("cl")) & (F.col("gram") == F.col("cg")), "left")
        r = r.join(x, F.col("lang").eqNullSafe(F.col("xl")) & (F.col("ctx") == F.col("xc")), "left")
        if lower is None:
            below = F.lit(1.0) / (F.col("kinds") + 1)  # one more for symbols never seen
        else:
            b = lower.select(F.col("lang").alias("bl"), F.col("gram").alias("bg"), F.col("p").alias("bp"))
            r = r.join(b, F.col("lang").eqNullSafe(F.col("bl")) & (F.col("low") == F.col("bg")), "left")
            below = F.col("bp")
        cut_off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.coalesce((F.col("c") - cut_off) / F.col("total"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), below).otherwise(own + F.col("gamma") * below)
        lower = r.select("lang", "gram", p.alias("p"))
    return lower


SCORES = {"n_scored": "long", "perplexity": "double", "mean_nll": "double", "score": "double", "threshold": "double", "kept": "boolean"}


def _named(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks with their names: a hash of the task's number and of what is in them."""
    task = TaskContext.get().partitionId()
    for block in _blocks(batches, limit):
        h = xxhash.xxh3_64(seed=task)
        for ident, text in zip(block.column("_id").to_pylist(), _texts(block), strict=True):
            h.update(f"{ident} {len(text)} ".encode())
            h.update(text.encode())
        yield h.intdigest() - (1 << 63), block


def _packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents in blocks: block, rows (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _named(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack_rows(block)], pa.binary())], ["block", "rows"])

    return arrow_map(docs, run, "block long, rows binary")


def _asked(docs: DataFrame, unit: str, order: int, block_bytes: int) -> DataFrame:
    """What n-grams each block has: block, lang, gram; and the block itself, with null for an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _named(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string())], ["block", "lang", "gram"])
            for lang, grams, _ in _distinct(block, unit, order):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), name)), _repeated(lang, len(grams)), pa.array(grams, pa.string())], ["block", "lang", "gram"])

    return arrow_map(docs, run, "block long, lang string, gram string")


_SCORED = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("nll", pa.list_(pa.float64())), ("rows", pa.binary())])


def scored_blocks(blocks: DataFrame, answers: DataFrame, unit: str, order: int, columns: tuple[str, ...]) -> DataFrame:
    """Blocks with each row's id, language, number of symbols and negative log probability, and the rows' ``columns``."""

    def scored(block: pa.Table, found: pa.Table) -> pa.Table:
        if block.num_rows and not found.num_rows:
            raise RuntimeError("a block was never asked for: documents came in another order when read again")
        found = found.filter(pc.is_valid(found["gram"]))
        out: list[list] = [[] for _ in _SCORED]
        langs_of = np.array(found["lang"].to_pylist(), object)
        for number, packed in zip(block["block"].to_pylist(), block["rows"], strict=True):
            rows = unpack_rows(packed.as_py())
            numbers = Numbers(_texts(rows), unit, order)
            tables = {}
            for lang in set(langs_of.tolist()):
                own = pa.array(np.flatnonzero(langs_of == lang))
                keys, logs = numbers.of_grams(found["gram"].take(own).to_pylist()), found["log"].take(own).to_numpy()
                by = np.argsort(keys)
                tables[lang] = keys[by], logs[by]
            nll, n = np.full(rows.num_rows, np.nan), np.zeros(rows.num_rows, np.int64)
            for lang, at, texts in _by_language(rows):
                got, size = numbers.read(texts)
                n[at] = size
                if lang in tables and len(got):
                    keys, logs = tables[lang]
                    value = -logs[np.minimum(np.searchsorted(keys, got), len(keys) - 1)]
                    nll[at] = np.where(size > 0, np.bincount(np.repeat(np.arange(len(at)), size), value, len(at)), np.nan)
            kept = rows.select(list(columns))
            for column, value in zip(out, (number, rows.column("_id").to_pylist(), rows.column("_lang").to_pylist(), n.tolist(), nll.tolist(), pack_rows(kept)), strict=True):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCORED, strict=True)], schema=_SCORED)

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        table = scored(block, found)
        trim()
        return table

    ddl = "block long, doc_ids array<long>, langs array<string>, n array<long>, nll array<double>, rows binary"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ddl)


def block_scores(flat: DataFrame, model: Model, columns: tuple[str, ...], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``scored_blocks`` of ``flat`` (_id, _lang, text and ``columns``) by a model, kept in the shared folder."""
    asked, drop = stored(_asked(flat, model.unit, model.order, block_bytes), "asked")
    p = probabilities(model, asked.filter("gram is not null").select("lang", "gram").distinct()).filter("p is not null")
    log = p.select(F.col("lang").alias("pl"), F.col("gram").alias("pg"), F.ln("p").cast("float").alias("log"))
    answers = asked.join(log, F.col("lang").eqNullSafe(F.col("pl")) & (F.col("gram") == F.col("pg"))).select("block", "lang", "gram", "log")
    answers = answers.unionByName(asked.filter("gram is null").withColumn("log", F.lit(None).cast("float")))
    scores = cut(scored_blocks(_packed(flat, block_bytes), answers, model.unit, model.order, columns))
    drop()
    return scores


def row_scores(scored: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row a document: ``columns`` (name to type), _lang, _n (symbols) and _nll (null without a model or a symbol)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = unpack_rows(batch.column("rows")[i].as_py())
                nll = np.array(batch.column("nll")[i].as_py(), np.float64)
                made = [pa.array(batch.column("langs")[i].as_py(), pa.string()), pa.array(batch.column("n")[i].as_py(), pa.int64()), pa.array(nll, mask=np.isnan(nll))]
                whole = pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *made], [*columns, "_lang", "_n", "_nll"])
                yield from by_size(whole, "text") if "text" in columns else (whole.slice(a, 20_000) for a in range(0, whole.num_rows, 20_000))

    return arrow_map(scored.select("langs", "n", "nll", "rows"), run, "".join(f"`{k}` {v}, " for k, v in columns.items()) + "_lang string, _n long, _nll double")


def _shares(sizes: dict[str | None, int], most: int, share: float = TRAIN_SHARE, few: int = FEW) -> dict[str | None, float]:
    """The part of each language's documents to train on: ``share`` of a small language's (all of a tiny
    one's), the same number of each larger one."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        take = min(n if n < few else n * share, left // (len(sizes) - k))
        out[lang] = take / n
        left -= take
    return out


def _part(ident: str) -> Column:
    """A document's place between 0 and 1, by its id."""
    return F.pmod(F.xxhash64(ident), F.lit(1 << 40)) / F.lit(float(1 << 40))


def classify(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id", "lang"), scores: tuple[str, ...] = tuple(SCORES), kept_only: bool = False,
             quantile: float = QUANTILE, margin: float = MARGIN, max_trusted: int = MAX_TRUSTED, unit: str = UNIT, order: int = ORDER) -> DataFrame:
    """Score ``docs`` by a model of the trusted ones among them.

    ``labels``: doc_id, quality, toxic; trusted are those of quality 1 that aren't toxic. The model is
    trained on some of them, thresholds are set by all others. Documents are scored once."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("g_id")).distinct()
    trusted = cut(keyed.select(F.col("doc_id").alias("t_id"), F.col("lang").alias("t_lang")).distinct().join(good, F.col("t_id") == F.col("g_id"), "left_semi"))
    sizes = {r["t_lang"]: r["n"] for r in trusted.groupBy("t_lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a language
    shares = F.broadcast(small_table(spark, list(_shares(sizes, max_trusted).items()), "s_lang string, share double"))
    sample = trusted.join(shares, F.col("t_lang").eqNullSafe(F.col("s_lang"))).filter(_part("t_id") < F.col("share")).select("t_id", "t_lang")
    same = (F.col("doc_id") == F.col("t_id")) & F.col("lang").eqNullSafe(F.col("t_lang"))
    own = keyed.select("doc_id", "lang", "text").join(F.broadcast(sample), same, "left_semi")  # about max_trusted rows
    model = train(corpus_grams(own, unit, order), unit, order)

    kinds = dict(docs.dtypes)
    named = docs.select(*dict.fromkeys((*columns, "text")), F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("_lang"))
    scored = block_scores(named, model, columns)

    each = scored.select(F.explode(F.arrays_zip("doc_ids", "langs", "n", "nll")).alias("d")).select("d.*")
    judges = each.filter("nll is not null and not isnan(nll)").join(good, F.col("doc_ids") == F.col("g_id"), "left_semi").join(shares, F.col("langs").eqNullSafe(F.col("s_lang")))
    judges = cut(judges.filter((F.col("share") >= 1) | (_part("doc_ids") >= F.col("share"))).select(F.col("langs").alias("lang"), "n", "nll"))
    centres = judges.groupBy(F.col("lang").alias("l")).agg((F.sum("nll") / F.sum("n")).alias("centre"))
    shrunk = judges.join(F.broadcast(centres), F.col("lang").eqNullSafe(F.col("l"))).withColumn("s", (F.col("nll") + SHRINK * F.col("centre")) / (F.col("n") + SHRINK))
    limits = shrunk.groupBy("lang").agg(F.first("centre").alias("centre"), F.percentile_approx("s", quantile, 10_000).alias("limit"))
    rows = [(r["lang"], r["centre"], r["limit"] * margin) for r in limits.collect()]  # one a language
    limits = F.broadcast(small_table(spark, rows, "_key string, _centre double, _limit double"))

    n, nll = F.col("_n"), F.col("_nll")
    value = F.when(n > 0, (nll + SHRINK * F.col("_centre")) / (n + SHRINK))
    judged = row_scores(scored, {c: kinds[c] for c in columns}).join(limits, F.col("_lang").eqNullSafe(F.col("_key")), "left")
    kept = F.coalesce(value <= F.col("_limit"), F.lit(True))
    judged = judged.filter(kept) if kept_only else judged
    mean = nll / n
    final = {"n_scored": n, "perplexity": F.exp(mean), "mean_nll": mean, "score": value, "threshold": F.col("_limit"), "kept": kept}
    return judged.select(*columns, *(final[c].alias(c) for c in scores))
