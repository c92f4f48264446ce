"""Quality rules: base counts of words and lines, and tokeniser fertility.

Fertility of a whole text under a public vocabulary with byte fallback: characters per token, the
share of byte-fallback tokens, and the Shannon entropy of its tokens. A document is rejected
where one of them leaves the band of its language and length class (powers of two of tokens).
Bands are Tukey fences, ``FENCE`` interquartile ranges beyond the quartiles, of the documents of
the class that pass the base rules, fitted once more to those inside the first bands. ``FENCE`` is
the least of 4, 3, 2.5, 2 and 1.5 that rejects at most 1 % of the documents labelled good. A class of fewer than ``MIN_CLASS`` documents takes in the
nearest classes of its language, without the trend by length; a language of fewer is rejected
where it leaves the bands of all other languages, or of all documents where no language has more.

Defined cases: null text has no words and fails the base rules; a null language is a language of
its own; ids that repeat or are null stay rows of their own; a measure that ties with a band's edge is
inside; a text of any length is read in whole by one task; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.llm.common import WORD, arrow_map, by_size, cut

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 10
REPEAT_SHARE = 20
WINDOW = 5
FENCE = 2.5
MIN_CLASS = 50
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(WORD)
_LONG = 5000


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that are found at least twice in the text, first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n <= _LONG:
        windows = list(zip(*(words[i:] for i in range(window)), strict=False))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        again = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    else:  # ranks of windows of growing width, exact and without a tuple per window
        numbers: dict[str, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        rank = ids
        for width in range(1, window):
            m = len(words) - width
            _, rank = np.unique(rank[:m] * len(numbers) + ids[width:], return_inverse=True)
        again = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


_FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("lang", pa.string()),
        *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")),
        *((c, pa.float64()) for c in ("chars_per_token", "byte_share", "entropy")),
    ]
)
_FEATURES_DDL = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_tokens long, chars_per_token double, byte_share double, entropy double"
)


def text_features(docs: DataFrame, path: str) -> DataFrame:
    """Base counts and fertility of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            if model is None:
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_file=path)
                is_byte = np.fromiter((model.is_byte(i) for i in range(model.vocab_size())), bool, model.vocab_size())
            for batch in by_size(whole, "text", 1_000_000):
                texts = batch.column("text").to_pylist()
                counts = []
                for text in texts:
                    words = _WORD.findall(text)
                    counts.append((len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words)))
                ids = [np.asarray(x, np.int64) for x in model.encode(texts, num_threads=1)]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(ids)), n)
                pairs, times = np.unique(doc * model.vocab_size() + flat, return_counts=True)
                owner = pairs // model.vocab_size()
                some = np.maximum(n, 1)
                p = times / some[owner]
                entropy = np.bincount(owner, -p * np.log2(p), len(ids))
                share = np.bincount(doc, is_byte[flat], len(ids)) / some
                chars = np.fromiter(map(len, texts), np.int64, len(ids)) / some
                made = [*(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), *map(pa.array, (n, chars, share, entropy))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *made], schema=_FEATURES)

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text")]
    return arrow_map(docs.select(*cols), run, _FEATURES_DDL)


MEASURES = ("chars_per_token", "byte_share", "entropy")


#: Spread below which a measure's quartiles say little: characters, share, bits.
LEAST = {"chars_per_token": 0.1, "byte_share": 0.01, "entropy": 0.1}
_LONGEST = 64.0
_BAND = ", ".join(["b_lang string, b_class int, x_lo double, x_hi double", *(f"{m}_slope double, {m}_lo double, {m}_hi double" for m in MEASURES)])


def _length() -> Column:
    return F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))


def _windows(sizes: dict[tuple[str | None, int], int], targets: set[tuple[str | None, int]], min_class: int) -> tuple[dict, dict]:
    """The classes that a band is made of, by (language, class); and the keys that judge each target.

    A class of ``min_class`` documents stands for itself. A smaller one takes its language's nearest
    classes as well. A language of fewer documents is judged by all languages that have a band of
    that class; where there are none, all documents are one language."""
    total: dict[str | None, int] = {}
    for (lang, _), n in sizes.items():
        total[lang] = total.get(lang, 0) + n
    large = [x for x, n in total.items() if n >= min_class]
    windows, judges = {}, {}

    def near(key: tuple, langs: list[str | None]) -> tuple:
        if key not in windows:
            own = {k: n for k, n in sizes.items() if k[0] in langs and n}
            width = 0
            while True:
                found = [k for k in own if abs(k[1] - key[1]) <= width]
                if len(found) == len(own) or sum(own[k] for k in found) >= min_class:
                    break
                width += 1
            windows[key] = found, width > 0
        return key

    for lang, c in targets:
        if lang in large:
            judges[lang, c] = [near((lang, c), [lang])]
        elif large:
            judges[lang, c] = [near((x, c), [x]) for x in large]
        elif sizes:
            judges[lang, c] = [near(("", c, "all"), list(total))]
    return windows, judges


def fertility_bands(features: DataFrame, fence: float = FENCE, min_class: int = MIN_CLASS, targets: set[tuple[str | None, int]] | None = None) -> DataFrame:
    """The band of each measure by language and length class, for those of ``features`` and ``targets``.

    In bands of several classes a measure is taken without its trend by length (a line through the
    documents, flat outside their 5 to 95 percent, where the band of entropy opens by a bit for each
    doubling: entropy can't change faster). Few rows are collected: one a language and class."""
    spark = features.sparkSession
    sizes = {(r["lang"], r["size_class"]): r["n"] for r in features.groupBy("lang", "size_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    windows, judges = _windows(sizes, set(sizes) | (targets or set()), min_class)
    keys = list(windows)
    made = {}
    if keys:
        members = [(lang, c, g) for g, k in enumerate(keys) for lang, c in windows[k][0]]
        members = F.broadcast(spark.createDataFrame(members, "m_lang string, m_class int, g int"))
        rows = features.withColumn("x", _length()).join(members, F.col("lang").eqNullSafe(F.col("m_lang")) & (F.col("size_class") == F.col("m_class"))).select("g", "x", *MEASURES)
        line = {g: (0.0, _LONGEST, *[0.0] * len(MEASURES)) for g in range(len(keys))}
        wide = [g for g, k in enumerate(keys) if windows[k][1]]
        if wide:
            some = rows.join(F.broadcast(spark.createDataFrame([(g,) for g in wide], "w int")), F.col("g") == F.col("w"))
            edge = F.percentile_approx("x", [0.05, 0.95], 1000)
            edges = F.broadcast(spark.createDataFrame([(r["g"], *r["e"]) for r in some.groupBy("g").agg(edge.alias("e")).collect()], "e int, x_lo double, x_hi double"))
            clipped = some.join(edges, F.col("g") == F.col("e")).withColumn("x", F.least(F.greatest("x", "x_lo"), "x_hi"))
            slopes = clipped.groupBy("g").agg(F.first("x_lo").alias("lo"), F.first("x_hi").alias("hi"), *(F.coalesce(F.regr_slope(m, "x"), F.lit(0.0)).alias(m) for m in MEASURES))
            line |= {r["g"]: (r["lo"], r["hi"], *(r[m] for m in MEASURES)) for r in slopes.collect()}
        lines = F.broadcast(spark.createDataFrame([(g, *v) for g, v in line.items()], ", ".join(["l int, x_lo double, x_hi double", *(f"{m}_slope double" for m in MEASURES)])))
        level = rows.join(lines, F.col("g") == F.col("l"))
        quarters = [F.percentile_approx(_flat(m), [0.25, 0.75], 1000).alias(m) for m in MEASURES]
        for r in level.groupBy("g").agg(*quarters).collect():
            band = {}
            for m, slope in zip(MEASURES, line[r["g"]][2:], strict=True):
                q1, q3 = r[m]
                spread = max(q3 - q1, LEAST[m])
                band[m] = slope, q1 - fence * spread, q3 + fence * spread
            made[keys[r["g"]]] = (*line[r["g"]][:2], band)
    out = []
    for (lang, c), names in judges.items():
        lo, hi, band = made[names[0]]
        if len(names) > 1:  # whatever is inside one of the bands, at the middle of the class
            at = [(b, min(max(c + 0.5, x), y), m) for m in MEASURES for x, y, b in (made[k] for k in names)]
            opened = [(m, b[m][0] * x + b[m][1] - (m == "entropy") * max(0.0, x - c - 0.5), b[m][0] * x + b[m][2] + (m == "entropy") * max(0.0, c + 0.5 - x)) for b, x, m in at]
            lo, hi = 0.0, _LONGEST
            band = {m: (0.0, min(a for k, a, _ in opened if k == m), max(b for k, _, b in opened if k == m)) for m in MEASURES}
        out.append((lang, c, lo, hi, *(v for m in MEASURES for v in band[m])))
    return spark.createDataFrame(out, _BAND)


def _flat(m: str) -> Column:
    """A measure without its trend by length."""
    return F.col(m) - F.col(f"{m}_slope") * F.least(F.greatest(F.col("x"), F.col("x_lo")), F.col("x_hi"))


def _judged(features: DataFrame, bands: DataFrame) -> DataFrame:
    """Adds ``reason``, null for those that are kept."""
    joined = features.withColumn("x", _length()).join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("size_class") == F.col("b_class")), "left")
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for m in MEASURES:
        below, above = (F.greatest(d, F.lit(0.0)) if m == "entropy" else F.lit(0.0) for d in (F.col("x_lo") - F.col("x"), F.col("x") - F.col("x_hi")))
        reason = reason.when((_flat(m) < F.col(f"{m}_lo") - below) | (_flat(m) > F.col(f"{m}_hi") + above), F.lit(m))
    return joined.withColumn("reason", reason)


def quality_rules(docs: DataFrame, path: str, fence: float = FENCE, min_class: int = MIN_CLASS) -> DataFrame:
    """Per document: counts, fertility, base_failed, kept and the measure that rejected it."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_SHARE) * F.col("n_words"))
    size_class = F.when(F.col("n_tokens") > 0, F.floor(F.log2(F.col("n_tokens").cast("double")))).otherwise(F.lit(-1)).cast("int")
    features = cut(text_features(docs, path).withColumn("base_failed", failed).withColumn("size_class", size_class))
    passed = features.filter("not base_failed")
    bands = fertility_bands(passed, fence, min_class)
    targets = {(r["b_lang"], r["b_class"]) for r in bands.select("b_lang", "b_class").collect()}
    bands = fertility_bands(_judged(passed, bands).filter("reason is null").select(passed.columns), fence, min_class, targets)
    return _judged(features, bands).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("reason").isNull().alias("kept"), "reason", "lang", "n_tokens", *MEASURES,
    )
