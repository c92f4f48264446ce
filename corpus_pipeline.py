"""A corpus through quality, near-duplicate and repeated-string filters, a source mix and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back as
the next one's ``docs``. All but the last return the columns of ``documents``; other columns of the
input are left behind, whatever their names. All stages take an empty table (and return one), null ids,
null and empty texts, texts of any length and rows that repeat; what each does with them stands below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm import kneser, mixing, near, packing, substrings
from lexaudit.llm.common import shared_path, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold, ties included.

    Null and empty texts, and those of a language without trusted text, have none and stay; rows that repeat
    are judged one by one, null ids too (they are never trusted)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser.classify(docs, labels, columns=COLUMNS, scores=(), kept_only=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id, nulls last, one row of it.

    Ties, one id with several texts of a class, go to the text with the least MD5. Null and empty texts are
    one class, and of rows that repeat one stays."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    first = near.near_classes(docs).groupBy("label").agg(F.min(rank).alias("k")).select(F.col("k.id").alias("k_id"), F.col("k.node").alias("k_node"))
    named = docs.withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept = named.join(first, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("node") == F.col("k_node")), "left_semi")
    return kept.dropDuplicates(["doc_id", "node"]).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document has; texts of which nothing is left go.

    A cut inside a character drops the rest of that character. Rows without an id keep their text, null
    texts become empty and stay, and rows that share an id don't remove each other."""
    left = substrings.remove_repeats(docs, keep=("lang", "source"), with_text=True)
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    text = F.coalesce(text, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    named = left.withColumn("text", text).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return named.select("doc_id", "text", "lang", "source", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole documents, halves up.

    Texts without words stay once; a null source is a source; rows that repeat are mixed one by one."""
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(1)).cast("int")
    copies = mixed.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    return copies.select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096 tokens; null text is empty, and every row has a piece at least."""
    return packing.pack_documents(docs, vocabulary(packing.VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
