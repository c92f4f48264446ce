"""Candidate selection: scorecards, exclusion funnel, diversity-first order, seeded samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: acts of procedure, which say little about a case's subject.
PROCEDURAL_ACTS = ("code of criminal procedure 1973", "code of civil procedure 1908")


def case_score(exact: Column, fuzzy: Column, pairs: Column, substantive: Column) -> Column:
    return 3 * exact + 2 * fuzzy + 2 * pairs + substantive


def scorecard(matched: DataFrame, case: str = "document_id") -> DataFrame:
    """One row a case of matched raw citations (match_method, act_norm and provision_number of the evidence; nulls unmatched)."""
    hit = F.col("match_method") != "no_evidence"
    procedural = F.col("act_norm").isin(*PROCEDURAL_ACTS)
    pair = F.when(hit, F.struct("act_norm", "provision_number"))
    out = matched.groupBy(case).agg(
        F.count(F.lit(1)).alias("n_citations_parsed"),
        F.count_if(F.col("match_method") == "exact_normalized").alias("n_matched_exact"),
        F.count_if(F.col("match_method") == "fuzzy").alias("n_matched_fuzzy"),
        F.count_if(~hit).alias("n_no_evidence"),
        F.array_sort(F.collect_set(pair)).alias("matched_pairs"),
        F.count_distinct(F.when(hit, F.col("act_norm"))).alias("n_distinct_acts_matched"),
        F.count_if(hit & ~procedural).alias("substantive_matches"),
        F.count_if(hit & procedural).alias("procedural_matches"),
    )
    out = out.withColumn("n_distinct_evidence_pairs", F.size("matched_pairs").cast("long"))
    score = case_score(F.col("n_matched_exact"), F.col("n_matched_fuzzy"), F.col("n_distinct_evidence_pairs"), F.col("substantive_matches"))
    return out.withColumn("score", score).withColumn("is_purely_procedural", (F.col("substantive_matches") == 0) & (F.col("procedural_matches") > 0))


def usable_text(cases: DataFrame, text: str = "case_text", least: int = 20) -> DataFrame:
    return cases.filter(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= least)


def best_variant(scored: DataFrame, case: str = "document_id", order: str = "file_ord") -> DataFrame:
    """One variant a case: best score, then fewest raw keys, then first in file order."""
    w = W.partitionBy(case).orderBy(F.col("score").desc(), "n_raw_citation_keys", order)
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def exclusion_reason(previously: Column, n_keys: Column, n_matched: Column) -> Column:
    return F.when(previously, "previously_evaluated").when(n_keys == 0, "no_citations").when(n_matched == 0, "no_evidence").otherwise("eligible")


def funnel(cases: DataFrame, evaluated: DataFrame, case: str = "document_id") -> DataFrame:
    """Cases by the first reason that excludes them."""
    seen = evaluated.select(F.col(case).alias("_e")).distinct().withColumn("_seen", F.lit(True))
    flagged = cases.join(seen, F.col(case) == F.col("_e"), "left")
    reason = exclusion_reason(F.coalesce("_seen", F.lit(False)), F.col("n_raw_citation_keys"), F.col("n_matched_exact") + F.col("n_matched_fuzzy"))
    return flagged.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def diversity_first(eligible: DataFrame, case: str = "document_id") -> DataFrame:
    """Adds ``is_diverse`` and ``place``: cases that bring a pair none before them has come first.

    A case without a new pair adds nothing to what is covered, so a case is diverse exactly if it
    is, in score order, the first owner of some pair: one aggregate per pair, no sequential pass."""
    order = F.struct((-F.col("score")).alias("s"), (-F.col("n_distinct_evidence_pairs")).alias("p"), F.col(case).alias("c"))
    ranked = eligible.withColumn("_order", order)
    owners = ranked.select("_order", F.explode("matched_pairs").alias("pair")).groupBy("pair").agg(F.min("_order").alias("o")).select(F.col("o.c").alias("_owner")).distinct()
    flagged = ranked.join(owners, F.col(case) == F.col("_owner"), "left").withColumn("is_diverse", F.col("_owner").isNotNull())
    return flagged.drop("_owner").withColumn("_place", F.struct((~F.col("is_diverse")).alias("later"), F.col("_order")))


def top_cases(eligible: DataFrame, n: int, case: str = "document_id") -> DataFrame:
    """The first n cases of the diversity-first order, with their place."""
    first = diversity_first(eligible, case).orderBy("_place").limit(n)
    return first.withColumn("place", F.row_number().over(W.orderBy("_place"))).drop("_place", "_order")


def batch_summary(batch: DataFrame) -> DataFrame:
    pairs = batch.select(F.explode("matched_pairs").alias("p")).agg(F.count_distinct("p").alias("n_pairs"), F.count_distinct("p.act_norm").alias("n_acts"))
    sums = batch.agg(F.count(F.lit(1)).alias("n"), F.sum("n_matched_exact").alias("n_exact"), F.sum("n_matched_fuzzy").alias("n_fuzzy"), F.count_if("is_purely_procedural").alias("n_procedural_only"))
    return sums.join(pairs)


def seeded_sample(df: DataFrame, k: int, seed: int = 42, order: str = "file_ord") -> DataFrame:
    """k rows by ordinals drawn without replacement from a seeded generator; ``order`` counts from 0."""
    n = df.count()
    drawn = random.Random(seed).sample(range(n), min(k, n))
    picks = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(drawn)], "_o long, draw int")
    return df.join(picks, F.col(order) == F.col("_o")).drop("_o")


def anti_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def first_of_text(df: DataFrame, text: str, *order: str) -> DataFrame:
    """The first row of each distinct text."""
    w = W.partitionBy(text).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
