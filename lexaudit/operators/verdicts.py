"""Verdicts from model scores, what triggers a correction, and what a scorer is asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from lexaudit import schemas as S
from lexaudit.functions import stats
from lexaudit.functions import text as T
from lexaudit.session import grown

THRESHOLD = 0.70
TOKEN_LIMIT = 512


def verdict(scores: Column, threshold: Column | float = THRESHOLD) -> Column:
    """(label, confidence, sub_reason) of a score map: the largest, ties to the first in label order;
    below the threshold it is not enough information, for low confidence."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    listed = F.array(*[F.struct(F.coalesce(scores[k], F.lit(float("-inf"))).alias("p"), F.lit(-i).alias("first"), F.lit(v).alias("label")) for i, (k, v) in enumerate(S.SCORE_LABELS)])
    top = F.array_max(listed)
    low = top["p"] < t
    return F.when(
        F.size(scores) > 0,
        F.struct(
            F.when(low, F.lit(S.NEI)).otherwise(top["label"]).alias("label"),
            top["p"].alias("confidence"),
            F.when(low, F.lit("low_confidence")).alias("sub_reason"),
        ),
    )


def trigger(label: Column, sub_reason: Column) -> Column:
    """Why a claim calls for correction; null if it doesn't."""
    return F.when(label == S.CONTRADICTED, F.lit("contradicted")).when((label == S.NEI) & (sub_reason == "low_confidence"), F.lit("low_confidence_nei"))


def negation_caveat(label: Column, claim_text: Column) -> Column:
    """A contradiction that may only be a denial: the claim says that something does not apply."""
    return (label == S.CONTRADICTED) & T.negated(claim_text)


def hypothesis(claim_text: Column, assertion_text: Column, spans: Column, number: Column, narrow: bool = True, by_span: bool = True) -> Column:
    """What is held against the evidence: the narrowest certain statement of the claim."""
    out = claim_text
    if narrow:
        out = F.when((assertion_text != claim_text) & (F.length(assertion_text) > 0), assertion_text).otherwise(out)
    if by_span:
        paired = (F.size(spans) == 2) & (F.get(spans, F.lit(0)) == number) & (assertion_text == claim_text)
        out = F.when(paired, F.get(spans, F.lit(1))).otherwise(out)
    return out


def replay(pairs: DataFrame, scores: DataFrame, model: str | None = None, asked: Column | None = None) -> DataFrame:
    """Adds recorded scores (premise_hash, hypothesis_hash, raw_scores, token_count) to pairs.

    Of scores by several models (``verifier_model``) name one. A pair that was too long for the model, has no
    recorded score or has several fails the query when read. Rows that aren't ``asked`` get null and are dealt
    out by their position, as they have no pair to meet."""
    own = scores if model is None else scores.filter(F.col("verifier_model") == model)
    s = own.groupBy(F.col("premise_hash").alias("_p"), F.col("hypothesis_hash").alias("_h")).agg(F.first("raw_scores").alias("raw_scores"), F.max("token_count").alias("token_count"), F.count(F.lit(1)).alias("_n"))
    ask = F.lit(True) if asked is None else asked
    idle = F.concat(F.lit("-"), (F.monotonically_increasing_id() % 1024).cast("string"))
    keyed = pairs.withColumn("_ask", ask).withColumn("_ph", F.when(F.col("_ask"), F.sha2("premise", 256)).otherwise(idle)).withColumn("_hh", F.sha2("hypothesis", 256))
    joined = keyed.join(grown(s), (F.col("_ph") == F.col("_p")) & (F.col("_hh") == F.col("_h")), "left")
    wrong = (
        F.when(F.col("_n").isNull() | F.col("raw_scores").isNull(), F.concat(F.lit("no recorded score for: "), "hypothesis"))
        .when(F.col("_n") > 1, F.concat(F.lit("several recorded scores for: "), "hypothesis"))
        .when(F.col("token_count") > TOKEN_LIMIT, F.lit("input exceeds the token limit"))
    )
    checked = F.when(F.col("_ask") & wrong.isNotNull(), F.raise_error(wrong)).when(F.col("_ask"), F.col("raw_scores"))
    return joined.withColumn("raw_scores", checked).drop("_ask", "_ph", "_hh", "_p", "_h", "_n")


def score_with(pairs: DataFrame, scorer: Callable[[], Callable[[pd.DataFrame], pd.Series]], size: int | None = None) -> DataFrame:
    """Adds ``raw_scores`` from a scorer, made once a task and fed batches of (premise, hypothesis): of ``size`` rows
    at most, as a language model takes them, or Arrow batches whole. Rows go back by Arrow batches whatever the size."""
    if size is not None and size < 1:
        raise ValueError("batches have a row at least")
    schema = StructType([*pairs.schema.fields, StructField("raw_scores", MapType(StringType(), DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for whole in batches:
            model = model or scorer()
            told: list = []
            for at in range(0, len(whole), size or max(len(whole), 1)):
                b = whole.iloc[at : at + (size or len(whole))]
                answers = model(b)
                if not isinstance(answers, list) or len(answers) != len(b):  # by index, as a column is set; lists go by place
                    answers = pd.Series(answers, index=b.index, dtype=object)
                told.extend(answers)
            yield whole.assign(raw_scores=pd.Series(told, index=whole.index, dtype=object))

    return pairs.mapInPandas(run, schema)


def verify(claims: DataFrame, scores: DataFrame, framing: str = "labeled", threshold: float = THRESHOLD, model: str | None = None) -> DataFrame:
    """Claims (matched, see ``evidence.match_evidence``) with verdict columns. Only claims with evidence are scored."""
    has = F.col("evidence").isNotNull()
    premise = T.premise(F.lit(framing), F.col("evidence.canonical_text"), F.col("evidence.provision_type"), F.col("evidence.provision_number"), F.col("evidence.act"))
    said = hypothesis(F.col("claim_text"), F.col("assertion_text"), F.col("assertion_spans"), F.col("citation.provision_number"))
    asked = claims.withColumn("premise", F.when(has, premise)).withColumn("hypothesis", F.when(has, said))
    scored = replay(asked, scores, model, has).withColumn("_v", verdict(F.col("raw_scores"), threshold)).drop("token_count")
    label = F.when(has, F.col("_v.label")).otherwise(F.lit(S.NO_EVIDENCE))
    both = scored.select("*", label.alias("verdict"), F.col("_v.confidence").alias("confidence"), F.col("_v.sub_reason").alias("sub_reason")).drop("_v")
    return both.withColumn("trigger_reason", trigger(F.col("verdict"), F.col("sub_reason"))).withColumn("negation_caveat", F.coalesce(negation_caveat(F.col("verdict"), F.col("claim_text")), F.lit(False)))


def chunk_verdict(chunks: Column, threshold: float = THRESHOLD) -> Column:
    """Of a pair whose premise was scored in chunks (arrays in the order of ``SCORE_LABELS``): the verdict of the
    chunks' mean, that of the first chunk alone, and whether the other chunks change it."""

    def named(scores: Column) -> Column:
        return F.create_map(*[x for i, (k, _) in enumerate(S.SCORE_LABELS) for x in (F.lit(k), F.round(F.get(scores, F.lit(i)), 9))])

    whole, first = verdict(named(stats.softmax_chunk_mean(chunks)), threshold), verdict(named(F.get(chunks, F.lit(0))), threshold)
    return F.struct(
        whole["label"].alias("label"), whole["confidence"].alias("confidence"), whole["sub_reason"].alias("sub_reason"), first["label"].alias("prefix_label"), first["confidence"].alias("prefix_confidence"),
        ((F.size(chunks) > 1) & (whole["label"] != first["label"])).alias("changes"),
    )


def verdict_counts(claims: DataFrame, *by: str, labels: tuple[str, ...] = S.VERDICTS) -> DataFrame:
    """A column for each label, zero where there is none; other labels are ignored."""
    return claims.groupBy(*by).agg(*(F.count_if(F.col("verdict") == label).alias(label) for label in labels))


def threshold_sweep(scored: DataFrame, thresholds: list[float], gold: str = "expected_label") -> DataFrame:
    """Replay of stored scores at many thresholds: (threshold, gold, predicted, n, n_low).

    Each row is counted once, by its label and by how many thresholds its confidence reaches; sums over those
    counts give every threshold, so that the work grows with the rows and not with the thresholds."""
    points = sorted(float(t) for t in thresholds)
    top = verdict(F.col("raw_scores"), F.lit(float("-inf")))
    judged = scored.select(F.col(gold).alias("gold"), top.alias("v")).select("gold", F.col("v.label").alias("label"), F.col("v.confidence").alias("c"))
    reached = sum((F.when(F.col("c") < t, 0).otherwise(1) for t in points), F.lit(0))  # no scores: no threshold makes a low confidence
    counts = judged.groupBy("gold", "label", reached.alias("reached")).agg(F.count(F.lit(1)).alias("n"))
    at = counts.select("*", F.posexplode(F.array(*[F.lit(t) for t in points])).alias("i", "threshold"))
    low = F.col("reached") <= F.col("i")
    predicted = F.when(low, F.lit(S.NEI)).otherwise(F.col("label"))
    return at.groupBy("threshold", "gold", predicted.alias("predicted")).agg(F.sum("n").alias("n"), F.sum(F.when(low, F.col("n")).otherwise(0)).alias("n_low"))


def drop_private(df: DataFrame) -> DataFrame:
    """Without columns whose name starts with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def llm_label(answer: Column) -> Column:
    """Label in a free answer. The first label found counts, entailment before all, so a denied
    label reads as that label; kept for comparability."""
    up = F.upper(answer)
    out = F.when(F.contains(up, F.lit("ENTAILED")), F.lit(S.ENTAILED)).when(F.contains(up, F.lit("CONTRADICTED")), F.lit(S.CONTRADICTED))
    return out.otherwise(F.lit(S.NEI))
