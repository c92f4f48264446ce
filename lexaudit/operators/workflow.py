"""The correction workflow: verified documents and proposed rewrites in, a status and a final text out.

Rewrites come from a recorded table (document, claim, proposal) or a corrector fed with Arrow batches;
scores of what is verified again come from a recorded table. Every step is a join or an aggregate over all
documents at once; what several steps read is cut off in the shared folder. Later steps see only documents that pass the gates before them, so no score is asked for
that a document at a time would not have asked for either."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexaudit import schemas as S
from lexaudit.functions import text as T
from lexaudit.operators import claims as C
from lexaudit.operators import evidence as E
from lexaudit.operators import gates, verdicts
from lexaudit.session import cut


def generate_with(cases: DataFrame, generator: Callable[[], Callable[[pd.Series], pd.Series]], text: str = "case_text") -> DataFrame:
    """Adds ``text`` to cases from a generator, made once a task and fed Arrow batches of case texts."""
    schema = StructType([*cases.schema.fields, StructField("text", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or generator()
            yield b.assign(text=model(b[text]))

    return cases.mapInPandas(run, schema)


def distinct_cases(cases: DataFrame, doc: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Cases that differ in anything but ``doc``, each under its least document, and (doc, first): which of them stands for a document.

    What becomes of a case follows from its own columns, so equal cases need to be worked on once."""
    own = [c for c in cases.columns if c != doc]
    firsts = cut(cases.groupBy(*own).agg(F.min(doc).alias(doc)).select(*cases.columns))
    same = F.lit(True)
    for c in own:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    named = firsts.select(F.col(doc).alias("first"), *[F.col(c).alias(f"_{c}") for c in own])
    return firsts, cut(cases.join(named, same).select(doc, "first"))


def of_all(results: DataFrame, members: DataFrame, doc: str = "document_id") -> DataFrame:
    """Results of distinct cases for every document that they stand for."""
    return members.withColumnRenamed(doc, "_doc").join(results, F.col("first") == F.col(doc)).select(*[F.col("_doc").alias(doc) if c == doc else F.col(c) for c in results.columns])


def target_spans(claim_text: Column, assertion_text: Column, spans: Column) -> Column:
    """What a rewrite of a claim may touch is the last span; the spans before it must stay."""
    own = F.array(F.coalesce(F.nullif(assertion_text, F.lit("")), claim_text))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, spans).otherwise(own)


def targets(claims: DataFrame, by_span: bool = False, doc: str = "document_id") -> DataFrame:
    """The claim of each document that is to be rewritten: doc, target_claim_id, what a corrector is given, and why."""
    t = gates.flagged_claim(claims, doc).withColumn("target_spans", target_spans(F.col("claim_text"), F.col("assertion_text"), F.col("assertion_spans")))
    given = F.element_at("target_spans", -1) if by_span else F.col("claim_text")
    return t.select(doc, F.col("claim_id").alias("target_claim_id"), "claim_text", "target_spans", given.alias("original"), F.col("evidence.canonical_text").alias("evidence_text"), "trigger_reason")


def propose_with(asked: DataFrame, corrector: Callable[[], Callable[[pd.DataFrame], pd.Series]], doc: str = "document_id") -> DataFrame:
    """Proposals for ``targets`` from a corrector, made once a task and fed Arrow batches of (original, evidence_text)."""
    rows = asked.select(doc, "target_claim_id", "original", "evidence_text")
    kind = StructType([*rows.select(doc, "target_claim_id").schema.fields, StructField("proposal", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or corrector()
            yield b[[doc, "target_claim_id"]].assign(proposal=model(b[["original", "evidence_text"]]))

    return rows.mapInPandas(run, kind)


def _spliced(fields: DataFrame, asked: DataFrame, proposals: DataFrame, by_span: bool, doc: str) -> DataFrame:
    """Documents with the first gates and the rewritten text. A target without a proposal fails the query when read."""
    said = proposals.select(F.col(doc).alias("_d"), F.col("target_claim_id").alias("_c"), "proposal", F.lit(True).alias("_there"))
    both = fields.select(doc, "text").join(asked, doc, "left").join(said, (F.col(doc) == F.col("_d")) & (F.col("target_claim_id") == F.col("_c")), "left")
    flagged = F.col("target_claim_id").isNotNull()
    spans_ok = F.coalesce((F.size("target_spans") > 0) & F.forall("target_spans", lambda s: F.coalesce(F.length(s), F.lit(0)) > 0), F.lit(False))
    missing = flagged & F.col("_there").isNull() & (spans_ok if by_span else F.lit(True))
    checked = F.when(missing, F.raise_error(F.concat(F.lit("no proposal for document "), F.col(doc).cast("string"))).cast("string")).otherwise(F.coalesce("proposal", F.lit("")))
    rows = both.select(doc, "text", "target_claim_id", "claim_text", "target_spans", "trigger_reason", flagged.alias("flagged"), F.lit(by_span).alias("by_span"), spans_ok.alias("spans_ok"), checked.alias("proposal"))
    if by_span:
        part = F.element_at("target_spans", -1)
        once = (F.length("proposal") > 0) & (T.occurrences(part, F.col("claim_text")) == 1) & (T.occurrences(F.col("claim_text"), F.col("text")) == 1)
        rows = rows.withColumn("sentence_found", F.lit(True)).withColumn(
            "corrected_text", F.when(F.col("flagged") & F.col("spans_ok") & once, F.replace("text", F.col("claim_text"), F.replace("claim_text", part, F.col("proposal"))))
        )
        kept = F.forall(F.slice("target_spans", 1, F.greatest(F.size("target_spans") - 1, F.lit(0))), lambda s: T.fragment_present(s, F.col("corrected_text")))
        rows = rows.withColumn("structure_kept", F.coalesce(kept, F.lit(True)))
    else:
        rows = rows.withColumn("sentence_found", T.sentence_count(F.col("proposal")) == 1).withColumn("structure_kept", F.lit(True))
        rows = rows.withColumn("corrected_text", F.when(F.col("flagged") & F.col("sentence_found"), T.splice_once(F.col("text"), F.col("claim_text"), T.stripped(F.col("proposal")))))
    return rows.withColumn("spliced", F.col("corrected_text").isNotNull())


def _verified(rows: DataFrame, evidence: DataFrame, scores: DataFrame, framing: str, threshold: float, fuzzy: float) -> DataFrame:
    return verdicts.verify(E.match_evidence(rows, evidence, fuzzy), scores, framing, threshold)


def correct(fields: DataFrame, claims: DataFrame, proposals: DataFrame, evidence: DataFrame, scores: DataFrame, by_span: bool = False, strictness: str = "claim_text",
            framing: str = "labeled", threshold: float = verdicts.THRESHOLD, fuzzy: float = E.FUZZY_LEAST, narrow: bool = False, doc: str = "document_id") -> DataFrame:
    """One row a document of ``fields`` (doc, text): target_claim_id, trigger_reason, status, attempts,
    regenerated_text, reverified, n_regressions, final_field.

    ``claims`` are verified (``verdicts.verify``), ``proposals`` are (doc, target_claim_id, proposal): a whole
    sentence, or with ``by_span`` the last span's replacement. ``strictness`` says what of the other claims must
    survive; below the whole sentence, and by span, their counterparts are verified again. Jobs run while this is planned."""
    claims = cut(claims)
    first = cut(_spliced(fields, targets(claims, by_span, doc), proposals, by_span, doc))
    made = first.filter("spliced and structure_kept").select(doc, "target_claim_id", "corrected_text")
    before = claims.join(made.select(doc), doc, "left_semi")
    after = cut(C.extract_claims(made.select(doc, F.col("corrected_text").alias("text")), doc, distinct_texts=True))
    kept = gates.scope_kept(before, made, strictness, doc)
    new = gates.new_identities(before, after, doc)
    paired = cut(gates.counterparts(before, after, doc))
    clash = gates.ordinal_ambiguous(paired, made.select(doc, F.col("target_claim_id").alias("claim_id")), doc)
    safe = made.join(kept.filter("siblings_kept"), doc, "left_semi").join(new.filter("n_new = 0"), doc, "left_semi").join(clash.filter("not ambiguous"), doc, "left_semi")
    safe = cut(safe)

    own = paired.join(safe.select(F.col(doc).alias("_d"), F.col("target_claim_id").alias("_t")), (F.col(doc) == F.col("_d")) & (F.col("claim_id") == F.col("_t"))).filter("new_text is not null")
    asked = F.coalesce(F.nullif("new_assertion", F.lit("")), "new_text") if narrow else F.col("new_text")
    again = own.select(doc, "claim_id", F.col("new_text").alias("claim_text"), F.col("new_citation").alias("citation"), asked.alias("assertion_text"), F.array(asked).alias("assertion_spans"))
    again = cut(_verified(again, evidence, scores, framing, threshold, fuzzy).select(doc, F.col("verdict").alias("reverified")))

    rows = first
    for part in (kept, new, clash, again):
        rows = rows.join(part, doc, "left")
    if by_span or strictness != "claim_text":
        entailed = safe.join(again.filter(F.col("reverified") == S.ENTAILED), doc, "left_semi")
        others = gates.siblings_to_recheck(paired, entailed, doc).select(
            doc, "claim_id", F.col("new_text").alias("claim_text"), F.col("new_citation").alias("citation"), F.col("new_assertion").alias("assertion_text"), F.col("new_spans").alias("assertion_spans")
        )
        worse = _verified(others, evidence, scores, framing, threshold, fuzzy).filter(F.col("verdict") == S.CONTRADICTED)
        rows = rows.join(worse.groupBy(doc).agg(F.count(F.lit(1)).alias("n_regressions")), doc, "left")
    else:
        rows = rows.withColumn("n_regressions", F.lit(0).cast("long"))
    judged = rows.withColumn("n_regressions", F.coalesce("n_regressions", F.lit(0)))
    judged = judged.withColumn("status", gates.status(judged))
    status = F.col("status")
    return judged.select(
        doc, "target_claim_id", gates.shown_reason(status, F.col("trigger_reason")).alias("trigger_reason"), "status", gates.attempts(status).alias("attempts"),
        F.when(F.col("flagged"), F.coalesce("corrected_text", F.nullif("proposal", F.lit("")))).alias("regenerated_text"), "reverified", "n_regressions",
        gates.final_field(status, F.col("text"), F.col("corrected_text")).alias("final_field"),
    )
