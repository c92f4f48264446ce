"""Correction gates: whether a rewrite of one flagged claim may ship.

Each gate is a boolean column; the status is the first that fails. Relational gates (identities,
ordinals, siblings) are grouped by document before the decision, so the decision is one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.functions import text as T
from lexaudit.operators import claims as C

#: Statuses in the order of their gates.
ORDER = (
    "not_triggered", "correction_span_invalid", "correction_scope_violation", "correction_sentence_splice_unavailable",
    "correction_splice_unavailable", "correction_structural_span_lost", "correction_unauthorized_addition", "correction_ordinal_ambiguous",
    "correction_failed", "correction_sibling_regression", "corrected",
)


def flagged_claim(claims: DataFrame, doc: str = "document_id") -> DataFrame:
    """The first claim of each document that calls for correction and isn't excused by a denial."""
    open_ = claims.filter(F.col("trigger_reason").isNotNull() & ~F.col("negation_caveat"))
    return open_.withColumn("_r", F.row_number().over(W.partitionBy(doc).orderBy("claim_ord"))).filter("_r = 1").drop("_r")


def spans_valid(spans: Column, claim_text: Column) -> Column:
    """Spans name at least one non-empty fragment, all of them in the claim."""
    return F.coalesce((F.size(spans) > 0) & F.forall(spans, lambda s: (F.length(s) > 0) & F.contains(claim_text, s)), F.lit(False))


def sibling_fragments(assertion_spans: Column, assertion_text: Column, claim_text: Column, strictness: str) -> Column:
    """What of an unflagged claim must survive: its spans, its assertion, or its whole sentence."""
    whole = F.array(claim_text)
    if strictness == "claim_text":
        return whole
    by_assertion = F.when(F.coalesce(F.length(assertion_text), F.lit(0)) > 0, F.array(assertion_text)).otherwise(whole)
    if strictness == "assertion_text":
        return by_assertion
    return F.when(F.coalesce(F.size(assertion_spans), F.lit(0)) > 0, assertion_spans).otherwise(by_assertion)


def scope_kept(claims: DataFrame, corrected: DataFrame, strictness: str = "assertion_spans", doc: str = "document_id") -> DataFrame:
    """(doc, siblings_kept): every claim but the target keeps its fragments in the corrected text.

    ``corrected``: doc, target_claim_id, corrected_text."""
    both = claims.join(corrected.select(F.col(doc).alias("_d"), "target_claim_id", "corrected_text"), F.col(doc) == F.col("_d"))
    fragments = sibling_fragments(F.col("assertion_spans"), F.col("assertion_text"), F.col("claim_text"), strictness)
    kept = F.forall(fragments, lambda f: T.fragment_present(f, F.col("corrected_text")))
    return both.groupBy(doc).agg(F.bool_and((F.col("claim_id") == F.col("target_claim_id")) | kept).alias("siblings_kept"))


def new_identities(before: DataFrame, after: DataFrame, doc: str = "document_id") -> DataFrame:
    """(doc, n_new): identities of the re-extracted claims that the document didn't have."""
    a = before.groupBy(doc).agg(F.collect_set(C.identity()).alias("old"))
    b = after.groupBy(F.col(doc).alias("_d")).agg(F.collect_set(C.identity()).alias("new"))
    joined = a.join(b, F.col(doc) == F.col("_d"), "left")
    return joined.select(doc, F.coalesce(F.size(F.array_except("new", "old")), F.lit(0)).alias("n_new"))


def counterparts(before: DataFrame, after: DataFrame, doc: str = "document_id") -> DataFrame:
    """Claims with their counterpart after the rewrite: the k-th of an identity with the k-th (null if gone).

    Of the counterpart's text, assertion and spans what ``after`` has is taken over."""
    taken = {"claim_text": "new_text", "assertion_text": "new_assertion", "assertion_spans": "new_spans", "citation": "new_citation", "claim_id": "new_claim_id"}
    news = [F.col(c).alias(new) for c, new in taken.items() if c in after.columns]
    a = C.identity_ordinal(before, doc).select(F.col(doc).alias("_d"), "identity", "ordinal", F.struct(*before.columns).alias("_own"))
    b = C.identity_ordinal(after, doc).select(F.col(doc).alias("_d"), "identity", "ordinal", F.struct(*news).alias("_new"))
    found = F.first("_new", True).over(W.partitionBy("_d", "identity", "ordinal"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_new", F.when(F.col("_d").isNotNull(), found)).filter(F.col("_own").isNotNull())
    return both.select("_own.*", "identity", "ordinal", "_new.*")


def ordinal_ambiguous(paired: DataFrame, targets: DataFrame, doc: str = "document_id") -> DataFrame:
    """(doc, ambiguous): the target's counterpart reads like another original claim of its identity."""
    t = targets.select(F.col(doc).alias("_d"), F.col("claim_id").alias("_t"))
    marked = paired.join(t, F.col(doc) == F.col("_d"))
    w = W.partitionBy(doc, "identity")
    target_new = F.max(F.when(F.col("claim_id") == F.col("_t"), F.col("new_text"))).over(w)
    clash = (F.col("claim_id") != F.col("_t")) & (F.col("claim_text") == F.col("_target_new"))
    return marked.withColumn("_target_new", target_new).groupBy(doc).agg(F.coalesce(F.bool_or(clash), F.lit(False)).alias("ambiguous"))


def siblings_to_recheck(paired: DataFrame, corrected: DataFrame, doc: str = "document_id") -> DataFrame:
    """Counterparts of other claims that are to be scored again: those with evidence that still exist,
    but not ones that were flagged before and stand untouched."""
    c = corrected.select(F.col(doc).alias("_d"), "target_claim_id", "corrected_text")
    both = paired.join(c, F.col(doc) == F.col("_d")).drop("_d")
    untouched = F.col("trigger_reason").isNotNull() & F.contains(F.col("corrected_text"), F.col("claim_text"))
    return both.filter((F.col("claim_id") != F.col("target_claim_id")) & F.col("evidence").isNotNull() & F.col("new_text").isNotNull() & ~untouched)


def status(gates: DataFrame) -> Column:
    """The status of documents with gate columns (nulls count as passed):

    flagged, by_span, spans_ok, sentence_found, spliced, structure_kept, siblings_kept, n_new,
    ambiguous, reverified (verdict of the target's counterpart), n_regressions."""
    have = set(gates.columns)

    def col(name: str, default: bool | int | None) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    by_span = col("by_span", False)
    return (
        F.when(~col("flagged", False), "not_triggered")
        .when(by_span & ~col("spans_ok", True), "correction_span_invalid")
        .when(~by_span & ~col("sentence_found", True), "correction_scope_violation")
        .when(~by_span & ~col("spliced", True), "correction_sentence_splice_unavailable")
        .when(by_span & ~col("spliced", True), "correction_splice_unavailable")
        .when(by_span & ~col("structure_kept", True), "correction_structural_span_lost")
        .when(~col("siblings_kept", True), "correction_scope_violation")
        .when(col("n_new", 0) > 0, "correction_unauthorized_addition")
        .when(col("ambiguous", False), "correction_ordinal_ambiguous")
        .when(F.coalesce(F.col("reverified"), F.lit("")) != S.ENTAILED if "reverified" in have else F.lit(True), "correction_failed")
        .when(col("n_regressions", 0) > 0, "correction_sibling_regression")
        .otherwise("corrected")
    )


def attempts(status_: Column) -> Column:
    return F.when(status_.isin("not_triggered", "correction_span_invalid"), 0).otherwise(1)


def shown_reason(status_: Column, reason: Column) -> Column:
    """The trigger reason as recorded: two statuses leave it out."""
    return F.when(~status_.isin("correction_unauthorized_addition", "correction_ordinal_ambiguous"), reason)


def final_field(status_: Column, original: Column, corrected: Column, compatible: bool = True) -> Column:
    """(text, source): only a passed correction ships. In the compatible form a sentence that could not
    be spliced is recorded as original; otherwise the source is the status."""
    quiet = F.array(F.lit("not_triggered"), *([F.lit("correction_sentence_splice_unavailable")] if compatible else []))
    source = F.when(F.array_contains(quiet, status_), F.lit("original")).otherwise(status_)
    return F.struct(F.when(status_ == "corrected", corrected).otherwise(original).alias("text"), source.alias("source"))


#: Titles of the gates shown for a correction, in order; that of a splice stands in the third's place.
TITLES = (
    "Evidence available for the flagged claim", "Target span valid", "Structural span preserved", "Unflagged claims preserved (scope)", "No unauthorized citation added",
    "Ordinal citation-identity integrity", "Re-verification reaches ENTAILED", "No untouched sibling claim regresses", "Final decision",
)
SPLICE_TITLE = "Deterministic splice"
#: The row that a status blocks; a correction that ships blocks none, others without a row of their own the re-verification.
_BLOCKS = {
    "correction_span_invalid": 2, "correction_splice_unavailable": 3, "correction_structural_span_lost": 3, "correction_scope_violation": 4, "correction_unauthorized_addition": 5,
    "correction_ordinal_ambiguous": 6, "correction_sibling_regression": 8, "corrected": len(TITLES) + 1,
}
_BLOCKS_OTHERS = 7


def gate_rows(status_: Column) -> Column:
    """The gates as shown, ``array<struct<name, result>>``: PASS up to the one that blocks, which is the last; none without a correction."""
    blocks = F.lit(_BLOCKS_OTHERS)
    for name, at in _BLOCKS.items():
        blocks = F.when(status_ == name, F.lit(at)).otherwise(blocks)

    def row(i: int, title: str) -> Column:
        named = F.when(status_ == "correction_splice_unavailable", F.lit(SPLICE_TITLE)).otherwise(F.lit(title)) if i == 3 else F.lit(title)
        return F.struct(named.alias("name"), F.when(blocks == i, "BLOCK").otherwise("PASS").alias("result"))

    rows = F.array(*[row(i, t) for i, t in enumerate(TITLES, 1)])
    return F.when((status_ == "not_triggered") | status_.startswith("not_applicable"), F.slice(rows, 1, 0)).otherwise(F.slice(rows, F.lit(1), F.least(blocks, F.lit(len(TITLES)))))


#: Stages of the failure matrix and the stage at which a status fails.
STAGES = ("parser", "citation_mapping", "retrieval", "verification", "correction_targeting", "correction_generation", "splice", "safety_scope_citation_ordinal", "reverification", "safety_sibling_regression")
FAILS_AT = {
    "correction_span_invalid": "correction_targeting",
    "correction_splice_unavailable": "splice",
    "correction_structural_span_lost": "safety_scope_citation_ordinal",
    "correction_scope_violation": "safety_scope_citation_ordinal",
    "correction_unauthorized_addition": "safety_scope_citation_ordinal",
    "correction_ordinal_ambiguous": "safety_scope_citation_ordinal",
    "correction_failed": "reverification",
    "correction_sibling_regression": "safety_sibling_regression",
}


def first_failure_stage(status_: Column) -> Column:
    out = F.when(status_ == "not_triggered", "none (correctly not triggered)").when(status_ == "corrected", "none (shipped)")
    for s, stage in FAILS_AT.items():
        out = out.when(status_ == s, stage)
    return out.otherwise(F.concat(F.lit("UNRECOGNIZED_STATUS:"), status_))


def stage_matrix(corrections: DataFrame) -> DataFrame:
    """Corrections (status) with ok, fail or n/a by stage, shipped, and the first failing stage."""
    s = F.col("status")
    stage = first_failure_stage(s)
    early = ("parser", "citation_mapping", "retrieval", "verification")
    number = {name: i for i, name in enumerate(STAGES)}
    at = F.lit(len(STAGES))
    for name, i in number.items():
        at = F.when(stage == name, F.lit(i)).otherwise(at)
    unknown = ~s.isin(*FAILS_AT, "not_triggered", "corrected")
    cells = []
    for name, i in number.items():
        reached = F.when(at > i, "ok").when(at == i, "fail").otherwise("n/a")
        if name not in early:
            reached = F.when(s == "not_triggered", "n/a").when(unknown & F.lit(name == "safety_sibling_regression"), "n/a").otherwise(reached)
        cells.append(reached.alias(name))
    return corrections.select("*", *cells, F.when(s == "corrected", "yes").otherwise("no").alias("shipped"), stage.alias("first_failure_stage"))


def failure_cause(status_: Column, reverified: Column) -> Column:
    """Why a triggered correction didn't ship; null for statuses without a cause of their own."""
    named = ("correction_scope_violation", "correction_sibling_regression", "correction_ordinal_ambiguous", "correction_unauthorized_addition", "not_triggered")
    return (
        F.when((status_ == "correction_failed") & reverified.isNull(), "citation_identity_lost")
        .when((status_ == "correction_failed") & (reverified == S.NO_EVIDENCE), "evidence_lost_after_edit")
        .when(status_ == "correction_failed", "reverification_not_entailed")
        .when(status_.isin(*named), status_)
    )


def funnel(corrections: DataFrame, *by: str) -> DataFrame:
    s = F.col("status")
    return corrections.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s != "not_triggered").alias("n_triggered"), F.count_if(s == "corrected").alias("n_corrected"),
        F.count_if(F.startswith(s, F.lit("correction_"))).alias("n_blocked"), F.count_if(s == "correction_failed").alias("n_failed"),
    )
