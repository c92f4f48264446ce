"""Comparisons and records built from the other operators' outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.functions import stats
from lexaudit.functions import text as T
from lexaudit.operators.quantiles import grouped_with_quantiles
from lexaudit.session import cut


def nei_breakdown(claims: DataFrame) -> DataFrame:
    """Claims without enough information by match method and reason, with their confidence."""
    return claims.filter(F.col("verdict") == S.NEI).groupBy("match_method", "sub_reason").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("min"), F.max("confidence").alias("max")
    )


def corpus_composition(audit: DataFrame, usable: DataFrame) -> DataFrame:
    """One row: audited records by verdict (a map), usable records and acts, and whether they reconcile."""
    verdicts = audit.groupBy("audit_verdict").count()
    counts = verdicts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("audit_verdict", "count")))).alias("by_verdict"), F.sum("count").alias("n_audited"))
    pool = usable.agg(F.count(F.lit(1)).alias("n_usable"), F.count_distinct("act_norm").alias("n_acts"))
    want = verdicts.filter(F.col("audit_verdict").isin(*S.USABLE)).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_should"))
    return counts.join(pool).join(want).withColumn("reconciles", F.col("n_should") == F.col("n_usable")).drop("n_should")


def key_versions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys by version: kept, added, removed."""
    a, b = old.select(F.col(key).alias("_a")).distinct(), new.select(F.col(key).alias("_b")).distinct()
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def batch_table(claims: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch: claims, coverage, verdicts, confidence and correction statuses."""
    has = F.col("match_method") != "no_evidence"
    found = [
        F.count(F.lit(1)).alias("n_claims"),
        F.count_if(has).alias("n_with_evidence"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in S.VERDICTS],
        F.avg("confidence").alias("mean_confidence"),
    ]
    return grouped_with_quantiles(claims, [batch], "confidence", {"median_confidence": 0.5}, *found)


def zipped_arms(a: DataFrame, b: DataFrame, doc: str = "document_id") -> DataFrame:
    """Claims of two arms side by side by position in their document; texts must agree, else the query fails when read."""
    left = a.select(F.col(doc).alias("_d"), F.col("claim_ord").alias("_o"), F.col("claim_text").alias("_t"), F.struct("match_method", "verdict").alias("first"))
    right = b.select(F.col(doc), "claim_ord", "claim_text", F.struct("match_method", "verdict").alias("second"))
    both = right.join(left, (F.col(doc) == F.col("_d")) & (F.col("claim_ord") == F.col("_o")), "full_outer")
    ok = F.col("claim_text").eqNullSafe(F.col("_t"))
    checked = F.when(ok, F.col("claim_text")).otherwise(F.raise_error(F.concat(F.lit("arms differ in document "), F.coalesce(doc, "_d").cast("string"))).cast("string"))
    return both.select(doc, "claim_ord", checked.alias("claim_text"), "first", "second")


def evidence_change(first: Column, second: Column) -> Column:
    had, has = first != "no_evidence", second != "no_evidence"
    return F.when(~had & has, "evidence_gained").when(had & ~has, "evidence_lost").otherwise("evidence_unchanged")


def change_matrix(zipped: DataFrame) -> DataFrame:
    """Claims by change of evidence and of verdict."""
    v = F.when(F.col("first.verdict").eqNullSafe(F.col("second.verdict")), F.lit("verdict_unchanged")).otherwise(
        F.concat(F.lit("changed_"), F.lower("first.verdict"), F.lit("_to_"), F.lower("second.verdict"))
    )
    return zipped.groupBy(evidence_change(F.col("first.match_method"), F.col("second.match_method")).alias("evidence_change"), v.alias("verdict_change")).agg(F.count(F.lit(1)).alias("n"))


def parser_comparison(old: DataFrame, new: DataFrame, doc: str = "document_id") -> DataFrame:
    """One row: documents with more, fewer and as many claims under a new parser, and the sign test's p."""
    a, b = (x.groupBy(F.col(doc).alias(d)).agg(F.count(F.lit(1)).alias(n)) for x, d, n in ((old, "_a", "x"), (new, "_b", "y")))
    delta = F.coalesce("y", F.lit(0)) - F.coalesce("x", F.lit(0))
    counts = a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(delta.alias("d")).agg(
        F.count_if(F.col("d") > 0).alias("n_more"), F.count_if(F.col("d") < 0).alias("n_fewer"), F.count_if(F.col("d") == 0).alias("n_same"), F.sum("d").alias("net")
    )
    return counts.withColumn("p_sign", stats.sign_test(F.col("n_more"), F.col("n_fewer")))


def scope_replay(violations: DataFrame) -> DataFrame:
    """Recorded scope violations (claim_text, assertion_text, assertion_spans, corrected_text) at each strictness:
    how many siblings each blocks, and how many only the whole sentence blocks."""
    kept = lambda fragments: F.forall(fragments, lambda f: T.fragment_present(f, F.col("corrected_text")))
    whole, part, spans = (~kept(x) for x in (F.array("claim_text"), F.array(F.coalesce("assertion_text", "claim_text")), F.coalesce("assertion_spans", F.array("claim_text"))))
    return violations.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("n_by_sentence"), F.count_if(part).alias("n_by_assertion"), F.count_if(spans).alias("n_by_spans"), F.count_if(whole & ~spans).alias("n_unblocked")
    )


def preservation(claims: DataFrame) -> DataFrame:
    """Claims whose sentence, and all of whose spans, stand in the corrected text as plain substrings."""
    return claims.agg(
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if(F.contains("corrected_text", F.col("claim_text"))).alias("n_sentence_kept"),
        F.count_if(F.forall("assertion_spans", lambda s: F.contains(F.col("corrected_text"), s))).alias("n_spans_kept"),
    )


def factorial_cells(claims: DataFrame, item: str = "item_id") -> DataFrame:
    """Detection in each cell of framing by narrowing. An item's claim is its first with the planted number,
    else its first; one without evidence counts as not detected. Recall with Wilson's interval."""
    w = W.partitionBy(item, "framing", "narrow").orderBy((F.col("citation.provision_number") == F.col("planted_number")).desc(), "claim_ord")
    target = claims.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    cells = target.groupBy("framing", "narrow").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == S.CONTRADICTED).alias("n_detected"), F.count_if((F.col("verdict") == S.CONTRADICTED) & (F.col("match_method") != "no_evidence")).alias("n_detected_matched"))
    interval = stats.wilson(F.col("n_detected"), F.col("n"))
    return cells.select("*", F.try_divide(F.col("n_detected").cast("double"), F.col("n")).alias("recall"), interval["low"].alias("low"), interval["high"].alias("high"))


def correction_pairs(a: DataFrame, b: DataFrame, doc: str = "document_id") -> DataFrame:
    """Corrections of two conditions on the documents both have: statuses and whether they flagged the same claim."""
    x = a.select(doc, F.col("status").alias("first_status"), F.col("triggered_for_claim_id").alias("_x"))
    y = b.select(doc, F.col("status").alias("second_status"), F.col("triggered_for_claim_id").alias("_y"))
    return x.join(y, doc).select(doc, "first_status", "second_status", F.col("_x").eqNullSafe(F.col("_y")).alias("same_claim"))


def ranked_counts(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Values by frequency; ties in the order of first sight.

    Values are sorted over all tasks; a value's rank is its place in its task behind those of the tasks before. Jobs run while this is planned."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    ordered = cut(counts.orderBy(F.col("n").desc(), "first_seen", column).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(ordered.groupBy(part.alias("p")).count().collect())  # one a task
    before, total = [], 0
    for r in sizes:
        before.append((r["p"], total))
        total += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_p long, _before long"))
    placed = ordered.join(starts, part == F.col("_p"))
    return placed.withColumn("rank", (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("_at", "_p", "_before")


def case_records(fields: DataFrame, claims: DataFrame, corrections: DataFrame, doc: str = "document_id") -> DataFrame:
    """One nested record a document: its text, claims in order, evidence and verdict counts, correction and final field."""
    has = F.col("match_method") != "no_evidence"
    listed = claims.groupBy(doc).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("claim_ord", F.struct("claim_id", "claim_text", "citation", "assertion_text", "assertion_spans", "match_method", "verdict", "confidence").alias("c")))), lambda x: x["c"]).alias("claims"),
        F.struct(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("with_evidence"), F.count_if(~has).alias("without_evidence")).alias("evidence"),
        F.struct(*[F.count_if(F.col("verdict") == v).alias(v) for v in S.VERDICTS]).alias("verification"),
    )
    fixed = corrections.select(doc, F.struct(*[c for c in corrections.columns if c not in (doc, "final_field")]).alias("correction"), "final_field")
    return fields.join(listed, doc, "left").join(fixed, doc, "left")


def role_prompts(texts: DataFrame, instruction: str, tokens: int = 1000, text: str = "Text") -> DataFrame:
    """Prompts of a text classifier: an instruction and the text's last tokens."""
    return texts.withColumn("prompt", F.concat(F.lit(instruction), F.lit("\n\n"), T.last_tokens(F.col(text), tokens)))
