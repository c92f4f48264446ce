"""Stage events of runs: payload rules, the grammar of lines, and the protocol over a table.

A run is an ordered sequence of {stage, status, data} events. It ends with ``run/complete`` or with
an error; nothing may follow, and an end must come. ``machine`` has the protocol over a stream, ``sink`` the
lines as they are served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STAGES = ("claims", "evidence", "verification", "correction", "safety", "recheck", "run", "error")
STATUSES = ("started", "complete", "skipped", "failed")
MAX_BYTES, MAX_CHARS, MAX_ID = 1 << 20, 100_000, 128


def is_terminal(stage: Column, status: Column) -> Column:
    return (stage == "error") | ((stage == "run") & (status == "complete"))


def wire_status(status: Column) -> Column:
    """Callbacks say completed where the wire says complete."""
    return F.when(status == "completed", "complete").otherwise(status)


def parse_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds stage, status, data and ``valid`` to NDJSON lines: valid JSON with string stage and status."""
    kinds = F.from_json(F.col(line), "stage variant, status variant, data variant")
    typed = lines.withColumn("_e", kinds)

    def text(c: str) -> Column:
        v = F.col(f"_e.{c}")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    return typed.select(*lines.columns, text("stage").alias("stage"), text("status").alias("status"), F.to_json(F.struct(F.col("_e.data").alias("data"))).alias("data")).withColumn(
        "valid", F.col("stage").isNotNull() & F.col("status").isNotNull()
    )


def run_states(events: DataFrame) -> DataFrame:
    """One row a run (run_id, seq, stage, status, optional valid): state and first offending event.

    States: complete, failed, open, protocol_error."""
    ok = F.coalesce("valid", F.lit(True)) if "valid" in events.columns else F.lit(True)
    w = W.partitionBy("run_id").orderBy("seq")
    end = is_terminal(F.col("stage"), F.col("status"))
    e = events.withColumn("_end", F.coalesce(end, F.lit(False))).withColumn("_ok", ok)
    e = e.withColumn("_ended", F.coalesce(F.max(F.col("_end").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0)
    bad = ~F.col("_ok") | F.col("_ended")
    return e.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(F.when(bad, F.col("seq"))).alias("first_bad_seq"),
        F.min(F.when(F.col("_end"), F.col("seq"))).alias("end_seq"),
        F.max(F.when(F.col("_end") & (F.col("stage") == "error"), F.lit(1)).otherwise(F.lit(0))).alias("_err"),
    ).select(
        "run_id",
        "n_events",
        F.when(F.col("first_bad_seq").isNotNull(), "protocol_error").when(F.col("end_seq").isNull(), "open").when(F.col("_err") == 1, "failed").otherwise("complete").alias("state"),
        "first_bad_seq",
    )


def payload_problem(body: Column, allowed: tuple[str, ...] = ("document_id", "case_text")) -> Column:
    """Why a request body is refused; null if it isn't: size, JSON object, exact keys, each key once, lengths."""
    keys = F.array_sort(F.json_object_keys(body))
    got = F.from_json(body, "document_id string, case_text string")
    return (
        F.when(body.isNull() | (F.octet_length(body) > MAX_BYTES), "body too large or missing")
        .when(keys.isNull(), "not a JSON object")
        .when(F.size(keys) > F.size(F.array_distinct(keys)), "repeated key")
        .when(F.try_parse_json(body).isNull(), "not a JSON object")
        .when(keys != F.array(*[F.lit(k) for k in sorted(allowed)]), "keys differ")
        .when(F.length(got["case_text"]) > MAX_CHARS, "text too long")
        .when(F.length(got["document_id"]) > MAX_ID, "id too long")
    )


def correction_events(status: Column) -> Column:
    """The sub-events of a correction in their fixed order: ``array<struct<stage, status>>``.

    Without a target all three stages are skipped. Else the structural gates answer first, the re-check runs
    where they pass, and the safety stage ends with the decision after it."""

    def e(*pairs: tuple[str, str]) -> Column:
        return F.array(*(F.struct(F.lit(stage).alias("stage"), F.lit(s).alias("status")) for stage, s in pairs))

    rechecked = F.when(status.isin("corrected", "correction_failed", "correction_sibling_regression"), e(("recheck", "started"), ("recheck", "complete"))).otherwise(e(("recheck", "skipped")))
    made = F.concat(e(("correction", "started"), ("correction", "complete"), ("safety", "started"), ("safety", "complete")), rechecked, e(("safety", "complete")))
    return F.when(status.isin("not_triggered", "correction_span_invalid"), e(("correction", "skipped"), ("safety", "skipped"), ("recheck", "skipped"))).otherwise(made)
