"""Struct types of the engine's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

CITATION = StructType([StructField(c, StringType()) for c in ("provision_type", "provision_number", "subsection", "act_raw", "act_norm")])
EXTRACTED = ArrayType(
    StructType(
        [
            StructField("sentence_ord", IntegerType()),
            StructField("claim_text", StringType()),
            StructField("citation", CITATION),
            StructField("assertion_text", StringType()),
            StructField("assertion_spans", ArrayType(StringType())),
        ]
    )
)
CANONICAL = "dataset_citation_key string, act string, provision_type string, provision_number string, subsection string, canonical_text string, source_url string"
AUDIT = "dataset_citation_key string, audit_verdict string"
CASE = "document_id string, case_text string, raw_citation_keys array<string>"
EVENT = "run_id string, seq long, stage string, status string, data string"

USABLE = ("VERIFIED_EXACT", "VERIFIED_CONTENT")
ENTAILED, CONTRADICTED, NEI, NO_EVIDENCE = "ENTAILED", "CONTRADICTED", "NOT_ENOUGH_INFORMATION", "NO_EVIDENCE"
VERDICTS = (ENTAILED, CONTRADICTED, NEI, NO_EVIDENCE)
LABELS = (ENTAILED, CONTRADICTED, NEI)
#: Score keys in the order that breaks ties, with the verdict each stands for.
SCORE_LABELS = (("entailment", ENTAILED), ("neutral", NEI), ("contradiction", CONTRADICTED))
