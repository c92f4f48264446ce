"""Claims of texts: Arrow-batched extraction, then relational numbering and act inheritance."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaudit import schemas
from lexaudit.functions import grammar


@functools.lru_cache(maxsize=4096)
def _of_sentence(sentence: str) -> list[dict]:
    """A sentence's claims as rows; a worker keeps those of some thousand sentences, as citations are repeated word for word."""
    return [
        {
            "claim_text": c.sentence,
            "citation": {
                "provision_type": c.citation.provision_type,
                "provision_number": c.citation.provision_number,
                "subsection": c.citation.subsection,
                "act_raw": c.citation.act_raw,
                "act_norm": c.citation.act_norm,
            },
            "assertion_text": c.assertion,
            "assertion_spans": c.spans,
        }
        for c in grammar.sentence_claims(sentence)
    ]


@F.pandas_udf(schemas.EXTRACTED)
def _claims(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda text: [{"sentence_ord": i, **c} for i, s in enumerate(grammar.sentences(text or "")) for c in _of_sentence(s)])


def claims_of(text: Column) -> Column:
    """Claims of a text as an array, acts not yet inherited."""
    return _claims(text)


def inherit_acts(claims: DataFrame, doc: str = "document_id") -> DataFrame:
    """Resolve acts left open, from the acts a document names anywhere.

    First the one act that the same provision has elsewhere, else the document's one act. Both
    look at the claims as extracted. One window set per document; no join. The document's windows come first, as claims
    that are dealt out by document lie right for those of its provisions too: they are shuffled once."""
    norm = F.col("citation.act_norm")
    named = F.when(norm != "", F.struct(F.col("claim_ord"), F.col("citation.act_raw").alias("raw"), norm.alias("norm")))
    same = W.partitionBy(doc, "citation.provision_type", "citation.provision_number")
    whole = W.partitionBy(doc)
    kinds = F.when(norm != "", norm)
    out = claims.withColumns({"_all_n": F.size(F.collect_set(kinds).over(whole)), "_all": F.min(named).over(whole)})
    out = out.withColumns({"_same_n": F.size(F.collect_set(kinds).over(same)), "_same": F.min(named).over(same)})
    pick = F.when(norm != "", F.lit(None)).when(F.col("_same_n") == 1, F.col("_same")).when(F.col("_all_n") == 1, F.col("_all"))
    out = out.withColumn("_pick", pick)
    citation = F.struct(
        F.col("citation.provision_type"),
        F.col("citation.provision_number"),
        F.col("citation.subsection"),
        F.coalesce(F.col("_pick.raw"), F.col("citation.act_raw")).alias("act_raw"),
        F.coalesce(F.col("_pick.norm"), norm).alias("act_norm"),
    )
    return out.withColumn("citation", citation).drop("_same_n", "_same", "_all_n", "_all", "_pick")


def parsed_claims(fields: DataFrame, doc: str = "document_id", text: str = "text", distinct_texts: bool = False) -> DataFrame:
    """Claims as ``extract_claims`` gives them, acts not yet inherited."""
    if distinct_texts:
        parsed = fields.select(F.col(text).alias("_t")).distinct().withColumn("_claims", claims_of(F.col("_t")))
        rows = fields.select(doc, text).join(parsed, F.col(text).eqNullSafe(F.col("_t"))).select(doc, "_claims")
    else:
        rows = fields.select(doc, claims_of(F.col(text)).alias("_claims"))
    flat = rows.select(doc, F.posexplode("_claims").alias("_at", "c"))
    return flat.select(
        doc,
        F.concat(F.lit("c"), (F.col("_at") + 1).cast("string")).alias("claim_id"),
        (F.col("_at") + 1).alias("claim_ord"),
        "c.sentence_ord",
        "c.claim_text",
        "c.citation",
        "c.assertion_text",
        "c.assertion_spans",
    )


def extract_claims(fields: DataFrame, doc: str = "document_id", text: str = "text", distinct_texts: bool = False) -> DataFrame:
    """A row per claim: doc, claim_id, claim_ord, sentence_ord, claim_text, citation, assertion_text, assertion_spans.

    Sentences without citations give none. With ``distinct_texts`` equal texts are parsed once."""
    return inherit_acts(parsed_claims(fields, doc, text, distinct_texts), doc)


def claims_by_sentence(claims: DataFrame, doc: str = "document_id") -> DataFrame:
    """Claims grouped by sentence, sentences by their first claim."""
    return (
        claims.groupBy(doc, "claim_text")
        .agg(F.min("claim_ord").alias("first_ord"), F.sort_array(F.collect_list(F.struct("claim_ord", "claim_id"))).alias("claims"))
        .select(doc, "claim_text", "first_ord", F.transform("claims", lambda c: c["claim_id"]).alias("claim_ids"))
    )


def identity(citation: str = "citation") -> Column:
    """What a claim is about: type, number and act, without the subsection."""
    return F.struct(F.col(f"{citation}.provision_type"), F.col(f"{citation}.provision_number"), F.col(f"{citation}.act_norm"))


def identity_ordinal(claims: DataFrame, doc: str = "document_id") -> DataFrame:
    """Adds ``identity`` and ``ordinal``, a claim's rank among its document's claims of one identity."""
    kept = claims.withColumn("identity", identity())
    return kept.withColumn("ordinal", F.row_number().over(W.partitionBy(doc, "identity").orderBy("claim_ord")))
