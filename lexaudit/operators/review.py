"""Reviewer records: import checks, linkage to model claims, alignment audit, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.functions import text as T
from lexaudit.session import grown

# ---- fixed values: spreadsheet headers, labels and reference patterns
HEADERS = {
    "No.": "source_row_number",
    "Case reference": "case_reference",
    "Legal statement for review": "legal_statement",
    "Provision / legal reference mentioned": "legal_reference",
    "Is the legal statement correct? (Yes / No/ Partially)": "statement_correctness",
    "Is the legal reference correct?  (Yes / No/ Partially)": "reference_correctness",
    "Correction or clarification (if required)": "correction_or_clarification",
    "Legal authority supporting your assessment": "supporting_legal_authority",
}
LABELS = ("Yes", "No", "Partially")
_NUM = r"[0-9]+(?:-[A-Za-z0-9]+)?[A-Za-z]?(?:\([^)]+\))*"
PROVISION = rf"\b(section|sections|article|articles|rule|rules|regulation|regulations)\s+({_NUM}(?:\s*(?:,|and|&)\s*{_NUM})*)"
CROSS_REFERENCE = r"(?i)\b(?:as\s+)?(?:row|no\.?)\s*#?\s*(\d+)\b"
ACT_ALIASES = {"ipc": "indian penal code", "crpc": "code of criminal procedure", "pota": "prevention of terrorism act"}
# ---- end of fixed values


def label(raw: Column, field: str) -> Column:
    """A normal label; anything else fails the query when read."""
    plain = F.lower(F.trim(raw))
    out = F.when(plain.isNull() | (plain == ""), F.raise_error(F.lit(f"missing {field}")).cast("string"))
    for x in LABELS:
        out = out.when(plain == x.lower(), F.lit(x))
    return out.otherwise(F.raise_error(F.concat(F.lit(f"invalid {field}: "), raw)).cast("string"))


def import_rows(raw: DataFrame, row: str = "row_ord") -> DataFrame:
    """Typed annotations of a sheet's rows (``row`` counts from 0). Bad rows fail the query when read."""
    missing = [h for h in HEADERS if h not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    t = raw.select(row, *[F.nullif(F.trim(F.col(f"`{h}`").cast("string")), F.lit("")).alias(c) for h, c in HEADERS.items()])
    number = F.expr("try_cast(source_row_number AS double)")
    good = number.isNotNull() & (number > 0) & (number == F.floor(number))
    number = F.when(good, number.cast("long")).otherwise(F.raise_error(F.concat(F.lit("row number must be a positive integer in row "), (F.col(row) + 2).cast("string"))).cast("long"))

    def must(c: str) -> Column:
        return F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"missing {c} in row "), (F.col(row) + 2).cast("string"))).cast("string"))

    return t.select(
        F.concat(F.lit("LR-"), F.lpad(number.cast("string"), 4, "0")).alias("annotation_id"),
        number.alias("source_row_number"),
        (F.col(row) + 2).alias("source_excel_row"),
        *[must(c).alias(c) for c in ("case_reference", "legal_statement", "legal_reference")],
        *[label(F.col(c), c).alias(c) for c in ("statement_correctness", "reference_correctness")],
        "correction_or_clarification",
        "supporting_legal_authority",
    )


def check_unique(df: DataFrame, key: str) -> None:
    """Raise if a key is null or repeats; names up to ten."""
    bad = [r[0] for r in df.groupBy(key).count().filter(f"count > 1 or {key} is null").limit(10).collect()]
    if bad:
        raise ValueError(f"{key} must be unique and non-null: {bad}")


def joined_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key, each key once on each side; else raises with up to ten keys."""
    check_unique(a, key)
    check_unique(b, key)
    left, right = a.select(F.col(key).alias("_l")), b.select(F.col(key).alias("_r"))
    odd = left.join(right, F.col("_l") == F.col("_r"), "full_outer").filter("_l is null or _r is null")
    sample = [r[0] for r in odd.select(F.coalesce("_l", "_r")).limit(10).collect()]
    if sample:
        raise ValueError(f"{key} without a partner: {sample}")
    return a.join(b, key)


def duplicate_groups(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Groups of rows that agree in all keys (nulls agree), with their ids."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(ident)).alias("ids")).filter("n > 1")


def cross_references(df: DataFrame, ident: str = "annotation_id") -> DataFrame:
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("correction_or_clarification", "supporting_legal_authority")]))
    found = df.select(ident, fields.alias("f")).select(ident, "f.field", F.explode(F.regexp_extract_all(F.coalesce("f.text", F.lit("")), F.lit(CROSS_REFERENCE), 1)).alias("n"))
    return found.select(ident, "field", F.col("n").cast("long").alias("referenced_source_row_number"))


def provision_keys(reference: Column) -> Column:
    """Typed provisions a reference names: ``array<struct<kind, number>>``."""
    plain = T.normal_text(reference)
    kinds = F.regexp_extract_all(plain, F.lit(PROVISION), 1)
    lists = F.regexp_extract_all(plain, F.lit(PROVISION), 2)

    def typed(kind: Column, numbers: Column) -> Column:
        return F.transform(F.regexp_extract_all(numbers, F.lit(r"[0-9]+(?:-[a-z0-9]+)?[a-z]?(?:\([^)]+\))*"), 0), lambda n: F.struct(F.rtrim(kind, F.lit("s")).alias("kind"), T.normal_number(n).alias("number")))

    return F.array_distinct(F.flatten(F.zip_with(kinds, lists, typed)))


def reference_act(reference: Column) -> Column:
    """The act of a reference, without locators, parentheses and years; empty if it only points back."""
    t = F.regexp_replace(T.normal_text(reference), PROVISION, " ")
    t = F.regexp_replace(t, r"\b(?:sub[- ]?section|subsection|clause|paragraph)\s+[0-9]+[a-z]?(?:\([^)]+\))*", " ")
    for pattern in (r"^\s*the\b", r"\([^)]*\)", r"\b(?:18|19|20)\d{2}\b"):
        t = F.regexp_replace(t, pattern, " ")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    return F.when(t.isin("same act", "ibid"), F.lit("")).otherwise(t)


def act_match(reference: Column, candidate: Column) -> Column:
    """match, mismatch or unspecified; one name within the other is a match."""
    plain = T.normal_text(candidate)

    def core(c: Column) -> Column:
        for short, full in ACT_ALIASES.items():
            c = F.regexp_replace(c, rf"\b{short}\b", full)
        c = F.regexp_replace(F.regexp_replace(F.trim(c), r"^the\s+", ""), r"^part\s+[ivxlcdm]+\s+of\s+", "")
        return F.array_join(F.filter(F.split(T.squeezed(c), " "), lambda w: ~F.regexp_like(w, F.lit(r"^(?:18|19|20)\d{2}$"))), " ")

    a, b = core(reference), core(plain)
    blank = (reference == "") | (plain == "") | plain.isin("same act", "ibid")
    return F.when(blank, "unspecified").when(F.contains(a, b) | F.contains(b, a), "match").otherwise("mismatch")


def merge_variants(claims: DataFrame) -> DataFrame:
    """Model claims of several files as one: files together, conflicting verdicts and methods VARIANT,
    evidence from the first file that has any. Nulls are a value of their own in conflicts.

    Claims that repeat are dropped first, so that a text is not made normal once a claim."""
    named = ("document_id", "claim_id", "claim_text", "assertion_text", "provision_type", "provision_number", "act_raw", "act_norm", "verifier_model", "verdict", "evidence_match_method", "evidence_id", "evidence_text", "source_file", "source_ord")
    claims = claims.select(*named).distinct()
    key = [
        F.col("document_id"),
        F.col("claim_id"),
        T.normal_text(F.col("claim_text")).alias("k_claim"),
        T.normal_text(F.col("assertion_text")).alias("k_assertion"),
        T.normal_text(F.col("provision_type")).alias("k_type"),
        T.normal_number(F.col("provision_number")).alias("k_number"),
        T.normal_text(F.col("act_raw")).alias("k_act"),
        T.normal_text(F.col("verifier_model")).alias("k_model"),
    ]

    def agreed(c: str) -> Column:
        values = F.collect_set(F.coalesce(F.col(c), F.lit("\0")))
        return F.when(F.size(values) > 1, F.lit("VARIANT")).otherwise(F.nullif(F.get(values, F.lit(0)), F.lit("\0"))).alias(c)

    def first_of(c: str) -> Column:
        return F.min(F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.struct("source_ord", c)))[c].alias(c)

    plain = ("claim_text", "assertion_text", "provision_type", "provision_number", "act_raw", "act_norm", "verifier_model")
    return claims.groupBy(*key).agg(
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
        agreed("verdict"),
        agreed("evidence_match_method"),
        first_of("evidence_id"),
        first_of("evidence_text"),
        *[F.min(F.struct("source_ord", c))[c].alias(c) for c in plain],
    )


def align(annotations: DataFrame, claims: DataFrame) -> DataFrame:
    """One row an annotation: statement matches, aligned and type-mismatched references, the reason if none.

    Statements meet through their normal text as a join key (claim or assertion text), so no case
    is compared with all its claims. Each distinct case, statement and reference meets them once, whatever
    the number of annotations that have them; these are joined to the answers."""
    merged = merge_variants(claims)
    own = ["case_reference", "legal_statement", "legal_reference"]
    asked = annotations.select(*own).distinct()
    texts = F.array_distinct(F.array("k_claim", "k_assertion"))
    by_text = merged.withColumn("_t", F.explode(texts)).withColumnRenamed("document_id", "_doc")
    a = asked.withColumn("_s", T.normal_text(F.col("legal_statement"))).withColumn("_ref", T.normal_text(F.col("legal_reference")))
    a = a.withColumn("_keys", provision_keys(F.col("legal_reference"))).withColumn("_act", reference_act(F.col("legal_reference")))
    counts = claims.groupBy(F.col("document_id").alias("_case")).agg(F.count(F.lit(1)).alias("n_case_claims"))
    joined = a.join(by_text, (F.col("case_reference") == F.col("_doc")) & (F.col("_s") == F.col("_t")) & (F.col("_s") != ""), "left")
    kind = F.rtrim(F.col("k_type"), F.lit("s"))
    listed = F.exists("_keys", lambda k: (k["kind"] == kind) & (k["number"] == F.col("k_number")))
    full = T.normal_text(F.concat_ws(" ", F.coalesce("provision_type", F.lit("")), F.coalesce("provision_number", F.lit("")), F.coalesce("act_raw", F.lit(""))))
    by_reference = (F.col("_ref") != "") & ((F.col("_ref") == F.col("k_act")) | (F.col("_ref") == T.normal_text(F.col("evidence_id"))) | (F.col("_ref") == full))
    act = act_match(F.col("_act"), F.coalesce(F.nullif(F.col("act_norm"), F.lit("")), F.col("act_raw")))
    found = F.col("_doc").isNotNull()
    hit = F.when(F.size("_keys") > 0, listed).otherwise(by_reference)
    other = (F.size("_keys") > 0) & F.exists("_keys", lambda k: (k["number"] == F.col("k_number")) & (k["kind"] != kind)) & ~listed & (act == "match")
    ident = F.struct("_doc", "claim_id", "provision_type", "k_number", T.normal_text(F.col("act_norm")).alias("a"))
    rows = joined.withColumn("_hit", found & hit & (act != "mismatch")).withColumn("_any", found & (listed | by_reference)).withColumn("_other", found & other).withColumn("_id", ident)
    out = rows.groupBy(*own).agg(
        F.count_if(found).alias("num_distinct_statement_matches"),
        F.count_distinct(F.when(F.col("_hit"), F.col("_id"))).alias("num_reference_aligned_matches"),
        F.count_distinct(F.when(F.col("_other"), F.col("_id"))).alias("num_typed_provision_mismatch_matches"),
        F.bool_or("_any").alias("_any"),
        F.sort_array(F.collect_list(F.when(found, F.struct("claim_id", "verdict", "evidence_match_method", "source_files")))).alias("matched_model_claims"),
    )
    out = out.join(counts, F.col("case_reference") == F.col("_case"), "left").drop("_case")
    unmatched = (F.col("num_reference_aligned_matches") == 0) & (F.col("num_typed_provision_mismatch_matches") == 0)
    reason = F.when(unmatched & (F.col("num_distinct_statement_matches") == 0), "no_exact_statement_match").when(unmatched & ~F.col("_any"), "no_provision_identifier_or_reference_text_match").when(
        unmatched, "act_name_incompatible_or_unresolved"
    )
    out = out.withColumn("unmatched_reason", reason).withColumn("case_found", F.col("n_case_claims").isNotNull()).drop("_any")
    same = F.lit(True)
    for c in own:
        out, same = out.withColumnRenamed(c, f"_{c}"), same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return annotations.join(grown(out), same).drop(*(f"_{c}" for c in own))


def alignment_coverage(aligned: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return aligned.agg(
        n.alias("n_rows"),
        F.count_if("case_found").alias("rows_with_case_found"),
        F.count_if(F.col("num_distinct_statement_matches") > 0).alias("rows_with_exact_statement_match"),
        F.count_if(F.col("num_reference_aligned_matches") > 0).alias("rows_with_reference_match"),
        F.count_if(F.col("num_reference_aligned_matches") == 1).alias("rows_with_unique_alignment"),
        F.count_if(F.col("num_reference_aligned_matches") > 1).alias("rows_with_ambiguous_alignment"),
        F.count_if(F.col("num_typed_provision_mismatch_matches") > 0).alias("rows_with_typed_mismatch"),
        F.coalesce(F.try_divide(F.count_if(F.col("num_distinct_statement_matches") > 0).cast("double"), n), F.lit(0.0)).alias("statement_match_rate"),
    )


def feature_exclusion(audited: Column, statement_match: Column, aligned: Column, candidates: Column) -> Column:
    """Why a row has no features; null if it has."""
    return F.when(~audited, "missing_audit").when(~statement_match, "no_exact_statement_match").when(aligned != 1, "alignment_not_unique").when(candidates != 1, "candidates_not_unique")
