"""Evidence: usable records, their overlay, and linkage of citations to them.

Records, citations and claims all grow with the input, so joins among them are sorted and merged. A provision may
have any number of records: they are dealt to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaudit import schemas
from lexaudit.functions import text as T
from lexaudit.session import cut, grown

FUZZY_LEAST = 0.8
#: Records of a provision in one row, about.
BLOCK = 1_000


def usable_evidence(canonical: DataFrame, audit: DataFrame, verdicts: tuple[str, ...] = schemas.USABLE, ordinal: str = "line_ord") -> DataFrame:
    """Audited records with a usable verdict. A repeated key keeps its last row and its first place."""
    key = "dataset_citation_key"
    audited = audit.select(F.col(key).alias("_k"), "audit_verdict").filter(F.col("audit_verdict").isin(*verdicts)).dropDuplicates(["_k"])
    joined = canonical.join(grown(audited), F.col(key) == F.col("_k")).drop("_k")
    w = W.partitionBy(key)
    ranked = joined.withColumn("pool_ord", F.min(ordinal).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col(ordinal).desc())))
    return ranked.filter("_r = 1").drop("_r").withColumn("act_norm", T.normal_act(F.col("act")))


def overlay(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Usable records with those of ``extra`` in place of the same keys; new keys go last."""
    key = "dataset_citation_key"
    both = base.withColumn("_src", F.lit(0)).unionByName(extra.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(key)
    place = F.min(F.struct("_src", "pool_ord")).over(w)
    top = both.withColumn("_place", place).withColumn("_r", F.row_number().over(w.orderBy(F.col("_src").desc(), F.col("pool_ord").desc())))
    ordered = top.filter("_r = 1")
    shift = ordered.groupBy().agg(F.coalesce(F.max(F.when(F.col("_place._src") == 0, F.col("_place.pool_ord"))), F.lit(0)).alias("_shift"))
    placed = ordered.join(shift).withColumn("pool_ord", F.col("_place.pool_ord") + F.when(F.col("_place._src") == 1, F.col("_shift") + 1).otherwise(F.lit(0)))
    return placed.drop("_src", "_place", "_r", "_shift")


def _pool(evidence: DataFrame) -> DataFrame:
    return evidence.select(
        F.col("provision_type").alias("e_type"),
        F.col("provision_number").alias("e_number"),
        F.col("subsection").alias("e_sub"),
        F.col("act_norm").alias("e_act"),
        F.struct("dataset_citation_key", "act", "provision_type", "provision_number", "subsection", "canonical_text", "pool_ord").alias("e"),
    )


def _blocks(evidence: DataFrame) -> DataFrame:
    """The records of each provision in blocks of about ``BLOCK``: e_type, e_number and ``found``, with words and years taken once a record."""
    rows = _pool(evidence).select(
        "e_type", "e_number", F.struct("e_act", T.significant_words(F.col("e_act")).alias("words"), T.years(F.col("e_act")).alias("years"), F.col("e.pool_ord").alias("ord"), "e").alias("r")
    )
    count = rows.groupBy(F.col("e_type").alias("_t"), F.col("e_number").alias("_n")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    dealt = rows.join(grown(count), F.col("e_type").eqNullSafe(F.col("_t")) & F.col("e_number").eqNullSafe(F.col("_n"))).withColumn("_block", F.pmod(F.xxhash64("r.e_act", "r.ord"), F.col("_blocks")))
    return dealt.groupBy("e_type", "e_number", "_block").agg(F.collect_list("r").alias("found")).drop("_block")


def _exact(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds ``_exact``: the last record of the same provision, act and subsection, or else of the provision without one."""
    pool = _pool(evidence).groupBy("e_type", "e_number", "e_act", "e_sub").agg(F.max(F.struct(F.col("e.pool_ord").alias("ord"), "e")).alias("_last"))
    names = lambda p, rows: rows.select(*[F.col(c).alias(f"_{p}{c}") for c in ("e_type", "e_number", "e_act", "e_sub")], F.col("_last.e").alias(f"_{p}"))
    same = lambda p: (F.col("c_type") == F.col(f"_{p}e_type")) & (F.col("c_number") == F.col(f"_{p}e_number")) & (F.col("c_act") == F.col(f"_{p}e_act")) & (F.col("c_act") != "")
    one = cited.join(grown(names("own", pool)), same("own") & F.col("c_sub").eqNullSafe(F.col("_owne_sub")), "left")
    both = one.join(grown(names("loose", pool.filter("e_sub is null"))), same("loose"), "left")
    return both.select("c_type", "c_number", "c_sub", "c_act", F.coalesce("_own", "_loose").alias("_exact"))


def match_evidence(claims: DataFrame, evidence: DataFrame, threshold: float = FUZZY_LEAST, scores: DataFrame | None = None) -> DataFrame:
    """Adds ``evidence``, ``match_method``, ``fuzzy_score`` and ``name_overlap`` to claims (with ``citation``).

    In order: the exact provision with its subsection (null equals null); if it has one, the
    provision without; else the most similar act of the same provision, unless both name years
    and share none; ties go to the first of the pool. ``scores`` (query, doc, similarity) replaces the
    word overlap of act names; pairs that it doesn't have count 0. ``name_overlap`` is the greatest word
    overlap whatever the years, of claims that have no exact record; null without a record of the provision.

    Each distinct citation is resolved once, by lookups and, without an exact record, against the blocks of its
    provision, and the answers are cut off while the result is planned; claims are joined to them. Nothing here is computed once a claim."""
    own = [c for c in claims.columns if c not in ("evidence", "match_method", "fuzzy_score", "name_overlap")]
    fields = {"c_type": "provision_type", "c_number": "provision_number", "c_sub": "subsection", "c_act": "act_norm"}
    cited = claims.select(*[F.col(f"citation.{v}").alias(k) for k, v in fields.items()]).distinct()
    r = cut(_resolved(cited, cut(evidence), threshold, scores))  # else filters on the answers run the lambdas again
    same = F.lit(True)
    for k, v in fields.items():
        same &= F.col(f"citation.{v}").eqNullSafe(F.col(k))
    return claims.select(*own).join(grown(r), same, "left").drop(*fields)


def _resolved(cited: DataFrame, evidence: DataFrame, threshold: float, scores: DataFrame | None) -> DataFrame:
    """Distinct citations (c_type, c_number, c_sub, c_act) with what ``match_evidence`` adds.

    Exact records are looked up by equality. Of citations without one, each provision and act meets the blocks of
    its provision once, whatever the subsections; each block passes on its best record, so that no row or task
    holds all records of a provision. Given ``scores`` are joined to pairs of act names, one at a time."""
    key, name = ["c_type", "c_number", "c_sub", "c_act"], ["c_type", "c_number", "c_act"]
    known = cut(_exact(cited, evidence))
    left = known.filter("_exact is null").select(*key)
    c = left.select(*name).distinct().join(grown(_blocks(evidence)), (F.col("c_type") == F.col("e_type")) & (F.col("c_number") == F.col("e_number")), "left")
    c = c.withColumn("_words", T.significant_words(F.col("c_act"))).withColumn("_years", T.years(F.col("c_act")))

    def held(r: Column) -> Column:
        return F.struct(T.token_overlap(F.col("_words"), r["words"]).alias("overlap"), T.years_conflict(F.col("_years"), r["years"]).alias("apart"), (-r["ord"]).alias("early"), r["e"].alias("e"))

    def ranked(s: Column, score: Column) -> Column:
        return F.struct(score.alias("score"), s["early"].alias("early"), s["e"].alias("e"))

    if scores is None:
        c = c.select(*name, F.transform("found", held).alias("_scored"))
        best = F.array_max(F.transform(F.filter("_scored", lambda s: ~s["apart"]), lambda s: ranked(s, s["overlap"])))
        most = c.select(*name, best.alias("_best"), F.array_max(F.transform("_scored", lambda s: s["overlap"])).alias("_overlap"))
    else:
        pairs = c.withColumn("r", F.explode_outer("found")).select(*name, F.when(F.col("r").isNotNull(), held(F.col("r"))).alias("s"), F.col("r.e_act").alias("_doc"))
        given = scores.select(F.col("query").alias("_query"), F.col("doc").alias("_of"), F.col("similarity").cast("double").alias("_given"))
        pairs = pairs.join(grown(given), (F.col("c_act") == F.col("_query")) & (F.col("_doc") == F.col("_of")), "left")
        best = F.when(~F.col("s.apart"), ranked(F.col("s"), F.coalesce("_given", F.lit(0.0))))
        most = pairs.select(*name, best.alias("_best"), F.col("s.overlap").alias("_overlap"))
    met = most.groupBy(*[F.col(k).alias(f"_{k}") for k in name]).agg(F.max("_best").alias("_best"), F.max("_overlap").alias("name_overlap"))
    same = F.lit(True)
    for k in name:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    hit = F.col("_best.score") >= threshold
    method = F.when(hit, F.lit("fuzzy")).otherwise(F.lit("no_evidence"))
    others = left.join(grown(met), same).select(*key, F.col("_best.score").alias("fuzzy_score"), method.alias("match_method"), F.when(hit, F.col("_best.e")).alias("evidence"), "name_overlap")
    exact = known.filter("_exact is not null").select(*key, F.lit(None).cast("double").alias("fuzzy_score"), F.lit("exact_normalized").alias("match_method"), F.col("_exact").alias("evidence"), F.lit(None).cast("double").alias("name_overlap"))
    return exact.unionByName(others)


def no_evidence_taxonomy(claims: DataFrame, evidence: DataFrame, low: float = 0.5, high: float = FUZZY_LEAST) -> DataFrame:
    """Adds ``no_evidence_category`` to unmatched claims (null to others); years veto nothing here.

    Claims that ``match_evidence`` has been through bring their ``name_overlap``."""
    if "name_overlap" not in claims.columns:
        key = {"_type": "provision_type", "_number": "provision_number", "_act": "act_norm"}
        cited = claims.select(*[F.col(f"citation.{v}").alias(k) for k, v in key.items()]).distinct()
        met = cited.join(grown(_blocks(evidence)), (F.col("_type") == F.col("e_type")) & (F.col("_number") == F.col("e_number")))
        words = T.significant_words(F.col("_act"))
        each = met.select(*key, F.array_max(F.transform("found", lambda r: T.token_overlap(words, r["words"]))).alias("_o")).groupBy(*key).agg(F.max("_o").alias("name_overlap"))
        same = F.lit(True)
        for k, v in key.items():
            same &= F.col(f"citation.{v}").eqNullSafe(F.col(k))
        claims = claims.join(grown(each), same, "left").drop(*key)
    most = F.col("name_overlap")
    category = F.when(F.col("match_method") != "no_evidence", F.lit(None)).otherwise(
        F.when(F.col("citation.act_norm") == "", F.lit("unresolved_act"))
        .when(most.isNull(), F.lit("provision_absent"))
        .when((most >= low) & (most < high), F.lit("matching_defect"))
        .otherwise(F.lit("wrong_act_or_edition"))
    )
    return claims.withColumn("no_evidence_category", category)


def ambiguous_numbers(claims: DataFrame, doc: str = "document_id") -> DataFrame:
    """Adds ``ambiguous``: a document cites the claim's number under two acts or more."""
    w = W.partitionBy(doc, "citation.provision_type", "citation.provision_number")
    acts = F.size(F.collect_set(F.when(F.col("citation.act_norm") != "", F.col("citation.act_norm"))).over(w))
    return claims.withColumn("ambiguous", acts >= 2)


def coverage(claims: DataFrame, *by: str) -> DataFrame:
    """Claims with and without evidence, by group or in all."""
    has = F.col("match_method") != "no_evidence"
    return claims.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.count_if(has).alias("n_with_evidence"),
        F.count_if(~has).alias("n_without_evidence"),
        F.bround(F.try_divide(100.0 * F.count_if(has), F.count(F.lit(1))), 1).alias("coverage_pct"),
    )


def coverage_change(before: DataFrame, after: DataFrame, ident: tuple[str, ...] = ("document_id", "claim_id")) -> DataFrame:
    """Claims by what two evidence versions make of them: gained, lost, both, neither."""
    a = before.select(*ident, (F.col("match_method") != "no_evidence").alias("had"))
    b = after.select(*ident, (F.col("match_method") != "no_evidence").alias("has"))
    change = F.when(F.col("had") & F.col("has"), "both").when(F.col("has"), "gained").when(F.col("had"), "lost").otherwise("neither")
    return a.join(grown(b), list(ident)).groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def cases_with_overlap(cases: DataFrame, evidence: DataFrame, least: int = 1) -> DataFrame:
    """Cases of whose raw citation keys at least ``least`` hit the evidence exactly, by each key's first citation.

    Each distinct key is parsed and looked up once; cases are joined to the keys that hit."""
    from lexaudit.operators.claims import claims_of

    keys = cases.select("document_id", F.explode("raw_citation_keys").alias("key"))
    cited = keys.select("key").distinct().withColumn("c", F.get(claims_of(F.col("key")), F.lit(0))).filter("c is not null").select(F.col("key").alias("_key"), "c.citation")
    pool = _pool(evidence).select("e_type", "e_number", "e_sub", "e_act").distinct()
    hit = cited.join(
        grown(pool),
        (F.col("citation.provision_type") == F.col("e_type"))
        & (F.col("citation.provision_number") == F.col("e_number"))
        & F.col("citation.subsection").eqNullSafe(F.col("e_sub"))
        & (F.col("citation.act_norm") == F.col("e_act")),
    )
    met = keys.join(grown(cut(hit.select("_key"))), F.col("key") == F.col("_key"))
    enough = met.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return cases.join(grown(enough.select("document_id")), "document_id", "left_semi")
