"""Benchmark construction from evidence: controlled conditions, stress claims, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.functions import text as T
from lexaudit.session import grown

# ---- fixed values: rewriting rules (name, pattern, replacement), in order
PARAPHRASES = (
    ("whoever_to_any_person_who", r"\bWhoever\b", "Any person who"),
    ("whoever_lc_to_any_person_who", r"\bwhoever\b", "any person who"),
    ("punished_with_to_liable_to_punishment_of", r"\bshall be punished with\b", "is liable to punishment of"),
    ("also_liable_fine_to_also_liable_a_fine", r"\bshall also be liable to fine\b", "is also liable to a fine"),
    ("shall_also_be_liable_to_is_also_liable_to", r"\bshall also be liable to\b", "is also liable to"),
    ("shall_be_liable_to_is_liable", r"\bshall be liable\b", "is liable"),
    ("imprisonment_for_life_to_life_imprisonment", r"\bimprisonment for life\b", "life imprisonment"),
    ("may_extend_to_to_may_go_up_to", r"\bmay extend to\b", "may go up to"),
    ("punishable_with_to_carrying_punishment_of", r"\bpunishable with\b", "carrying a punishment of"),
    ("shall_have_power_to_is_empowered", r"\bshall have power\b", "is empowered"),
    ("shall_have_powers_to_is_empowered", r"\bshall have powers\b", "is empowered"),
    ("shall_be_deemed_to_be_to_is_to_be_regarded_as", r"\bshall be deemed to be\b", "is to be regarded as"),
    ("shall_not_to_is_not_to", r"\bshall not\b", "is not to"),
    ("notwithstanding_to_despite", r"\bNotwithstanding anything contained in\b", "Despite anything stated in"),
    ("subject_to_provisions_of_to_subject_to_what_is_provided_in", r"\bsubject to the provisions of\b", "subject to what is provided in"),
    ("in_accordance_with_to_in_conformity_with", r"\bin accordance with\b", "in conformity with"),
    ("in_relation_to_to_with_respect_to", r"\bin relation to\b", "with respect to"),
    ("by_reason_of_to_because_of", r"\bby reason of\b", "because of"),
    ("for_the_purposes_of_to_for_the_purpose_of", r"\bfor the purposes of\b", "for the purpose of"),
    ("as_the_case_may_be_to_whichever_applies", r"\bas the case may be\b", "whichever applies"),
    ("not_less_than_to_at_least", r"\bnot less than\b", "at least"),
    ("not_exceeding_to_no_more_than", r"\bnot exceeding\b", "no more than"),
    ("in_the_opinion_of_to_in_the_view_of", r"\bin the opinion of\b", "in the view of"),
    ("it_appears_to_to_it_seems_to", r"\bit appears to\b", "it seems to"),
    ("aggrieved_by_to_adversely_affected_by", r"\baggrieved by\b", "adversely affected by"),
    ("unless_context_otherwise_requires_to_except_where", r"\bunless the context otherwise requires\b", "except where the context requires otherwise"),
    ("in_furtherance_of_to_in_pursuance_of", r"\bin furtherance of\b", "in pursuance of"),
    ("every_to_each", r"\bEvery\b", "Each"),
    ("no_person_to_no_individual", r"\bNo person\b", "No individual"),
    ("each_of_such_persons_to_every_one_of_those_persons", r"\beach of such persons\b", "every one of those persons"),
    ("the_said_to_that", r"\bthe said\b", "that"),
    ("at_any_time_to_at_any_point", r"\bat any time\b", "at any point"),
)
NEGATIONS = (
    ("prohibition_lifted", r"\bshall not\b", "shall"),
    ("punishment_negated", r"\bshall be punished with\b", "shall not be punished with"),
    ("power_negated", r"\bshall have\b", "shall not have"),
    ("obligation_negated_shall_be", r"\bshall be\b", "shall not be"),
    ("obligation_negated_shall", r"\bshall\b", "shall not"),
    ("permission_negated_may", r"\bmay\b", "may not"),
    ("entitlement_negated_is_entitled", r"\bis entitled\b", "is not entitled"),
    ("liability_negated_is_liable", r"\bis liable\b", "is not liable"),
    ("definition_inverted_includes", r"\bincludes\b", "excludes"),
    ("classification_negated_is_murder", r"\bis murder\b", "is not murder"),
)
FINE = ("secondary_fine_negated", r"\bshall also be liable to fine\b", "shall not be liable to any fine")
FALLBACK = "sentential_negation_fallback"
STRIDES = (17, 23, 29, 31, 37, 41, 43, 47, 53)
LEAST_TIE = 0.35
TAG, VERSION = "CONTROLLED_VERIFIER_BENCHMARK", "v2"
ADDED_DUTY = ", and the affected party must additionally file a written notice with the appropriate authority within thirty days before this provision may be invoked."
STRESS = (
    ("punishment_death_to_fine_only", "death", " provides that the only punishment is a nominal fine, and death or imprisonment can never be imposed under this provision."),
    ("punishment_life_imprisonment_to_short_term", "imprisonment for life", " limits the maximum punishment to a fine of five hundred rupees, with no possibility of imprisonment for life."),
    ("may_to_must", " may ", " makes this action an absolute, non-discretionary legal duty that must always be carried out, with no discretion permitted."),
    ("shall_negated", " shall ", " makes compliance with this requirement entirely optional, and it need not be followed under any circumstances."),
)
STRESS_CONDITION = ("condition_reversed_unless_except", r"(?i)\b(unless|except|without prejudice|provided that)\b", " applies unconditionally in every case, without any of the exceptions or qualifying conditions it actually states.")
#: The first edition's contradictions: what the text has (any case), and what is replaced in it, in turn.
FIRST_EDITION = (
    (("shall not",), (("shall not", "shall at all times"), ("Shall not", "Shall at all times"))),
    (("shall be punished",), (("shall be punished with", "is completely exempt from punishment and cannot be penalized for"), ("shall also be liable to fine", "shall not be subject to any fine"))),
    (("shall have power",), (("shall have power", "has no power or authority"), ("shall have powers", "has no powers or authority"))),
    (("shall",), (("shall", "shall not"), ("Shall", "Shall not"))),
    (("may",), (("may", "shall under no circumstances"), ("May", "Shall under no circumstances"))),
)
REPEALED = ("This provision has been completely repealed and imposes no legal effect whatsoever regarding ", ".")
FIRST_NEI = " requires prior written authorization from the High Court Registrar and mandatory filing within 14 business days of the alleged occurrence."
STRESS_OTHER = ("generic_negation", " has no legal effect in this case and imposes no obligation, right, or restriction of any kind.")
# ---- end of fixed values


def cite(kind: Column, number: Column, sub: Column, act: Column) -> Column:
    return F.concat(kind, F.lit(" "), number, F.when(F.coalesce(F.length(sub), F.lit(0)) > 0, F.concat(F.lit("("), sub, F.lit(")"))).otherwise(F.lit("")), F.lit(" of "), act)


def lower_first(t: Column) -> Column:
    return F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def without_period(t: Column) -> Column:
    return F.regexp_replace(t, r"\.\z", "")


def paraphrased(t: Column) -> Column:
    """(text, rules): every rule that matches, in order, with the names of those that changed the text."""
    rules = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(r).alias("r")) for n, p, r in PARAPHRASES])
    start = F.struct(t.alias("text"), F.array().cast("array<string>").alias("rules"))

    def step(acc: Column, rule: Column) -> Column:
        new = F.regexp_replace(acc["text"], rule["p"], rule["r"])
        return F.struct(new.alias("text"), F.when(new != acc["text"], F.concat(acc["rules"], F.array(rule["n"]))).otherwise(acc["rules"]).alias("rules"))

    return F.aggregate(rules, start, step)


def negated(t: Column) -> Column:
    """(text, rules): the first rule that fires, once; else the whole sentence denied."""
    out = F.when(F.length(t) == 0, F.struct(t.alias("text"), F.array().cast("array<string>").alias("rules")))
    for name, pattern, new in NEGATIONS:
        once = F.regexp_replace(t, rf"(?s)\A(.*?){pattern}", f"$1{new}")
        rules = F.array(F.lit(name))
        if name == "punishment_negated":
            fined = F.regexp_like(once, F.lit(FINE[1]))
            rules = F.when(fined, F.array(F.lit(name), F.lit(FINE[0]))).otherwise(rules)
            once = F.regexp_replace(once, FINE[1], FINE[2])
        out = out.when(F.regexp_like(t, F.lit(pattern)), F.struct(once.alias("text"), rules.alias("rules")))
    denied = F.concat(F.lit("It is not the case that "), lower_first(without_period(t)), F.lit("."))
    return out.otherwise(F.struct(denied.alias("text"), F.array(F.lit(FALLBACK)).alias("rules")))


def words(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), 0))


def partners(evidence: DataFrame) -> DataFrame:
    """(pool_ord, partner): another record at the first stride whose text is unlike enough.

    ``pool_ord`` counts from 0 without gaps. Nine equi-joins in one: strides are exploded to the
    ordinal they reach."""
    n = evidence.count()
    base = evidence.select("pool_ord", F.col("dataset_citation_key").alias("_key"), words(F.col("canonical_text")).alias("_w"))
    reach = base.select("pool_ord", "_key", "_w", F.posexplode(F.array(*[F.lit(s) for s in STRIDES])).alias("place", "stride")).withColumn("_at", (F.col("pool_ord") + F.col("stride")) % max(1, n))
    other = evidence.select(F.col("pool_ord").alias("_o"), F.col("dataset_citation_key").alias("o_key"), F.trim("canonical_text").alias("o_text"), words(F.col("canonical_text")).alias("_ow"))
    fit = reach.join(grown(other), F.col("_at") == F.col("_o")).filter((F.col("_key") != F.col("o_key")) & (T.token_overlap(F.col("_w"), F.col("_ow")) < LEAST_TIE))
    return fit.groupBy("pool_ord").agg(F.min_by(F.struct("o_key", "o_text"), "place").alias("partner"))


def controlled(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Benchmark items, up to eight conditions a record, and what could not be made, with the reason."""
    e = evidence.withColumn("t", F.trim("canonical_text")).withColumn("c", cite(F.col("provision_type"), F.col("provision_number"), F.col("subsection"), F.col("act")))
    e = e.withColumn("para", paraphrased(F.col("t"))).withColumn("neg", negated(F.col("t"))).join(grown(partners(evidence)), "pool_ord", "left")

    def item(condition: str, text: Column, label: str, rules: Column, attributed: bool, para: bool, ok: Column) -> Column:
        said = F.concat(F.lit("According to "), F.col("c"), F.lit(", "), lower_first(text)) if attributed else text
        all_rules = F.concat(rules, F.array(F.lit("attribution_prefix"))) if attributed else rules
        return F.when(ok, F.struct(F.lit(condition).alias("condition"), said.alias("hypothesis"), F.lit(label).alias("expected_label"), all_rules.alias("construction_rules"), F.lit(attributed).alias("factor_attribution"), F.lit(para).alias("factor_paraphrase")))

    yes, verbatim = F.lit(True), F.array(F.lit("verbatim_canonical"))
    has_para = (F.size("para.rules") > 0) & (F.col("para.text") != F.col("t"))
    has_neg = (F.size("neg.rules") > 0) & (F.col("neg.text") != F.col("t"))
    has_other = F.col("partner").isNotNull()
    made = F.array(
        item("E1_verbatim", F.col("t"), S.ENTAILED, verbatim, False, False, yes),
        item("E2_verbatim_attributed", F.col("t"), S.ENTAILED, verbatim, True, False, yes),
        item("E3_paraphrase_bare", F.col("para.text"), S.ENTAILED, F.col("para.rules"), False, True, has_para),
        item("E4_paraphrase_attributed", F.col("para.text"), S.ENTAILED, F.col("para.rules"), True, True, has_para),
        item("C1_negated_bare", F.col("neg.text"), S.CONTRADICTED, F.col("neg.rules"), False, False, has_neg),
        item("C2_negated_attributed", F.col("neg.text"), S.CONTRADICTED, F.col("neg.rules"), True, False, has_neg),
        item("N1_other_provision", F.col("partner.o_text"), S.NEI, F.array(F.concat(F.lit("verbatim_canonical_of_other_provision:"), F.col("partner.o_key"))), False, False, has_other),
        item("N2_procedural_addition", F.concat(without_period(F.col("t")), F.lit(ADDED_DUTY)), S.NEI, F.array(F.lit("canonical_plus_extraneous_procedural_condition")), False, False, yes),
    )
    items = e.select("*", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select(
        F.concat(F.lit("cb_"), T.short_id(F.col("dataset_citation_key")), F.lit("_"), F.col("i.condition")).alias("benchmark_id"),
        F.lit(TAG).alias("benchmark_tag"), F.lit(VERSION).alias("benchmark_version"), F.col("dataset_citation_key").alias("evidence_key"), F.col("t").alias("evidence_text"),
        "provision_type", "provision_number", F.col("act").alias("act_name"), "audit_verdict", "i.*",
    )
    lost = F.array(
        F.when(~has_para, F.struct(F.array(F.lit("E3_paraphrase_bare"), F.lit("E4_paraphrase_attributed")).alias("conditions"), F.lit("no meaning-preserving paraphrase rule matched this text").alias("reason"))),
        F.when(~has_neg, F.struct(F.array(F.lit("C1_negated_bare"), F.lit("C2_negated_attributed")).alias("conditions"), F.lit("no operative modal available to negate grammatically").alias("reason"))),
        F.when(~has_other, F.struct(F.array(F.lit("N1_other_provision")).alias("conditions"), F.lit("no sufficiently dissimilar provision available for neutral pairing").alias("reason"))),
    )
    dropped = e.select(F.col("dataset_citation_key").alias("evidence_key"), F.explode(F.filter(lost, lambda x: x.isNotNull())).alias("d")).select("evidence_key", "d.*")
    return items, dropped


def violations(items: DataFrame) -> DataFrame:
    """(benchmark_id, problem) for items that break a construction rule; a sound benchmark has none."""
    h, e, c = F.col("hypothesis"), F.col("evidence_text"), F.col("condition")
    rule_text = F.when(F.col("factor_attribution"), F.regexp_replace(h, r"(?s)\AAccording to .*?, ", "")).otherwise(h)
    tests = {
        "double-negation artifact": F.regexp_like(h, F.lit(r"\bnot not\b")),
        "malformed pluralisation artifact": F.regexp_like(h, F.lit(r"\bauthoritys\b")),
        "empty hypothesis": F.trim(h) == "",
        "hypothesis not lexically tied to canonical text": (c != "N1_other_provision") & (T.token_overlap(words(rule_text), words(e)) < LEAST_TIE),
        "paraphrase identical to source": F.regexp_like(c, F.lit("^E[34]")) & (h == e),
        "contradiction identical to source": F.startswith(c, F.lit("C")) & (without_period(h) == without_period(e)),
        "neutral pairing selected the same provision": (c == "N1_other_provision") & (h == e),
        "attribution factor and prefix disagree": F.col("factor_attribution") != F.startswith(h, F.lit("According to ")),
    }
    found = F.filter(F.array(*[F.when(t, F.lit(p)) for p, t in tests.items()]), lambda x: x.isNotNull())
    broken = items.select("benchmark_id", F.explode(found).alias("problem"))
    repeated = items.groupBy("benchmark_id").count().filter("count > 1").select("benchmark_id", F.lit("duplicate benchmark_id").alias("problem"))
    return broken.unionByName(repeated)


def stress_claims(evidence: DataFrame) -> DataFrame:
    """One false claim a record, by the first rule its text calls for; ``pool_ord`` numbers them."""
    t = F.col("canonical_text")
    low = F.lower(t)
    name = said = F
    for rule, mark, text in STRESS:
        name = name.when(F.contains(low, F.lit(mark)), F.lit(rule))
        said = said.when(F.contains(low, F.lit(mark)), F.lit(text))
    name = name.when(F.regexp_like(t, F.lit(STRESS_CONDITION[1])), F.lit(STRESS_CONDITION[0])).otherwise(F.lit(STRESS_OTHER[0]))
    said = said.when(F.regexp_like(t, F.lit(STRESS_CONDITION[1])), F.lit(STRESS_CONDITION[2])).otherwise(F.lit(STRESS_OTHER[1]))
    c = cite(F.col("provision_type"), F.col("provision_number"), F.col("subsection"), F.col("act"))
    return evidence.select(
        F.concat(F.lit("s"), (F.col("pool_ord") + 1).cast("string")).alias("claim_id"), F.concat(c, said).alias("claim_text"), name.alias("transform_rule"),
        "dataset_citation_key", "provision_type", "provision_number", "subsection", F.col("act").alias("act_raw"), "act_norm", F.lit("SYNTHETIC_STRESS_TEST").alias("claim_source"),
    )


def first_edition(evidence: DataFrame) -> DataFrame:
    """The benchmark's first edition: an entailed, a contradicted and an open item for each record."""
    t = F.col("canonical_text")
    name = F.concat("provision_type", F.lit(" "), "provision_number", F.lit(" of "), "act")
    denied = F
    for marks, changes in FIRST_EDITION:
        new = t
        for old, text in changes:
            new = F.replace(new, F.lit(old), F.lit(text))
        denied = denied.when(F.contains(F.lower(t), F.lit(marks[0])), new)
    denied = denied.otherwise(F.concat(F.lit(REPEALED[0]), F.substring(t, 1, 30), F.lit(REPEALED[1])))
    items = (
        ("entailed", F.concat(F.lit("According to "), name, F.lit(", "), t), S.ENTAILED, "faithful_paraphrase_with_attribution"),
        ("contradicted", F.concat(name, F.lit(" provides that "), denied), S.CONTRADICTED, "deterministic_negation"),
        ("nei", F.concat(name, F.lit(FIRST_NEI)), S.NEI, "interpretive_beyond_evidence"),
    )
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), h.alias("hypothesis"), F.lit(label).alias("expected_label"), F.lit(rule).alias("construction_rule")) for k, h, label, rule in items]))
    rows = evidence.select("dataset_citation_key", made.alias("i"))
    return rows.select(F.concat(F.lit("bench_"), T.short_id(F.col("dataset_citation_key")), F.lit("_"), F.col("i.kind")).alias("benchmark_id"), F.col("dataset_citation_key").alias("evidence_key"), "i.hypothesis", "i.expected_label", "i.construction_rule")


def evidence_id_parts(evidence_id: Column, kinds: tuple[str, ...] = ("Article", "Section")) -> Column:
    """(type, number, act) of an id like ``Section 1 in An Act``; null if it is none."""
    pattern = rf"^({'|'.join(kinds)}) (.+?) in (.+)$"
    return F.when(F.regexp_like(evidence_id, F.lit(pattern)), F.struct(*[F.regexp_extract(evidence_id, pattern, i + 1).alias(n) for i, n in enumerate(("provision_type", "provision_number", "act"))]))


def annotation_export(items: DataFrame) -> DataFrame:
    """Items for blind annotation: neither label nor construction can be read from what is left."""
    return items.select(F.sha2("benchmark_id", 256).substr(1, 12).alias("item_id"), "evidence_text", "hypothesis", F.lit(None).cast("string").alias("annotator_label"), F.lit(None).cast("string").alias("annotator_note")).orderBy("item_id")
