"""Operators on small tables: linkage, gates, metrics, selection, review, benchmarks, streams."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexaudit import schemas as S
from lexaudit.functions import stats
from lexaudit.functions import text as T
from lexaudit.operators import benchmarks, bootstrap, claims, evidence, gates, learning, metrics, retrieval, review, selection, verdicts
from lexaudit.sources import io
from lexaudit.streaming import stages

IPC = "The Indian Penal Code, 1860"
ROWS = [
    ("Section 302 in The Indian Penal Code, 1860", IPC, "Section", "302", None),
    ("Section 34 in The Indian Penal Code, 1860", IPC, "Section", "34", None),
    ("Section 149 in Code of Criminal Procedure, 1973", "The Code of Criminal Procedure, 1973", "Section", "149", None),
    ("Article 21 in Constitution of India", "Constitution of India", "Article", "21", None),
    ("Section 7(1) in Arms Act, 1959", "The Arms Act, 1959", "Section", "7", "1"),
    ("Section 9 in Arms Act, 1959", "The Arms Act, 1959", "Section", "9", None),
    ("Section 9 in Arms Act, 1878", "The Arms Act, 1878", "Section", "9", None),
    ("bad", "The Bad Act, 1900", "Section", "1", None),
]


@pytest.fixture(scope="module")
def pool(spark):
    c = spark.createDataFrame([(*r, f"Text of {r[0]}.", "u", i) for i, r in enumerate(ROWS)], f"{S.CANONICAL.replace('source_url string', 'source_url string')}, line_ord long")
    a = spark.createDataFrame([(r[0], "INVALID" if r[0] == "bad" else "VERIFIED_EXACT") for r in ROWS], S.AUDIT)
    return evidence.usable_evidence(c, a)


def cited(spark, rows):
    kind = "document_id string, claim_id string, citation struct<provision_type: string, provision_number: string, subsection: string, act_raw: string, act_norm: string>"
    return spark.createDataFrame([("d", f"c{i}", (t, n, s, None, a)) for i, (t, n, s, a) in enumerate(rows)], kind)


def test_usable_and_overlay(spark, pool):
    assert pool.count() == 7
    extra = pool.filter("provision_number = '34'").withColumn("canonical_text", F.lit("new")).withColumn("pool_ord", F.lit(0).cast("long"))
    got = evidence.overlay(pool, extra)
    row = got.filter("provision_number = '34'").first()
    assert got.count() == 7 and row["canonical_text"] == "new" and row["pool_ord"] == 1


def test_match(spark, pool):
    c = cited(
        spark,
        [
            ("Section", "302", None, "indian penal code 1860"), ("Section", "302", "1", "indian penal code 1860"), ("Section", "302", None, "indian penal code statute 1860"),
            ("Section", "999", None, "other act"), ("Section", "34", None, ""), ("Section", "9", None, "arms act 1959 amended"), ("Section", "9", None, "arms act 1900"), ("Article", "21", None, "constitution of indiana"),
        ],
    )
    got = {r["claim_id"]: (r["match_method"], r["evidence"]["dataset_citation_key"] if r["evidence"] else None) for r in evidence.match_evidence(c, pool, 0.5).collect()}
    assert got["c0"] == got["c1"] == ("exact_normalized", ROWS[0][0])
    assert got["c2"] == ("fuzzy", ROWS[0][0])
    assert got["c3"][0] == got["c4"][0] == got["c6"][0] == got["c7"][0] == "no_evidence"
    assert got["c5"] == ("fuzzy", ROWS[5][0])
    m = evidence.match_evidence(c, pool)
    kinds = {r["claim_id"]: r["no_evidence_category"] for r in evidence.no_evidence_taxonomy(m, pool).collect()}
    assert kinds["c3"] == "provision_absent" and kinds["c4"] == "unresolved_act" and kinds["c0"] is None
    assert kinds["c2"] == "matching_defect"


def test_claims_inherit_acts(spark):
    f = spark.createDataFrame([("a", "Section 302 of the Indian Penal Code, 1860 prescribes death. Section 302 is grave. Section 34 extends it."), ("b", None), ("c", "Section 1 of the A Act, 1950 governs. Section 2 of the B Act, 1951 governs. Section 3 stands alone.")], "document_id string, text string")
    rows = claims.extract_claims(f).orderBy("document_id", "claim_ord").collect()
    assert [(r["document_id"], r["claim_id"], r["citation"]["act_norm"]) for r in rows] == [
        ("a", "c1", "indian penal code 1860"), ("a", "c2", "indian penal code 1860"), ("a", "c3", "indian penal code 1860"), ("c", "c1", "a act 1950"), ("c", "c2", "b act 1951"), ("c", "c3", ""),
    ]
    assert sorted(claims.extract_claims(f, distinct_texts=True).collect()) == sorted(rows)


def test_verdicts(spark):
    df = spark.createDataFrame([({"entailment": 0.5, "neutral": 0.5, "contradiction": 0.0},), ({"entailment": 0.7, "neutral": 0.2, "contradiction": 0.1},), ({"entailment": 0.1, "neutral": 0.1, "contradiction": 0.8},)], "s map<string,double>")
    v = [r["v"] for r in df.select(verdicts.verdict(F.col("s")).alias("v")).collect()]
    assert [(x["label"], x["sub_reason"]) for x in v] == [(S.NEI, "low_confidence"), (S.ENTAILED, None), (S.CONTRADICTED, None)]
    t = spark.createDataFrame([("neither A nor B", True), ("is not applicable here", True), ("applies", False)], "t string, e boolean")
    assert all(r["n"] == r["e"] for r in t.select("e", T.negated(F.col("t")).alias("n")).collect())


def test_fragments(spark):
    rows = [("34", "Section 134", False), ("34", "Sections 34 and 35", True), ("34 (x)", "see 34 (x), y", True), ("", "a", False), ("a.c", "abc", False), (r"a\Eb", r"x a\Eb", True)]
    df = spark.createDataFrame(rows, "f string, t string, e boolean")
    assert all(r["g"] == r["e"] for r in df.select("e", T.fragment_present(F.col("f"), F.col("t")).alias("g")).collect())
    s = spark.createDataFrame([("a b a", "a", "z"), ("a b", "a", "z")], "t string, o string, n string")
    assert [r[0] for r in s.select(T.splice_once(F.col("t"), F.col("o"), F.col("n"))).collect()] == [None, "z b"]


GOLD = [
    ([[184, 0, 0], [5, 110, 3], [0, 4, 114]], 0.9714286, 0.9683613, 0.9712266),
    ([[184, 0, 0], [8, 101, 9], [1, 8, 109]], 0.9380952, 0.9299080, 0.9371710),
]


@pytest.mark.parametrize("matrix, accuracy, macro, weighted", GOLD)
def test_golden_metrics(spark, matrix, accuracy, macro, weighted):
    m = spark.createDataFrame([(g, p, matrix[i][j]) for i, g in enumerate(S.LABELS) for j, p in enumerate(S.LABELS)], "gold string, predicted string, n long")
    r = metrics.summary(m).first()
    assert abs(r["accuracy"] - accuracy) < 1e-6 and abs(r["macro_f1"] - macro) < 1e-6 and abs(r["weighted_f1"] - weighted) < 1e-6


def test_golden_statistics(spark):
    one = spark.createDataFrame([(15, 0, 100, 11, 2, 6, 20)], "b long, c long, h long, x long, y long, s long, t long")
    w = stats.wilson(F.lit(408), F.lit(420))
    r = one.select(
        w["low"].alias("lo"), w["high"].alias("hi"), stats.mcnemar_chi2(F.col("b"), F.col("c")).alias("chi"), stats.mcnemar_p(F.col("b"), F.col("c")).alias("p"), stats.sign_test(F.col("b"), F.col("c")).alias("sign"),
        stats.sign_test(F.col("h"), F.col("c")).alias("far"), stats.sign_test(F.col("x"), F.col("y")).alias("recall"), stats.sign_test(F.col("s"), F.col("t")).alias("split"), stats.sign_test(F.col("c"), F.col("c")).alias("none"),
        stats.sign_test(F.lit(1), F.lit(1)).alias("even"),
    ).first()
    assert abs(r["lo"] - 0.9507298) < 1e-6 and abs(r["hi"] - 0.9835818) < 1e-6
    assert abs(r["chi"] - 13.0666667) < 1e-6 and abs(r["p"] - 0.00030060) < 1e-7
    assert abs(r["sign"] - 6.1035e-05) < 1e-8 and abs(r["far"] / 1.5777e-30 - 1) < 1e-4
    assert abs(r["recall"] - 0.0224609) < 1e-6 and abs(r["split"] - 0.0093553) < 1e-6 and r["none"] == 1.0 and r["even"] == 1.0


def test_metric_literal(spark):
    df = spark.createDataFrame([("CONTRADICTED", "NO_EVIDENCE"), ("ENTAILED", "ENTAILED"), (S.NEI, None)], "g string, p string")
    m = metrics.confusion(df, "g", "p")
    assert abs(metrics.summary(m).first()["accuracy"] - 1 / 3) < 1e-9
    assert {r["predicted"] for r in m.collect()} == {*S.LABELS, "NO_EVIDENCE", metrics.FAILED}


def test_gates(spark):
    kind = "flagged boolean, by_span boolean, spans_ok boolean, spliced boolean, siblings_kept boolean, n_new int, ambiguous boolean, reverified string, n_regressions int, e string"
    ok = (True, True, True, True, True, 0, False, S.ENTAILED, 0)
    rows = [
        (*ok, "corrected"), (False, *ok[1:], "not_triggered"), (True, True, False, *ok[3:], "correction_span_invalid"), (True, True, True, False, *ok[4:], "correction_splice_unavailable"),
        (True, False, True, False, *ok[4:], "correction_sentence_splice_unavailable"), (*ok[:4], False, *ok[5:], "correction_scope_violation"), (*ok[:5], 1, *ok[6:], "correction_unauthorized_addition"),
        (*ok[:6], True, *ok[7:], "correction_ordinal_ambiguous"), (*ok[:7], None, 0, "correction_failed"), (*ok[:8], 2, "correction_sibling_regression"),
    ]
    df = spark.createDataFrame(rows, kind)
    got = df.select("e", gates.status(df).alias("s"))
    assert all(r["e"] == r["s"] for r in got.collect())
    fields = got.select("s", gates.final_field(F.col("s"), F.lit("old"), F.lit("new")).alias("f")).collect()
    assert {r["s"]: r["f"]["source"] for r in fields}["correction_sentence_splice_unavailable"] == "original"
    assert all((r["f"]["text"] == "new") == (r["s"] == "corrected") for r in fields)
    assert {r["s"]: r["first_failure_stage"] for r in gates.stage_matrix(got.select(F.col("s").alias("status"), "s")).collect()}["correction_splice_unavailable"] == "splice"


def test_counterparts_and_scope(spark):
    text = "Section 1 of the A Act, 1950 governs x. Section 1 of the A Act, 1950 governs y."
    new = "Section 1 of the A Act, 1950 governs y. Section 1 of the A Act, 1950 governs y."
    both = [claims.extract_claims(spark.createDataFrame([("d", t)], "document_id string, text string")) for t in (text, new)]
    paired = gates.counterparts(*both)
    target = both[0].filter("claim_id = 'c1'")
    assert gates.ordinal_ambiguous(paired, target).first()["ambiguous"]
    corrected = spark.createDataFrame([("d", "c1", new)], "document_id string, target_claim_id string, corrected_text string")
    assert gates.scope_kept(both[0], corrected).first()["siblings_kept"]
    assert gates.new_identities(*both).first()["n_new"] == 0


def test_diversity(spark):
    import random

    r = random.Random(0)
    rows = [(f"d{i:02d}", r.randint(0, 9), [(f"a{r.randint(0, 4)}", "1") for _ in range(r.randint(0, 3))]) for i in range(40)]
    df = spark.createDataFrame(rows, "document_id string, score int, matched_pairs array<struct<act_norm: string, provision_number: string>>").withColumn("n_distinct_evidence_pairs", F.size("matched_pairs"))
    got = [x["document_id"] for x in selection.top_cases(df, 40).orderBy("place").collect()]
    order = sorted(rows, key=lambda x: (-x[1], -len(x[2]), x[0]))
    seen, first, rest = set(), [], []
    for d, _, p in order:
        (first if set(p) - seen else rest).append(d)
        seen |= set(p)
    assert got == first + rest


def test_review(spark):
    raw = spark.createDataFrame([("1", "c1", "S one.", "Section 5 of the Arms Act", "yes", "Partially ", "see row 2", None, 0), ("2.0", "c1", "S two", "Order", "No", "no", None, "as no. 1", 1)], ", ".join(f"`{h}` string" for h in review.HEADERS) + ", row_ord long")
    a = review.import_rows(raw)
    assert [(r["annotation_id"], r["statement_correctness"], r["reference_correctness"]) for r in a.orderBy("row_ord" if "row_ord" in a.columns else "annotation_id").collect()] == [("LR-0001", "Yes", "Partially"), ("LR-0002", "No", "No")]
    assert sorted(r["referenced_source_row_number"] for r in review.cross_references(a).collect()) == [1, 2]
    bad = raw.select(*[(F.lit("3.5") if h == "No." else F.col(f"`{h}`")).alias(h) for h in review.HEADERS], "row_ord")
    with pytest.raises(Exception, match="positive integer"):
        review.import_rows(bad).collect()
    c = spark.createDataFrame(
        [("c1", "f1", "f1", "c1", "s  ONE.", "", "Section", "5", "the Arms Act, 1959", "arms act 1959", None, None, "fuzzy", "ENTAILED", "m"), ("c1", "f2", "f2", "c1", "S one.", "", "Section", "5", "the Arms Act, 1959", "arms act 1959", "e", "t", "fuzzy", None, "m")],
        "document_id string, source_file string, source_ord string, claim_id string, claim_text string, assertion_text string, provision_type string, provision_number string, act_raw string, act_norm string, evidence_id string, evidence_text string, evidence_match_method string, verdict string, verifier_model string",
    )
    m = review.merge_variants(c).first()
    assert m["verdict"] == "VARIANT" and m["evidence_match_method"] == "fuzzy" and m["evidence_id"] == "e" and m["source_files"] == ["f1", "f2"]
    got = {r["annotation_id"]: r for r in review.align(a, c).collect()}
    assert got["LR-0001"]["num_reference_aligned_matches"] == 1 and got["LR-0001"]["unmatched_reason"] is None
    assert got["LR-0002"]["unmatched_reason"] == "no_exact_statement_match"
    cov = review.alignment_coverage(review.align(a, c)).first()
    assert cov["rows_with_unique_alignment"] == 1 and cov["rows_with_case_found"] == 2
    with pytest.raises(ValueError, match="without a partner"):
        review.joined_one_to_one(a.select("annotation_id"), a.select("annotation_id").limit(1), "annotation_id")


def test_benchmark_is_sound(spark):
    rows = [(f"K{i}", i, t, "Section", str(i), None, f"The Act {i}", f"act {i}", "VERIFIED_EXACT") for i, t in enumerate([f"Whoever commits act{i} of kind{i} alpha{i} beta{i} shall be punished with imprisonment for life, and shall also be liable to fine." for i in range(60)])]
    e = spark.createDataFrame(rows, "dataset_citation_key string, pool_ord long, canonical_text string, provision_type string, provision_number string, subsection string, act string, act_norm string, audit_verdict string")
    items, dropped = benchmarks.controlled(e)
    assert items.count() == 60 * 7 and dropped.count() == 60  # texts are too alike for a neutral partner
    assert benchmarks.violations(items).count() == 0
    neg = items.filter("condition = 'C1_negated_bare' and evidence_key = 'K0'").first()
    assert neg["hypothesis"].endswith("shall not be punished with imprisonment for life, and shall not be liable to any fine.")
    assert benchmarks.stress_claims(e).filter("transform_rule = 'punishment_life_imprisonment_to_short_term'").count() == 60


def test_bootstrap_and_folds(spark):
    rows = [(f"c{i % 12}", "Yes" if i % 3 else "No", "Yes") for i in range(120)]
    df = spark.createDataFrame(rows, "case_reference string, y string, p string")
    ci = {r["metric"]: r for r in bootstrap.cluster_bootstrap(df, "case_reference", "y", "p", 200, 7, labels=("Yes", "No")).collect()}
    assert ci["accuracy"]["low"] <= 80 / 120 <= ci["accuracy"]["high"]
    same = bootstrap.paired_bootstrap(df, "case_reference", "y", "p", "p", replicates=100, labels=("Yes", "No")).first()
    assert same["delta"] == same["low"] == same["high"] == 0
    folds = bootstrap.grouped_folds(df, "case_reference", "y", 4)
    bootstrap.check_no_leak(folds, "case_reference")
    assert folds.select("fold").distinct().count() == 4
    assert bootstrap.majority_baseline(folds, "y", ("Yes", "No", "Partially")).filter("predicted = 'Yes'").count() == 120
    units, n = bootstrap.numbered_units(df, "case_reference")
    with pytest.raises(ValueError, match="replicates"):
        bootstrap.replicate_weights(units, n, 10, 1)
    with pytest.raises(ValueError, match="two units"):
        bootstrap.replicate_weights(units, 1, 100, 1)
    drawn = bootstrap.replicate_weights(units, n, 100, 1).groupBy("replicate").agg(F.sum("weight").alias("n")).collect()
    assert len(drawn) == 100 and {r["n"] for r in drawn} == {12}


def test_run_states(spark):
    events = [("r1", 0, "claims", "started"), ("r1", 1, "run", "complete"), ("r2", 0, "error", "failed"), ("r3", 0, "run", "complete"), ("r3", 1, "claims", "started"), ("r4", 0, "claims", "started")]
    df = spark.createDataFrame(events, "run_id string, seq long, stage string, status string")
    want = {"r1": "complete", "r2": "failed", "r3": "protocol_error", "r4": "open"}
    assert {r["run_id"]: r["state"] for r in stages.run_states(df).collect()} == want


def test_events_and_payloads(spark):
    lines = spark.createDataFrame([('{"stage":"claims","status":"started","data":{"n":1}}',), ('{"stage":1,"status":"x"}',), ("nonsense",)], "value string")
    assert [r["valid"] for r in stages.parse_events(lines).collect()] == [True, False, False]
    bodies = spark.createDataFrame([('{"document_id":"a","case_text":"t"}',), ('{"document_id":"a"}',), ('{"document_id":"a","document_id":"b","case_text":"t"}',), ("[]",)], "b string")
    assert [r[0] for r in bodies.select(stages.payload_problem(F.col("b"))).collect()] == [None, "keys differ", "repeated key", "not a JSON object"]


def test_sources(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"dataset_citation_key":"k","audit_verdict":"INVALID"}\n\n{"dataset_citation_key":"l","audit_verdict":"INVALID"}\n')
    assert io.read_jsonl(spark, str(p), S.AUDIT).count() == 2
    (tmp_path / "b.jsonl").write_text('{"dataset_citation_key":\n')
    with pytest.raises(Exception, match="invalid JSON"):
        io.read_jsonl(spark, str(tmp_path / "b.jsonl"), S.AUDIT).collect()
    (tmp_path / "c.json").write_text('[{"document_id":"d","summarized_text":"s","sections":{"Section 1 in X":"long"}},{"document_id":"e","summarized_text":"s","sections":null}]')
    cases = io.read_cases(spark, [str(tmp_path / "c.json"), str(tmp_path / "none.json")]).orderBy("document_id").collect()
    assert [r["raw_citation_keys"] for r in cases] == [["Section 1 in X"], []]
    m = {r["path"]: r for r in io.manifest(spark, f"file:{tmp_path}", ["a.jsonl", "zzz"]).collect()}
    assert m["a.jsonl"]["present"] and len(m["a.jsonl"]["sha256"]) == 64 and not m["zzz"]["present"]


def test_retrieval(spark):
    names = spark.createDataFrame([("arms act 1959",), ("indian penal code 1860",), ("explosives act 1884",)], "act_norm string")
    index = retrieval.bm25_index(names)
    own = retrieval.bm25_similarity(names.withColumnRenamed("act_norm", "query"), index).filter("query = doc").collect()
    assert len(own) == 3 and all(abs(r["similarity"] - 1) < 1e-9 for r in own)


def test_folds_of_any_number_of_groups(spark):
    df = spark.range(400).selectExpr("id", "if(id % 40 = 0, null, cast(id % 40 as string)) as g", "if(id % 7 = 0, null, 'Yes') as y")
    folds = bootstrap.grouped_folds(df, "g", "y", 3)
    assert folds.count() == 400 and folds.select("fold").distinct().count() == 3
    bootstrap.check_no_leak(folds, "g")
    with pytest.raises(ValueError, match="several folds"):
        bootstrap.check_no_leak(folds.withColumn("fold", F.col("id") % 3), "g")
    with pytest.raises(ValueError, match="splits"):
        bootstrap.grouped_folds(df, "g", "y", 41)
    many = spark.range(300_000).selectExpr("id", "concat('g', cast(sqrt(id) * 300 as int)) as g", "if(hash(id) % 3 = 0, 'a', 'b') as y")
    folded = bootstrap.grouped_folds(many, "g", "y", 4)
    bootstrap.check_no_leak(folded, "g")
    assert folded.count() == 300_000 and many.select("g").distinct().count() > 100_000
    for r in folded.groupBy("y").pivot("fold", [1, 2, 3, 4]).count().collect():
        assert max(r[1:]) - min(r[1:]) <= 2 * 300


def test_sign_test_of_large_counts(spark):
    rows = [(2, 3), (900, 1100), (1500, 1600), (40_000, 41_000), (10**9, 10**9 + 10**5), (5, 10**6), (3000, 3000)]
    df = spark.createDataFrame(rows, "b long, c long")
    got = [r[0] for r in df.select(stats.sign_test(F.col("b"), F.col("c"))).collect()]
    for (b, c), p in zip(rows, got, strict=True):
        n, k = b + c, min(b, c)
        if n < 10**5:
            total, term = 0, 1
            for i in range(k + 1):
                total += term
                term = term * (n - i) // (i + 1)
            want = min(1.0, float(Fraction(2 * total, 2**n)))
            assert abs(p - want) <= 1e-9 * want, (b, c, p, want)
    z = (10**5 - 1) / math.sqrt(2 * 10**9 + 10**5)
    assert abs(got[4] / math.erfc(z / math.sqrt(2)) - 1) < 0.01 and got[5] == 0.0


def test_nulls_in_strata_and_totals(spark):
    df = spark.createDataFrame([("a", "ENTAILED", "ENTAILED", 0.5), (None, "ENTAILED", None, 0.7)], "c string, g string, p string, v double")
    s = {r["c"]: r["accuracy"] for r in metrics.summary(metrics.confusion(df, "g", "p", "c"), "c").collect()}
    assert s == {"a": 1.0, None: 0.0}
    rows = {(r["c"], r["is_total"]): r["n"] for r in metrics.confidence_stats(df, "c", "v").collect()}
    assert rows == {("a", False): 1, (None, False): 1, (None, True): 2}


def test_replay_raises(spark):
    pairs = spark.createDataFrame([("p", "h")], "premise string, hypothesis string")
    hashed = lambda rows: spark.createDataFrame(rows, "p string, h string, raw_scores map<string,double>, verifier_model string, token_count int").select(F.sha2("p", 256).alias("premise_hash"), F.sha2("h", 256).alias("hypothesis_hash"), "raw_scores", "verifier_model", "token_count")
    one = ("p", "h", {"entailment": 1.0}, "m", 10)
    assert verdicts.replay(pairs, hashed([one])).first()["raw_scores"] == {"entailment": 1.0}
    assert verdicts.replay(pairs, hashed([one, (*one[:3], "n", 10)]), "m").count() == 1
    for rows, said in (([("p", "other", {}, "m", 1)], "no recorded score"), ([one, (*one[:3], "n", 10)], "several recorded"), ([(*one[:4], 513)], "token limit")):
        with pytest.raises(Exception, match=said):
            verdicts.replay(pairs, hashed(rows)).collect()


def test_missing_proposals_raise(spark):
    from lexaudit.plans import queries_workflow as Q
    from lexaudit.operators import workflow

    text = spark.createDataFrame([("d", Q._S1)], "document_id string, text string")
    pool, scores = Q._trade_act(spark), Q._trade_scores(spark)
    judged = verdicts.verify(evidence.match_evidence(claims.extract_claims(text), pool), scores)
    none = spark.createDataFrame([], "document_id string, target_claim_id string, proposal string")
    with pytest.raises(Exception, match="no proposal for document d"):
        workflow.correct(text, judged, none, pool, scores).collect()
    made = workflow.generate_with(spark.createDataFrame([("a",)], "case_text string"), lambda: lambda t: t + "!")
    assert made.first()["text"] == "a!"


def test_feature_models_out_of_fold(spark):
    rows = [(i, f"g{i % 12}", "a" if i % 2 else "b", float(i % 2) + 0.1 * (i % 3), None if i % 10 == 0 else float(i % 5), "Yes" if i % 2 else "No") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, cat string, x double, y double, label string")
    folded = bootstrap.grouped_folds(df, "g", "label", 2)
    got = learning.out_of_fold(folded, ["cat"], ["x", "y"], "label", "id").collect()
    assert len(got) == 120 and all(r["label"] == r["predicted"] for r in got)
    a = {r["left_out"]: r["accuracy"] for r in learning.ablations(folded, {"kind": (["cat"], []), "numbers": ([], ["x", "y"])}, "label", "id").collect()}
    assert a.keys() == {"all", "kind", "numbers"} and a["all"] == 1.0


def test_erfc_and_p_values(spark):
    one = spark.createDataFrame([(15, 0, 40, 100, 30, 100)], "b long, c long, x long, n long, y long, m long")
    z = stats.two_proportion_z(F.col("x"), F.col("n"), F.col("y"), F.col("m"))
    r = one.select(stats.mcnemar_p(F.col("b"), F.col("c")).alias("p"), z["z"].alias("z"), z["p"].alias("q")).first()
    assert abs(r["p"] - math.erfc(math.sqrt(196 / 15 / 2))) < 1e-12 and abs(r["q"] - math.erfc(abs(r["z"]) / math.sqrt(2))) < 1e-12


def test_bad_lines_have_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k":\n{"k": 2}\n{"k": 3')
    bad = io.bad_lines(spark, str(tmp_path / "a.jsonl"), "k long").orderBy("line").collect()
    assert [(r["line"], r["value"]) for r in bad] == [(3, '{"k":'), (5, '{"k": 3')]
    assert sorted(r["k"] for r in io.written(spark, str(tmp_path / "a.jsonl"), "k long").collect()) == [1, 2]
    assert io.written(spark, str(tmp_path / "none"), "k long").count() == 0


def test_scorers_get_batches_of_a_size(spark):
    pairs = spark.range(50).selectExpr("id", "'p' as premise", "'h' as hypothesis").coalesce(1)
    sizes = lambda size: sorted(r["raw_scores"]["n"] for r in verdicts.score_with(pairs, lambda: lambda b: [{"n": float(len(b))}] * len(b), size).collect())
    assert sizes(16) == [2.0] * 2 + [16.0] * 48 and sizes(None) == [50.0] * 50
    with pytest.raises(ValueError, match="row at least"):
        verdicts.score_with(pairs, lambda: None, 0)
