"""Plans that must hold on larger tables: what grows is not broadcast, and work is dealt out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.llm import near
from lexaudit.operators import benchmarks, bootstrap, claims, evidence, gates, learning, retrieval, review, verdicts, workflow
from lexaudit.plans import queries, queries_metrics, queries_workflow


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_linkage_and_benchmarks_broadcast_nothing(spark, sf):
    cited_claims, records = queries.composed_claims(spark, sf), queries.usable(spark, sf)
    cited = cited_claims.select(F.col("citation.act_norm").alias("query"), F.col("citation.provision_number").alias("number")).distinct()
    named = records.select(F.col("provision_number").alias("number"), F.col("act_norm").alias("doc"))
    vectors = named.select(F.col("doc").alias("name"), F.array(F.lit(1.0)).alias("vector"))
    scores = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in ("premise_hash", "hypothesis_hash")], F.create_map(F.lit("entailment"), F.lit(1.0)).alias("raw_scores"), F.lit(1).alias("token_count"))
    for df in (
        cited_claims,
        records,
        evidence.match_evidence(cited_claims, records),
        verdicts.replay(spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in ("premise", "hypothesis")]), scores),
        benchmarks.partners(queries._records(spark, sf)),
        benchmarks.controlled(queries._records(spark, sf))[0],
        retrieval.cosine_among(cited, named, vectors, "number"),
    ):
        assert "SortMergeJoin" in plan(df)
        assert "BroadcastHashJoin" not in plan(df)


def test_factorial_cells_keep_the_order_of_lines_with_large_keys(spark, tmp_path):
    """A part's key of over a million must not outweigh the line's number."""
    rows = [(1, 2_000_000, 3, 1), (1, 18, 1, 2)]  # the first line of its item decides; its verdict is a contradiction
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    (cell,) = queries_metrics.factorial_cells(spark, str(tmp_path)).filter("framing = 'labeled'").collect()
    assert (cell["n"], cell["n_detected"]) == (1, 1)


def test_texts_are_parsed_once(spark, sf):
    """Queries that read claims twice, or keys that repeat, have them parsed before the result is read."""
    for query in (queries_workflow.overlap_cases, queries_workflow.new_identities, queries_workflow.claim_counterparts):
        assert "ArrowEvalPython" not in plan(query(spark, sf))


def test_repeated_sentences_are_parsed_once_a_worker():
    before = claims._of_sentence.cache_info().hits
    first, second = (claims._of_sentence("Section 302 of the Indian Penal Code, 1860 prescribes death.") for _ in range(2))
    assert first == second and claims._of_sentence.cache_info().hits == before + 1
    assert claims._of_sentence.cache_info().maxsize  # bounded


def test_folds_exchange_groups_where_no_move_helps(spark):
    """Groups of one size, dealt so that folds differ in labels alone: a move would upset their sizes."""
    groups = spark.createDataFrame([(u, 1 + u % 2, [60.0, 40.0] if u % 2 == 0 else [40.0, 60.0]) for u in range(8)], "u long, fold int, v array<double>")
    totals = bootstrap.np.array([[240.0, 160.0], [160.0, 240.0]])
    assert not [m for m in bootstrap._moves(groups, totals) if m[0] > 1e-12]
    ((u, mine, a, w, theirs, b),) = bootstrap._swaps(groups, totals)
    assert (a, b, u % 2, w % 2) == (1, 2, 0, 1) and list(mine - theirs) == [20.0, -20.0]


def test_near_classes_leave_few_tasks_in_the_driver(spark):
    """Small tables of the near-duplicate step don't run in as many tasks as there are shuffle partitions."""
    rows = [(i, " ".join(f"w{(i % 40) * 100 + k}" for k in range(60)) + (f" x{i}" if i % 3 else "")) for i in range(400)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("near-tasks", "")
        got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("near-tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert {x["class_id"] for x in got} == set(range(40))
    assert tasks < 1800  # 2308 when every small table had all partitions


def test_equal_annotations_meet_claims_once(spark):
    """Claims meet a case's distinct statements and references, and every annotation gets the answer."""
    kinds = "source_row_number long, case_reference string, legal_statement string, legal_reference string"
    asked = [(1, "c", "Rule holds.", "Section 5"), (1, "c", "Rule holds.", "Section 5"), (2, "c", "Rule holds.", None), (3, None, "Rule holds.", "Section 5")]
    fields = ["document_id", "claim_id", "claim_text", "assertion_text", "provision_type", "provision_number", "act_raw", "act_norm", "verifier_model", "verdict", "evidence_match_method", "evidence_id", "evidence_text", "source_file", "source_ord"]
    claim = ("c", "c1", "rule holds.", "", "Section", "5", "the Act, 1950", "act 1950", "m", "ENTAILED", "fuzzy", "E1", "t", "f", "f")
    claims = spark.createDataFrame([claim, claim], ", ".join(f"{c} string" for c in fields))
    got = review.align(spark.createDataFrame(asked, kinds), claims).collect()
    found = sorted((r["source_row_number"], r["num_distinct_statement_matches"], r["num_reference_aligned_matches"], r["n_case_claims"], r["case_found"]) for r in got)
    assert found == [(1, 1, 1, 2, True), (1, 1, 1, 2, True), (2, 1, 0, 2, True), (3, 0, 0, None, False)]


def test_models_are_fitted_on_counted_rows(spark, monkeypatch):
    """Rows that are equal in fold, label and features are one row of the fit."""
    rows = [(i, i % 2 + 1, "ab"[i % 4 // 2], float(i % 8)) for i in range(800)]
    seen, fit = [], learning.fit
    monkeypatch.setattr(learning, "fit", lambda data, *rest: seen.append(data.count()) or fit(data, *rest))
    df = spark.createDataFrame(rows, "id long, fold int, label string, x double")
    got = {r["left_out"]: r["accuracy"] for r in learning.ablations(df, {"x": ([], ["x"])}, "label", "id").collect()}
    told = learning.out_of_fold(df, [], ["x"], "label", "id").collect()
    assert seen == [8, 8] and len(told) == 800
    assert got["all"] == sum(r["label"] == r["predicted"] for r in told) / 800


def test_equal_orders_are_corrected_once(spark, sf, monkeypatch):
    """Orders of one text and proposal are one case of the correction workflow, and each gets its row."""
    seen, correct = [], workflow.correct
    monkeypatch.setattr(workflow, "correct", lambda fields, *rest: seen.append(fields.count()) or correct(fields, *rest))
    fixed = queries_workflow.corrections_by_sentence(spark, sf)
    assert seen == [len(queries_workflow.BY_SENTENCE)]
    assert fixed.count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_parts_are_dealt_out(spark, sf):
    """What is composed of a part is composed by more tasks than read its small file."""
    assert queries._records(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "hashpartitioning(p_partkey" in plan(queries.composed_claims(spark, sf)) and "REPARTITION_BY_NUM" in plan(queries.composed_claims(spark, sf))


def test_small_batches_go_back_together(spark):
    """A scorer is asked for sixteen pairs at a time, in answers of any order, and Spark gets an Arrow batch whole."""
    pairs = spark.createDataFrame([], "id long, premise string, hypothesis string")
    asked, caught = [], []
    held = type("Pairs", (), {"schema": pairs.schema, "mapInPandas": lambda self, run, schema: caught.append(run)})()

    def model(b):
        asked.append(len(b))
        return b["id"].map(lambda i: {"n": float(i)})[::-1]

    verdicts.score_with(held, lambda: model, 16)
    whole = pairs.toPandas().reindex(range(50)).assign(id=range(50))
    got = list(caught[0](iter([whole, whole[:0]])))
    assert asked == [16, 16, 16, 2] and [len(b) for b in got] == [50, 0]
    assert [x["n"] for x in got[0]["raw_scores"]] == [float(i) for i in range(50)]


def test_folds_dont_drift_apart_with_the_number_of_groups(spark, monkeypatch):
    """Many groups of one size whose labels differ by chance: dealing alone, in several parts, keeps folds within a group of each other."""
    monkeypatch.setattr(bootstrap, "ROUNDS", 0)
    monkeypatch.setattr(bootstrap, "_DEALT", 1500, raising=False)
    rows = spark.range(360_000).selectExpr("concat('g', id % 6000) as g", "substr('aabbc', pmod(hash(id), 5) + 1, 1) as y")
    for r in bootstrap.grouped_folds(rows, "g", "y", 5).groupBy("y").pivot("fold", [1, 2, 3, 4, 5]).count().collect():
        assert max(r[1:]) - min(r[1:]) <= 20


def test_claims_are_dealt_out_once(spark, sf):
    """Orders' lines meet in one shuffle, claims in one more a side, without the words that no side reads."""
    assert plan(queries_workflow.claim_extraction(spark, sf)).count("Exchange hashpartitioning") == 2
    for query in (queries_workflow.claim_counterparts, queries_workflow.new_identities):
        text = plan(query(spark, sf))
        assert text.count("Exchange hashpartitioning") == 2
        assert "ExistingRDD" not in text and "claim_text" not in text


def test_counterparts_of_sides_of_unlike_size(spark):
    """Claims meet their counterparts though one side's partitions are put together and the other's aren't; a null document has none."""
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    citation = "named_struct('provision_type', 'Section', 'provision_number', cast(id % 2 as string), 'subsection', null, 'act_raw', repeat('a', 40), 'act_norm', 'a') as citation"
    before = spark.range(120_000).selectExpr("if(id < 6, null, id div 6) as document_id", "concat('c', id % 6 + 1) as claim_id", "int(id % 6 + 1) as claim_ord", citation, "map('x', rand()) as raw_scores")
    after = before.filter("document_id is null or document_id % 97 = 0").filter("claim_ord > 1").drop("raw_scores")
    try:
        for k, v in zip(keep, ("24", "32k", "false"), strict=True):
            spark.conf.set(k, v)
        got = gates.counterparts(before, after)
        assert got.columns == [*before.columns, "identity", "ordinal", "new_citation", "new_claim_id"]
        rows = got.select("document_id", "claim_id", "new_claim_id").collect()
        assert got.repartition(1).filter("new_claim_id is not null").count() == sum(r["new_claim_id"] is not None for r in rows)
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 120_000
    found = {(r["document_id"], r["claim_id"]): r["new_claim_id"] for r in rows if r["new_claim_id"]}
    want = {"c1": "c3", "c2": "c2", "c3": "c5", "c4": "c4", "c6": "c6"}  # without the first, the third is the first of its identity
    assert found == {(d, a): b for d in range(1, 20_000) if d % 97 == 0 for a, b in want.items()}
