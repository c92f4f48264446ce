"""Queries of streams over the standard tables, and of what is served of a run.

Events are cut into files in a shuffled order, some of them twice; a stream reads them a few at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.operators import gates, verdicts
from lexaudit.plans.queries import ORACLE_SQL, query
from lexaudit.session import scratch, table
from lexaudit.streaming import machine, sink, stages

_FILES = 12
_LONG = "3650 days"
_EVENTS = "run_id long, seq long, ts timestamp, stage string, status string"


def run_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stage = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "run").otherwise("claims")
    return e.select(F.col("user_id").cast("long").alias("run_id"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), stage.alias("stage"), F.lit("complete").alias("status"))


def shuffled_stream(spark: SparkSession, events: DataFrame) -> DataFrame:
    """A stream of the events from files in an order of their own; every third event is in two files."""
    path = scratch(spark, "events-in")
    places = F.when(F.xxhash64("seq") % 3 == 0, F.array(F.pmod(F.xxhash64("seq"), F.lit(_FILES)), F.pmod(F.xxhash64("seq", F.lit(7)), F.lit(_FILES)))).otherwise(F.array(F.pmod(F.xxhash64("seq"), F.lit(_FILES))))
    dealt = events.withColumn("file", F.explode(places))
    dealt.repartitionByRange(_FILES, "file").drop("file").write.parquet(path)
    return spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 4).parquet(path)


@query(ORACLE_SQL["stage_state_batch"])
def stage_state_stream(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "states")
    states = machine.machine_states(shuffled_stream(spark, run_events(spark, d)).withColumn("run_id", F.col("run_id").cast("string")), lateness=_LONG)
    with machine.state_store(spark):
        run = states.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "states-log")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    last = machine.latest_states(spark.read.schema(machine.STATES).parquet(out))
    return last.select(F.col("run_id").cast(dict(table(spark, d, "events").dtypes)["user_id"]).alias("run_id"), "n_events", "state", "first_bad_seq")


@query("""SELECT user_id::BIGINT AS run_id, event_id::BIGINT AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'run' ELSE 'claims' END AS stage, 'complete' AS status,
'{"data":{"value":' || event_id || '}}' AS data, true AS valid, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS place FROM events""")
def event_sink(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "event-sink")
    events = sink.once(shuffled_stream(spark, run_events(spark, d)), _LONG)
    lines = events.select(F.col("run_id").cast("string").alias("run_id"), "seq", sink.event_line(F.col("stage"), F.lit("completed"), F.struct(F.col("seq").alias("value"))).alias("line"))
    sink.write_events(lines, out, scratch(spark, "event-sink-log")).trigger(availableNow=True).start().awaitTermination()
    parsed = stages.parse_events(sink.read_events(spark, out), "line")
    ordered = parsed.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stage", "status", "data", "valid"))).alias("e"))
    each = ordered.select(F.col("run_id").cast("long").alias("run_id"), F.posexplode("e").alias("at", "x"))
    return each.select("run_id", "x.seq", "x.stage", "x.status", "x.data", "x.valid", (F.col("at") + 1).alias("place"))


@query("""SELECT conv_id, turn, CASE conv_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'keys differ' WHEN 2 THEN 'repeated key' WHEN 3 THEN 'not a JSON object' WHEN 4 THEN 'id too long'
WHEN 5 THEN 'text too long' WHEN 6 THEN 'body too large or missing' ELSE 'keys differ' END AS problem FROM conversations""")
def payload_rules(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    name, text = F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.coalesce("text", F.lit(""))
    body = lambda i, t: F.to_json(F.struct(i.alias("document_id"), t.alias("case_text")))
    kind = F.col("conv_id") % 8
    long = lambda n: F.rpad(F.lit("x"), n, "x")
    bodies = (
        F.when(kind == 0, body(name, F.substring(text, 1, stages.MAX_CHARS)))
        .when(kind == 1, F.to_json(F.struct(name.alias("document_id"))))
        .when(kind == 2, F.concat(F.lit('{"document_id":"a",'), F.substring(body(name, F.lit("t")), 2, 1 << 20)))
        .when(kind == 3, F.concat(F.lit("["), body(name, F.lit("t"))))
        .when(kind == 4, body(long(stages.MAX_ID + 1), F.lit("t")))
        .when(kind == 5, body(name, long(stages.MAX_CHARS + 1)))
        .when(kind == 6, body(name, long(stages.MAX_BYTES)))
        .otherwise(F.to_json(F.struct(name.alias("document_id"), F.lit("t").alias("case_text"), F.lit(1).alias("more"))))
    )
    return c.select("conv_id", "turn", stages.payload_problem(bodies).alias("problem"))


_STATUS = {i: s for i, s in enumerate(gates.ORDER)}
_CASE = "CASE " + " ".join(f"WHEN o_orderkey % {len(_STATUS)} = {i} THEN '{s}'" for i, s in _STATUS.items()) + " END"


def _order_status(spark: SparkSession, d: str) -> DataFrame:
    of = F.create_map(*[F.lit(x) for i, s in _STATUS.items() for x in (i, s)])
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), of[(F.col("o_orderkey") % len(_STATUS)).cast("int")].alias("outcome"))


@query(f"""WITH o AS (SELECT o_orderkey::BIGINT AS o_orderkey, {_CASE} AS outcome FROM orders),
k AS (SELECT *, outcome IN ('not_triggered', 'correction_span_invalid') AS quiet, outcome IN ('corrected', 'correction_failed', 'correction_sibling_regression') AS again FROM o),
l AS (SELECT *, CASE WHEN quiet THEN 'correction:skipped,safety:skipped,recheck:skipped'
  ELSE 'correction:started,correction:complete,safety:started,safety:complete,' || CASE WHEN again THEN 'recheck:started,recheck:complete' ELSE 'recheck:skipped' END || ',safety:complete' END AS events FROM k)
SELECT o_orderkey, place::INT AS place, split_part(split_part(events, ',', place::INT), ':', 1) AS stage, split_part(split_part(events, ',', place::INT), ':', 2) AS status
FROM (SELECT *, unnest(range(1, len(string_split(events, ',')) + 1)) AS place FROM l)""")
def correction_event_rows(spark: SparkSession, d: str) -> DataFrame:
    return _order_status(spark, d).select("o_orderkey", F.posexplode(stages.correction_events(F.col("outcome"))).alias("at", "e")).select("o_orderkey", (F.col("at") + 1).alias("place"), "e.stage", "e.status")


_TITLES = ", ".join(f"'{t}'" for t in gates.TITLES)


@query(f"""WITH o AS (SELECT o_orderkey::BIGINT AS o_orderkey, {_CASE} AS outcome FROM orders),
b AS (SELECT *, CASE outcome WHEN 'not_triggered' THEN 0 WHEN 'correction_span_invalid' THEN 2 WHEN 'correction_structural_span_lost' THEN 3 WHEN 'correction_splice_unavailable' THEN 3
  WHEN 'correction_scope_violation' THEN 4 WHEN 'correction_unauthorized_addition' THEN 5 WHEN 'correction_ordinal_ambiguous' THEN 6 WHEN 'correction_failed' THEN 7 WHEN 'correction_sentence_splice_unavailable' THEN 7
  WHEN 'correction_sibling_regression' THEN 8 ELSE 9 END AS n FROM o)
SELECT o_orderkey, place::INT AS place, CASE WHEN outcome = 'correction_splice_unavailable' AND place = 3 THEN 'Deterministic splice' ELSE ([{_TITLES}])[place::INT] END AS gate,
CASE WHEN outcome <> 'corrected' AND place = n THEN 'BLOCK' ELSE 'PASS' END AS result FROM (SELECT *, unnest(range(1, n + 1)) AS place FROM b)""")
def gate_display(spark: SparkSession, d: str) -> DataFrame:
    return _order_status(spark, d).select("o_orderkey", F.posexplode(gates.gate_rows(F.col("outcome"))).alias("at", "g")).select("o_orderkey", (F.col("at") + 1).alias("place"), F.col("g.name").alias("gate"), "g.result")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def public_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that begin with an underscore don't leave the engine."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_comment").alias("_note") if "o_comment" in table(spark, d, "orders").columns else F.lit("x").alias("_note"), F.lit(1).alias("_rank"))
    return verdicts.drop_private(o)
