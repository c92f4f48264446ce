"""Sources and sinks: JSON lines and arrays, CSV, manifests, resumable outputs, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit import schemas

_BAD = "_corrupt_record"


def _parsed(lines: DataFrame, schema: str, strict: bool) -> DataFrame:
    """Columns of JSON lines (``value``) in place of them; blank lines are skipped."""
    others = [c for c in lines.columns if c != "value"]
    j = F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    parsed = lines.filter(F.trim("value") != "").withColumn("_file", F.input_file_name()).withColumn("_j", j)
    bad = F.col(f"_j.{_BAD}").isNotNull()
    if strict:
        bad = F.when(bad, F.raise_error(F.concat(F.lit("invalid JSON in "), "_file", F.lit(": "), "value")).cast("boolean")).otherwise(F.lit(False))
    return parsed.filter(~bad).select("_j.*", *others).drop(_BAD)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a given schema. A bad line fails the query when read, or, if not strict, is left out."""
    return _parsed(spark.read.text(path), schema, strict)


def bad_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, line, value) of the lines that are no JSON of the schema, lines counted from 1. Reads files whole; for reports of errors."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("at", "value")).filter(F.trim("value") != "")
    j = F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return lines.filter(j[_BAD].isNotNull()).select("file", (F.col("at") + 1).alias("line"), "value")


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a stopped run has written: JSON lines without those that are broken off; nothing if the path isn't there."""
    return read_jsonl(spark, path, schema, strict=False) if existing(spark, [path]) else spark.createDataFrame([], schema)


def with_line_numbers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``line_ord``, a number that follows the order of files and lines."""
    return _parsed(spark.read.text(path).withColumn("line_ord", F.monotonically_increasing_id()), schema, True)


def read_evidence(spark: SparkSession, canonical: str, audit: str, extra: tuple[str, str] | None = None, use_extra: bool = False) -> DataFrame:
    """Usable evidence of a corpus, with a second one laid over it if asked for."""
    from lexaudit.operators import evidence as E

    def one(c: str, a: str) -> DataFrame:
        return E.usable_evidence(with_line_numbers(spark, c, schemas.CANONICAL), read_jsonl(spark, a, schemas.AUDIT))

    base = one(canonical, audit)
    return E.overlay(base, one(*extra)) if use_extra and extra else base


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there, on whatever file system they name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def read_cases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cases of JSON-array files: (document_id, case_text, raw_citation_keys); of sections, keys alone are read."""
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], schemas.CASE)
    raw = spark.read.schema("document_id string, summarized_text string, sections map<string, string>").option("multiLine", True).json(there)
    return raw.select("document_id", F.coalesce("summarized_text", F.lit("")).alias("case_text"), F.coalesce(F.map_keys("sections"), F.array().cast("array<string>")).alias("raw_citation_keys"))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet's rows as strings with ``row_ord``. CSV is read by Spark; a workbook, which is one small
    file on the driver, by pandas where its engine is installed."""
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("row_ord", F.monotonically_increasing_id())
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=sheet or 0, dtype=str)
    frame["row_ord"] = range(len(frame))
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"`{c}` {'long' if c == 'row_ord' else 'string'}" for c in frame.columns))


def read_model_claims(spark: SparkSession, pattern: str) -> DataFrame:
    """Claims of all output files of a pattern but annotation files: one row a claim, with its file."""
    citation = "struct<provision_type: string, provision_number: string, act_raw: string, act_norm: string>"
    claim = (
        f"struct<claim_id: string, claim_text: string, assertion_text: string, citation_extracted: {citation}, extracted_citation: {citation}, evidence_id: string,"
        " evidence_text: string, evidence_match_method: string, verdict: string, confidence: double, verifier_model: string>"
    )
    raw = spark.read.schema(f"document_id string, case_reference string, claims array<{claim}>").json(pattern).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = raw.filter(~F.contains(F.lower("source_file"), F.lit("annotation"))).select(F.coalesce(F.nullif("document_id", F.lit("")), "case_reference").alias("document_id"), "source_file", F.explode("claims").alias("c"))
    cited = F.coalesce("c.citation_extracted", "c.extracted_citation")
    return rows.filter("document_id is not null").select(
        "document_id", "source_file", F.col("source_file").alias("source_ord"), "c.claim_id", F.coalesce("c.claim_text", F.lit("")).alias("claim_text"), F.coalesce("c.assertion_text", F.lit("")).alias("assertion_text"),
        *[cited[f].alias(f) for f in ("provision_type", "provision_number", "act_raw", "act_norm")],
        "c.evidence_id", "c.evidence_text", "c.evidence_match_method", "c.verdict", "c.confidence", "c.verifier_model",
    )


def read_texts(spark: SparkSession, sources: list[tuple[str, str | None]]) -> DataFrame:
    """Generated texts of an ordered list of (file, name of a nested block or none): document_id, text, source_ord."""
    out = None
    for i, (path, block) in enumerate(sources):
        inner = "generated_field struct<text: string>"
        raw = spark.read.schema(f"document_id string, {f'`{block}` struct<{inner.replace(" ", ": ", 1)}>' if block else inner}").json(path)
        one = raw.select("document_id", F.col(f"{f'`{block}`.' if block else ''}generated_field.text").alias("text"), F.lit(i).alias("source_ord"))
        out = one if out is None else out.unionByName(one)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def manifest(spark: SparkSession, root: str, expected: list[str]) -> DataFrame:
    """(path, present, size, sha256) of expected files under a folder; missing ones stay listed."""
    want = spark.createDataFrame([(p,) for p in expected], "path string")
    base = root.rstrip("/")
    there = existing(spark, [f"{base}/{p}" for p in expected])
    if not there:
        return want.select("path", F.lit(False).alias("present"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("sha256"))
    files = spark.read.format("binaryFile").load(there).select(F.col("path").alias("_p"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    joined = want.join(files, F.endswith("_p", F.concat(F.lit(f"{base.split(':', 1)[-1].rstrip('/')}/"), F.col("path"))), "left")
    return joined.select("path", F.col("_p").isNotNull().alias("present"), "size", "sha256")


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key isn't among what a stopped run has written."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def rederived_differences(stored: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, problem): rows that are absent on a side or differ in a column."""
    a = stored.select(F.col(key).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = derived.select(F.col(key).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    problem = F.when(F.col("_b").isNull(), "not rederived").when(F.col("_a").isNull(), "not stored")
    for c in columns:
        problem = problem.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(f"{c} differs"))
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), problem.alias("problem")).filter("problem is not null")


def quality_checks(df: DataFrame, key: str, required: list[str], domains: dict[str, list[str]] | None = None, n_rows: int | None = None) -> DataFrame:
    """(check, level, n) in one pass over the rows and one over the keys: fail, warn or ok."""
    counts = [F.count(F.lit(1)).alias("rows")] + [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"missing {c}") for c in required]
    counts += [F.count_if(~F.col(c).isin(*v)).alias(f"unknown {c}") for c, v in (domains or {}).items()]
    one = df.agg(*counts)
    names = [c for c in one.columns if c != "rows"]
    listed = [F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("n"), F.when(F.col(f"`{c}`") > 0, "fail").otherwise("ok").alias("level")) for c in names]
    if n_rows is not None:
        listed.append(F.struct(F.lit("rows").alias("check"), F.col("rows").alias("n"), F.when(F.col("rows") != n_rows, "warn").otherwise("ok").alias("level")))
    found = one.select(F.explode(F.array(*listed)).alias("x")).select("x.check", "x.level", "x.n") if listed else None
    repeated = df.groupBy(key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"repeated {key}").alias("check"), F.when(F.col("n") > 0, "fail").otherwise("ok").alias("level"), "n")
    return repeated if found is None else found.unionByName(repeated)


def close_enough(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Numbers within the tolerance, or equal; nulls equal each other."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) < tolerance, F.lit(False))
