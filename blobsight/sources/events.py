"""Events by topic: schemas, keys and strict validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MATCH = "struct<cve_id: string, confidence_tier: string, similarity_score: double, matched_via: string, llm_rationale: string>"
# Fields of each topic's events.
SCHEMAS = {
    "firmware.uploaded": "job_id string, s3_key string, uploaded_by string, uploaded_at timestamp",
    "firmware.triaged": "job_id string, sha256 string, is_duplicate boolean, size_bytes long",
    "firmware.extracted": "job_id string, sub_blob_id string, s3_key string, parent_blob_id string",
    "firmware.analyzed": "job_id string, sub_blob_id string, strings_found array<string>, entropy_sections array<struct<offset: long, entropy: double, flagged_packed: boolean>>, version_candidates array<struct<vendor: string, product: string, version: string>>, secrets_flagged array<struct<type: string, context: string>>, hardening_flags struct<nx: boolean, pie: boolean, relro: string, canary: boolean>",
    "firmware.matched": f"job_id string, sub_blob_id string, cve_matches array<{MATCH}>",
    "firmware.completed": "job_id string, status string, report_s3_key string, sbom_s3_key string",
    "firmware.dlq": "original_topic string, payload string, error string, failed_at timestamp",
}
OPTIONAL = ("parent_blob_id",)
BY_SUB_BLOB = ("firmware.extracted", "firmware.analyzed", "firmware.matched")


def schema(topic: str) -> StructType:
    if topic not in SCHEMAS:
        raise ValueError(f"unknown topic {topic}")
    return StructType.fromDDL(SCHEMAS[topic])


def sha256_ok(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).rlike("^[0-9a-f]{64}$"), F.lit(False))


def partition_key(topic: Column, job_id: Column, sub_blob_id: Column) -> Column:
    """Fan-out topics go by sub-blob, all others by job."""
    return F.when(topic.isin(*BY_SUB_BLOB), sub_blob_id).otherwise(job_id)


def message_key(key: Column, value: Column) -> Column:
    """The message's own key, else SHA-256 of its value."""
    return F.coalesce(key, F.sha2(value, 256))


def validated(rows: DataFrame, topic: str, value: str = "value") -> DataFrame:
    """Adds ``event`` (null if invalid) and ``error`` (null if valid) to JSON rows: not an object, an unknown field, a missing
    one, a value of the wrong type, or one out of range. A SHA-256 comes out in lower case, without blanks around it."""
    kind = schema(topic)
    names = [f.name for f in kind]
    keys = F.map_keys(F.from_json(value, "map<string, string>"))
    event = F.from_json(value, kind, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"})
    rows = rows.withColumn("_keys", keys).withColumn("_event", event)
    need = [n for n in names if n not in OPTIONAL]
    e = F.col("_event")
    checks = [
        (F.col("_keys").isNull(), "not a JSON object"),
        (F.size(F.array_except("_keys", F.array(*[F.lit(n) for n in names]))) > 0, "unknown field"),
        (F.size(F.array_except(F.array(*[F.lit(n) for n in need]), "_keys")) > 0, "missing field"),
        (F.array_contains(F.array(*[e[n].isNull() for n in need]), True), "wrong type"),
    ]
    if "sha256" in names:
        checks += [(~sha256_ok(e["sha256"]), "sha256 is not 64 hex digits"), (e["size_bytes"] < 0, "negative size")]
    if "status" in names:
        checks.append((e["status"] != "COMPLETE", "status"))
    if topic == "firmware.matched":
        from blobsight.functions.families import valid_match

        bad = F.exists(e["cve_matches"], lambda m: ~valid_match(m["confidence_tier"], m["matched_via"], m["similarity_score"], m["llm_rationale"]))
        checks.append((bad, "match fields disagree"))
    if topic == "firmware.analyzed":
        sections = F.exists(e["entropy_sections"], lambda s: (s["offset"] < 0) | ~s["entropy"].between(0.0, 8.0))
        checks += [(sections, "entropy out of range"), (~e["hardening_flags"]["relro"].isin("none", "partial", "full"), "relro")]
    error = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        error = F.when(bad, name).otherwise(error)
    if "sha256" in names:
        e = e.withField("sha256", F.lower(F.trim(e["sha256"])))
    rows = rows.withColumn("error", error).withColumn("event", F.when(F.col("error").isNull(), e))
    return rows.drop("_keys", "_event")


def emitted(events: DataFrame, topic: str) -> DataFrame:
    """(key, value, topic): events as JSON messages, as a Kafka sink takes them."""
    sub = F.col("sub_blob_id") if "sub_blob_id" in events.columns else F.lit(None).cast("string")
    job = F.col("job_id") if "job_id" in events.columns else F.lit(None).cast("string")
    return events.select(partition_key(F.lit(topic), job, sub).alias("key"), F.to_json(F.struct("*")).alias("value"), F.lit(topic).alias("topic"))


def lint(spark: SparkSession, path: str) -> DataFrame:
    """(topic, error) of sample events, a JSON file named after its topic each: error is null for a good one, ``missing`` for a
    topic without a file."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)[.]json$", 1)
    files = spark.read.text(f"{path.rstrip('/')}/*.json", wholetext=True).select(name.alias("topic"), "value")
    out = files.where(~F.col("topic").isin(*SCHEMAS)).select("topic", F.lit("unknown topic").alias("error"))
    for topic in SCHEMAS:
        out = out.unionAll(validated(files.where(F.col("topic") == topic), topic).select("topic", "error"))
    return out.unionAll(missing_topics(files).select("topic", F.lit("missing").alias("error")))


def missing_topics(samples: DataFrame, column: str = "topic", topics: tuple[str, ...] = tuple(SCHEMAS)) -> DataFrame:
    """Topics without a sample."""
    every = samples.sparkSession.createDataFrame([(t,) for t in topics], f"{column} string")
    return every.join(samples.select(column).distinct(), column, "left_anti")
