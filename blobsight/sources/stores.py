"""Tables and files in place of services: blobs, artifacts, reports, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blobsight.functions import families
from blobsight.operators.corpus import latest
from blobsight.operators.feedback import VERDICTS
from blobsight.sources.tables import MergeTable

# Where a job's files are.
KEYS = {"upload": "raw-uploads/%s/original.bin", "report": "reports/%s/report.json", "sbom": "reports/%s/sbom.json", "sub_blob": "extracted/%s/%s.bin"}


def key(kind: str, *parts):
    return F.format_string(KEYS[kind], *parts)


def read_blobs(spark: SparkSession, path: str, most: int | None = 64 << 20) -> DataFrame:
    """(path, size_bytes, content) of files, the first ``most`` bytes of each."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.col("length").alias("size_bytes"), (F.substring("content", 1, most) if most else F.col("content")).alias("content"))


class Blobs:
    """Contents by key, in a merged table: a key that is put again is replaced, and a few keys are read without the others."""

    SCHEMA = "key string, content binary"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = MergeTable(spark, path, self.SCHEMA, ["key"], buckets=buckets)

    def put(self, rows: DataFrame, writer: str = "", number: int | None = None) -> bool:
        """``rows`` (key, content), each key once; a batch that is put again by its writer and number changes nothing."""
        return self.table.merge(rows.select("key", "content"), lambda old, new: old.join(new, "key", "left_anti").unionByName(new), writer, number)

    def read(self, keys: DataFrame | None = None, most: int | None = 64 << 20) -> DataFrame:
        """(key, size_bytes, content) of all blobs or those of ``keys`` (key), the first ``most`` bytes of each."""
        rows = self.table.read() if keys is None else self.table.read().join(keys.select("key").distinct(), "key", "left_semi")
        body = F.substring("content", 1, most) if most else F.col("content")
        return rows.select("key", F.length("content").cast("long").alias("size_bytes"), body.alias("content"))

    def get(self, key: str, most: int | None = 64 << 20) -> bytes | None:
        """One blob's first bytes; None for a key that isn't there."""
        found = self.table.get(key).select(F.substring("content", 1, most) if most else F.col("content")).first()
        return None if found is None else bytes(found[0])


def put_json(rows: DataFrame, path: str, by: str = "job_id") -> None:
    """Artifacts as JSON, in a table merged by the job's bucket: as many files as buckets, however many jobs. A job that is written
    again is replaced."""

    def how(old: DataFrame, new: DataFrame) -> DataFrame:
        again = new.select(F.col(by).alias("_by")).distinct()
        return old.join(again, F.col(by).eqNullSafe(F.col("_by")), "left_anti").unionByName(new)

    MergeTable(rows.sparkSession, path, rows.schema, [by], kind="json").merge(rows, how)


def get_json(spark: SparkSession, path: str, schema: str, job: str | None = None, by: str = "job_id") -> DataFrame:
    """Artifacts; of one job from its bucket alone."""
    table = MergeTable(spark, path, schema, [by], kind="json")
    return table.read() if job is None else table.get(job)


def merge_slots(old: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """Partial results by (job_id, sub_blob_id): the last write of a slot wins, but a finished job's slots stay as they are."""
    keys = ["job_id", "sub_blob_id"]
    done = old.where("finalized").select("job_id").distinct()
    fresh = new.join(done, "job_id", "left_anti").withColumn("finalized", F.lit(False))
    return latest(old.unionByName(fresh), keys, F.desc(order))


def register_upload(jobs: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the jobs table and firmware.uploaded events for ``jobs`` (job_id, uploaded_by): the object's key follows from the job."""
    rows = jobs.select("job_id", "uploaded_by", key("upload", F.col("job_id")).alias("s3_key"), (now if now is not None else F.current_timestamp()).alias("uploaded_at"))
    table = rows.select("job_id", F.lit("UPLOADED").alias("status"), "uploaded_by", F.col("uploaded_at").alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    return table, rows.select("job_id", "s3_key", "uploaded_by", "uploaded_at")


def get(rows: DataFrame, value, by: str = "job_id") -> DataFrame:
    """Rows of one job, or of one value of another column: a filter that reaches the scan."""
    return rows.where(F.col(by) == value)


def append_feedback(path: str, feedback: DataFrame, now: Column | None = None) -> None:
    """Take up analysts' verdicts (job_id, cve_id, verdict, submitted_by). A verdict that is none of the known ones stops the write."""
    named = ", ".join(VERDICTS)
    checked = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise(F.raise_error(F.lit(f"verdict must be one of {named}")).cast("string"))
    feedback.select("job_id", "cve_id", checked.alias("verdict"), "submitted_by", (now if now is not None else F.current_timestamp()).alias("submitted_at")).write.mode("append").parquet(path)


def current_thresholds(recalibrated: DataFrame | None, spark: SparkSession, known=families.FAMILIES) -> DataFrame:
    """(family, high, possible, low) of every family: what feedback made of them, else the defaults."""
    rows = families.family_table(spark, known).select("family")
    if recalibrated is None:
        return rows.withColumns({"high": F.lit(families.HIGH), "possible": F.lit(families.POSSIBLE), "low": F.lit(families.LOW)})
    rows = rows.join(families.checked_thresholds(recalibrated).select("family", "high", "possible", "low"), "family", "left")
    return rows.select("family", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("high", families.HIGH), ("possible", families.POSSIBLE), ("low", families.LOW))])


def latest_jobs(jobs: DataFrame, most: int = 500) -> DataFrame:
    """The newest jobs; this report has a limit by design."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(most)
