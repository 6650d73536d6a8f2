"""Indexes of jobs with a time to live: folders by the hour in which they end, dropped whole."""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blobsight.operators.rag import TTL_SECONDS, alive
from blobsight.scratch import files, materialise

HOUR = 3600


def seconds(at: datetime) -> float:
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()


class JobIndexes:
    """Chunks of jobs (job_id, id, text, embedding, created_at) under ``path``, in folders expires=<hour>/job_id=<job>: an index that
    is built at some time ends ``ttl`` seconds later, in the hour (since 1970) of its folder. Readers prune hours that are over
    and filter the one that is running; a sweep drops past hours by their folders, without a look into them."""

    SCHEMA = "id string, text string, embedding array<float>, created_at timestamp, expires long, job_id string"

    def __init__(self, spark: SparkSession, path: str, ttl: int = TTL_SECONDS):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl

    def _folders(self, path: str, start: str) -> list[str]:
        fs, at = files(self.spark, path)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.startswith(start))

    def hours(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self._folders(self.path, "expires="))

    def _drop(self, path: str) -> bool:
        fs, at = files(self.spark, path)
        return fs.exists(at) and fs.delete(at, True)

    def build(self, chunks: DataFrame, now: Column | None = None) -> None:
        """(Re)build the indexes of the jobs in ``chunks`` (job_id, id, text, embedding): an older one of the same job goes."""
        now = now if now is not None else F.current_timestamp()
        rows = chunks.select("job_id", "id", "text", F.col("embedding").cast("array<float>").alias("embedding"), now.cast("timestamp").alias("created_at"))
        rows = rows.withColumn("expires", F.floor((F.unix_seconds("created_at") + self.ttl) / HOUR).cast("long"))
        rows = rows.repartition("expires", "job_id").persist()
        try:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("expires", "job_id").parquet(self.path)
            # only hours that still run are looked through for older indexes of the same jobs
            written = rows.select("job_id", "expires").distinct().collect()
        finally:
            rows.unpersist()
        for hour in self.hours():
            there = set(self._folders(f"{self.path}/expires={hour}", "job_id="))
            for r in written:
                if r["expires"] != hour and f"job_id={r['job_id']}" in there:
                    self._drop(f"{self.path}/expires={hour}/job_id={r['job_id']}")

    def read(self, now: datetime) -> DataFrame:
        """Rows of the indexes that are alive at ``now``; of one job by a filter, which is one on folders."""
        if not self.hours():
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(self.path)
        rows = rows.where(F.col("expires") >= math.floor(seconds(now) / HOUR))
        return alive(rows, F.timestamp_micros(F.lit(int(seconds(now) * 1_000_000))), self.ttl)

    def teardown(self, job_id: str) -> bool:
        """Drop a job's index; whether there was one."""
        return any([self._drop(f"{self.path}/expires={hour}/job_id={job_id}") for hour in self.hours()])

    def sweep(self, now: datetime) -> list[str]:
        """Drop what has ended by ``now`` and give its jobs: past hours whole, and of the hour that is running the jobs that are over."""
        current, gone = math.floor(seconds(now) / HOUR), []
        for hour in self.hours():
            at = f"{self.path}/expires={hour}"
            if hour < current:
                gone += [n.partition("=")[2] for n in self._folders(at, "job_id=")]
                self._drop(at)
            elif hour == current:
                rows = self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(at)
                ends = rows.groupBy("job_id").agg(F.max("created_at").alias("created_at"))
                over = ends.join(alive(ends, F.timestamp_micros(F.lit(int(seconds(now) * 1_000_000))), self.ttl).select("job_id"), "job_id", "left_anti")
                for r in over.select("job_id").collect():  # jobs of one hour
                    gone.append(r["job_id"])
                    self._drop(f"{at}/job_id={r['job_id']}")
        return sorted(gone)


class BucketIndexes(JobIndexes):
    """The same for many jobs: folders expires=<hour>/bucket=<bucket>, a job in the bucket of its hash, so that files grow with the hours
    and not with the jobs. A build or a sweep rewrites the buckets of an hour that hold jobs it replaces or ends, and no others.
    Chunks without a job or a time are left out: they never were alive. One writer at a time."""

    SCHEMA = "id string, text string, embedding array<float>, created_at timestamp, job_id string, expires long, bucket int"

    def __init__(self, spark: SparkSession, path: str, ttl: int = TTL_SECONDS, buckets: int = 16):
        super().__init__(spark, path, ttl)
        self.buckets = buckets

    def _bucket(self, job: Column) -> Column:
        return F.pmod(F.xxhash64(job), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        if not self.hours():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(self.path)

    def _without(self, jobs: DataFrame, rows: DataFrame, new: DataFrame | None = None) -> None:
        """Rewrite what of ``rows`` (of this table) is in a folder with one of ``jobs``, without these, and with ``new`` rows."""
        places = rows.join(jobs, "job_id", "left_semi").select("expires", "bucket").distinct()
        places = materialise(places if new is None else places.unionAll(new.select("expires", "bucket")).distinct(), "places")
        kept = rows.join(F.broadcast(places), ["expires", "bucket"], "left_semi").join(jobs, "job_id", "left_anti").select(*self._names())
        kept = materialise(kept if new is None else kept.unionAll(new.select(*self._names())), "kept")  # read before its folders are overwritten
        self._put(kept)
        for r in places.join(kept.select("expires", "bucket").distinct(), ["expires", "bucket"], "left_anti").collect():  # folders, not jobs
            self._drop(f"{self.path}/expires={r['expires']}/bucket={r['bucket']}")

    def _put(self, rows: DataFrame) -> None:
        rows.repartition("expires", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("expires", "bucket").parquet(self.path)

    def _names(self) -> list[str]:
        return [x.split()[0] for x in self.SCHEMA.split(", ")]

    def build(self, chunks: DataFrame, now: Column | None = None) -> None:
        """(Re)build the indexes of the jobs in ``chunks`` (job_id, id, text, embedding): an older one of the same job goes."""
        now = now if now is not None else F.current_timestamp()
        rows = chunks.select("job_id", "id", "text", F.col("embedding").cast("array<float>").alias("embedding"), now.cast("timestamp").alias("created_at"))
        rows = rows.where("job_id is not null and created_at is not null").withColumn("bucket", self._bucket(F.col("job_id")))
        new = materialise(rows.withColumn("expires", F.floor((F.unix_seconds("created_at") + self.ttl) / HOUR).cast("long")), "chunks")
        if self.hours():
            self._without(new.select("job_id").distinct(), self._rows(), new)
        else:
            self._put(new.select(*self._names()))

    def read(self, now: datetime, job_id: str | None = None) -> DataFrame:
        """Rows of the indexes that are alive at ``now``; of one job from its buckets alone."""
        rows = super().read(now)
        return (rows if job_id is None else rows.where((F.col("bucket") == self._bucket(F.lit(job_id))) & (F.col("job_id") == job_id))).drop("bucket")

    def teardown(self, job_id: str) -> bool:
        """Drop a job's index; whether there was one."""
        own = self._rows().where(F.col("bucket") == self._bucket(F.lit(job_id)))
        there = bool(own.where(F.col("job_id") == job_id).head(1))
        if there:
            self._without(self.spark.createDataFrame([(job_id,)], "job_id string"), own)
        return there

    def sweep(self, now: datetime) -> DataFrame:
        """Drop what has ended by ``now`` and give its jobs (job_id) as a table: past hours whole, and of the hour that is running the
        jobs that are over."""
        current, at = math.floor(seconds(now) / HOUR), F.timestamp_micros(F.lit(int(seconds(now) * 1_000_000)))
        past, rows = self._rows().where(F.col("expires") < current), self._rows().where(F.col("expires") == current)
        ends = rows.groupBy("job_id").agg(F.max("created_at").alias("created_at"))
        over = materialise(ends.join(alive(ends, at, self.ttl).select("job_id"), "job_id", "left_anti").select("job_id"), "over")
        gone = materialise(past.select("job_id").unionAll(over).distinct(), "gone")
        if over.head(1):
            self._without(over, rows)
        for hour in self.hours():
            if hour < current:
                self._drop(f"{self.path}/expires={hour}")
        return gone
