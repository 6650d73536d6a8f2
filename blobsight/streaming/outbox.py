"""What a stage gives, committed a batch at a time: messages of several topics, and the tables that go with them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobsight.operators import triage as checks
from blobsight.operators.unpack import Extractor, unpack
from blobsight.scratch import files, materialise
from blobsight.sources.events import emitted, validated
from blobsight.sources.leases import publish, read_text
from blobsight.sources.stores import key
from blobsight.streaming.failures import isolated
from blobsight.streaming.jobs import _letters, _started

DLQ = "firmware.dlq"
MESSAGES = "key string, value string, topic string"


class Outbox:
    """Batches of named tables under ``path``. A batch is written aside and then named by one file, its commit, which only one
    attempt can create: readers see all of a batch's tables or none, and a batch that is tried again, once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, tables: dict[str, DataFrame], writer: str, number: int) -> bool:
        """False, and nothing written, where this writer has committed the batch before."""
        fs, at = files(self.spark, f"{self.path}/commits/{writer}-{number}.json")
        if fs.exists(at):
            return False
        folder = f"data/{writer}-{number}-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            out = rows.write.partitionBy("topic") if "topic" in rows.columns else rows.write
            out.parquet(f"{self.path}/{folder}/{name}")
        body = json.dumps({"folder": folder, "tables": {n: t.schema.jsonValue() for n, t in tables.items()}}).encode()
        if publish(self.spark, f"{self.path}/commits/{writer}-{number}.json", body):
            return True
        fs.delete(files(self.spark, f"{self.path}/{folder}")[1], True)
        return False

    def _commits(self) -> list[dict]:
        fs, at = files(self.spark, f"{self.path}/commits")
        names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
        return [json.loads(read_text(self.spark, f"{self.path}/commits/{n}")) for n in names if n.endswith(".json")]

    def read(self, name: str = "messages", schema: str = MESSAGES) -> DataFrame:
        """All committed rows of one table; of one topic by a filter, which is one on folders."""
        folders = [f"{self.path}/{c['folder']}/{name}" for c in self._commits() if name in c["tables"]]
        there = [f for f in folders if files(self.spark, f)[0].exists(files(self.spark, f)[1])]
        if not there:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema)
        return reduce(DataFrame.unionByName, [rows.parquet(f) for f in there])  # each has folders of topics of its own

    def clean(self) -> int:
        """Remove what attempts without a commit have left; for a time when no writer is at work. How many there were."""
        fs, at = files(self.spark, f"{self.path}/data")
        known = {c["folder"].rpartition("/")[2] for c in self._commits()}
        lost = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName() not in known] if fs.exists(at) else []
        for p in lost:
            fs.delete(p, True)
        return len(lost)


#: Takes valid events and gives named tables; ``messages`` (key, value, topic) are what goes on to other stages.
Route = Callable[[DataFrame], dict[str, DataFrame]]


def run_routed(messages: DataFrame, topic: str, route: Route, to: Outbox, checkpoint: str, writer: str | None = None):
    """A stage of several outputs as a streaming query over messages (value): each micro-batch is validated, routed and committed as
    a whole. Malformed messages, and those with which the route fails, are messages of the dead-letter topic."""

    def attempt(rows: DataFrame) -> dict[str, DataFrame]:
        events = validated(rows, topic).where("error is null").select("event.*")
        return {name: materialise(t, "routed") for name, t in route(events).items()}

    def each(batch: DataFrame, number: int) -> None:
        rows = validated(batch.select("value"), topic)
        sound = rows.where("error is null").select("value")
        bad = _letters(rows.where("error is not null"), topic)
        try:
            done = [attempt(sound)]
        except Exception:  # whatever the route raises: told apart by rows, or raised again
            done = []
            failed = isolated(sound, lambda some: done.append(attempt(some)))
            if failed is not None:
                bad = bad.unionByName(_letters(failed, topic))
        tables = {name: reduce(DataFrame.unionByName, [d[name] for d in done]) for name in (done[0] if done else {})}
        letters = emitted(bad, DLQ)
        tables["messages"] = tables["messages"].unionByName(letters) if "messages" in tables else letters
        to.commit(tables, writer or topic, number)

    return _started(messages, each, checkpoint)


def _rejected(events: DataFrame, source: str, reason: str) -> DataFrame:
    """Letters about events that were turned away, with the reason in place of an error."""
    names = [c for c in events.columns if c != reason]
    rows = events.where(F.col(reason).isNotNull())
    return rows.select(F.lit(source).alias("original_topic"), F.to_json(F.struct(*names)).alias("payload"), F.col(reason).alias("error"), F.current_timestamp().alias("failed_at"))


def triage_route(blobs: DataFrame, seen: DataFrame | None = None) -> Route:
    """For firmware.uploaded: contents from ``blobs`` (job_id, content); clean ones are triaged, all others are letters with their
    reason. Contents in ``seen`` (sha256, job_id), of earlier batches, are duplicates. The table ``hashes`` is what to add to it."""

    def route(events: DataFrame) -> dict[str, DataFrame]:
        rows = checks.triage(events.join(blobs.select("job_id", "content"), "job_id", "left"))
        if seen is not None:
            before = seen.groupBy("sha256").agg(F.min("job_id").alias("_by"))
            rows = rows.join(before, "sha256", "left")
            rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("_by") != F.col("job_id"), "duplicate"))).drop("_by")
        clean = rows.where("reason is null").select("job_id", "sha256", F.lit(False).alias("is_duplicate"), "size_bytes")
        letters = _rejected(rows.select(*events.columns, "reason"), "firmware.uploaded", "reason")
        return {"messages": emitted(clean, "firmware.triaged").unionByName(emitted(letters, DLQ)), "hashes": clean.select("sha256", "job_id")}

    return route


def unpack_route(blobs: DataFrame, extractors: tuple[Extractor, ...] = ()) -> Route:
    """For firmware.triaged: contents from ``blobs`` (job_id, content) are unpacked; leaves are extracted, with their contents in the
    table ``leaves`` (s3_key, content), and jobs turned away are letters with the layer of the defence."""

    def route(events: DataFrame) -> dict[str, DataFrame]:
        rows = unpack(events.join(blobs.select("job_id", "content"), "job_id").select("job_id", F.lit("original.bin").alias("path"), "content"), extractors)
        leaves = rows.where("layer is null").withColumn("s3_key", key("sub_blob", F.col("job_id"), F.col("sub_blob_id")))
        turned = events.join(rows.where("layer is not null").select("job_id", "layer"), "job_id")
        letters = _rejected(turned.select(*events.columns, "layer"), "firmware.triaged", "layer")
        done = emitted(leaves.select("job_id", "sub_blob_id", "s3_key", "parent_blob_id"), "firmware.extracted")
        return {"messages": done.unionByName(emitted(letters, DLQ)), "leaves": leaves.select("s3_key", "content")}

    return route
