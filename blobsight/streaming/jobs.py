"""Streams: idempotent intake, the completion gate, stages and their dead letters, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blobsight.functions import families
from blobsight.operators import corpus, rag
from blobsight.operators.embedding import Embedder, embedded
from blobsight.scratch import materialise
from blobsight.sources.events import message_key, validated
from blobsight.sources.indexes import JobIndexes
from blobsight.sources.stores import merge_slots
from blobsight.sources.tables import MergeTable, replacing
from blobsight.streaming.failures import isolated

WINDOW = "24 hours"


def claimed(messages: DataFrame, window: str = WINDOW) -> DataFrame:
    """The messages (topic, key, value, ts) that come more than ``window`` after the last one let in of their topic and key. State goes with the watermark."""
    rows = messages.withColumn("key", message_key(F.col("key"), F.col("value")))
    if rows.isStreaming:
        one = rows.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", window).groupBy("topic", "key")
        return one.transformWithStateInPandas(Claims(window), outputStructType=rows.schema, outputMode="Append", timeMode="EventTime")
    return first_claims(rows, ["topic", "key"], "ts", window)


def first_claims(rows: DataFrame, keys: list[str], ts: str, window: str = WINDOW) -> DataFrame:
    """The same in batch: a message is let in if none with its keys was let in within ``window`` before it; a refused one
    renews nothing. Equal times count once; a message without a time is let in. Keys are read in order, by leaps from one
    message that is let in to the next."""
    length = pd.Timedelta(window) // pd.Timedelta("1us")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = last = None
        for batch in batches:
            names, column = batch.column("_claim"), batch.column(ts).cast(pa.int64())
            times, kept = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)  # nulls come first
            starts = np.flatnonzero(np.r_[True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(times)], strict=True):
                if names[a].as_py() != of:
                    of, last = names[a].as_py(), None
                at = a + int(kept[a:b].sum())
                if last is not None:
                    at += int(np.searchsorted(times[at:b], last + length, "right"))
                while at < b:  # from one that is let in straight to the next
                    last, kept[at] = int(times[at]), True
                    at += int(np.searchsorted(times[at:b], last + length, "right"))
            yield batch.drop_columns(["_claim"]).filter(pa.array(kept))

    name = F.to_json(F.struct(*[F.col(k).alias(str(i)) for i, k in enumerate(keys)]))  # a null has no field
    return rows.withColumn("_claim", name).repartition("_claim").sortWithinPartitions("_claim", ts).mapInArrow(run, rows.schema)


class Claims(StatefulProcessor):
    """The same in a stream, a batch of it in order of time. A key's state is the last time that was let in, in microseconds."""

    def __init__(self, window: str):
        self.window = pd.Timedelta(window)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("at_us", kind="stable", ignore_index=True)
        last, length = self.last.get()[0] if self.last.exists() else None, self.window // pd.Timedelta("1us")
        kept, before = [], last
        for us in batch.pop("at_us"):
            us = None if pd.isna(us) else int(us)
            kept.append(us is None or last is None or us - last > length)
            if kept[-1] and us is not None:
                last = us
        if last != before:
            self.last.update((last,))
            if before is not None:
                self.handle.deleteTimer((before + length) // 1000 + 1)
            self.handle.registerTimer((last + length) // 1000 + 1)
        if any(kept):
            yield batch[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


class EmitOnce(StatefulProcessor):
    """A job's sets of extracted and matched sub-blobs, whether all are out, and whether it has been finished. Sets, not
    counters: events that come again, or late, change nothing, and a job completes once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "topic string, id string", "n int")
        self.flags = handle.getValueState("flags", "marker boolean, finished boolean, extracted int, matched int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        marker, finished, extracted, matched = self.flags.get() if self.flags.exists() else (False, False, 0, 0)
        for batch in rows:
            for topic, sub in zip(batch["topic"], batch["sub_blob_id"], strict=True):
                if finished:
                    continue
                if topic == "extraction_complete":
                    marker = True
                elif topic in ("extracted", "matched") and not self.seen.containsKey((topic, str(sub))):
                    self.seen.updateValue((topic, str(sub)), (1,))
                    extracted, matched = extracted + (topic == "extracted"), matched + (topic == "matched")
        ready = bool(marker and extracted > 0 and matched >= extracted and not finished)
        if ready:
            finished = True
            self.seen.clear()
        self.flags.update((bool(marker), bool(finished), int(extracted), int(matched)))
        if ready:
            yield pd.DataFrame({"job_id": [key[0]], "total": [extracted], "status": ["COMPLETE"]})

    def close(self) -> None:
        pass


def completions(events: DataFrame) -> DataFrame:
    """One row for each job of the stream ``events`` (job_id, topic, sub_blob_id), when its last sub-blob has been matched."""
    return events.groupBy("job_id").transformWithStateInPandas(EmitOnce(), outputStructType="job_id string, total long, status string", outputMode="Append", timeMode="None")


def split(messages: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Valid events, and the dead letters of all others; a bad message never holds up the rest."""
    rows = validated(messages, topic)
    good = rows.where("error is null").select("event.*")
    return good, _letters(rows.where("error is not null"), topic)


def _letters(rows: DataFrame, topic: str) -> DataFrame:
    return rows.select(F.lit(topic).alias("original_topic"), F.col("value").alias("payload"), "error", F.current_timestamp().alias("failed_at"))


def run_stage(messages: DataFrame, topic: str, stage: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str):
    """A stage as a streaming query: each micro-batch is validated and split, results and dead letters go to their tables, in a
    folder (and column) ``batch`` by its number. A batch that is tried again after a failure writes over what it left.
    Messages with which the stage fails become dead letters with its error, and the rest goes on; the stage maps events on
    their own, then. ``availableNow`` suits an external scheduler."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            good, bad = split(batch, topic)
            put = lambda rows: rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
            try:
                put(stage(good))
            except Exception:  # whatever the stage raises: told apart by rows below, or raised again
                sound = validated(batch, topic).where("error is null").drop("event", "error")
                done: list[DataFrame] = []
                failed = isolated(sound, lambda some: done.append(materialise(stage(split(some, topic)[0]), "stage")))
                put(reduce(DataFrame.unionByName, done) if done else stage(good.limit(0)))
                if failed is not None:
                    bad = bad.unionByName(_letters(failed, topic))
            bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            batch.unpersist()

    return _started(messages, each, checkpoint)


def _started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def source(spark: SparkSession, format: str = "kafka", schema: str | None = None, latest: bool = False, **options: str) -> DataFrame:
    """A stream of messages (topic, key, value, ts): from Kafka, where its connector is there, or from files of these columns. A second
    reader, such as one for progress, is another call with ``latest``: it has its own checkpoint, starts with what is new
    and holds up nobody."""
    reader = spark.readStream.format(format).options(**options)
    if format != "kafka":
        return reader.schema(schema or "topic string, key string, value string, ts timestamp").load()
    rows = reader.option("startingOffsets", "latest" if latest else "earliest").option("failOnDataLoss", str(not latest).lower()).load()
    return rows.select("topic", F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("ts"))


def sink(messages: DataFrame, format: str = "parquet", **options: str) -> None:
    """Emit messages (key, value, topic), as ``emitted`` makes them: to Kafka, or to files by topic."""
    writer = messages.write.format(format).options(**options)
    (writer if format == "kafka" else writer.mode("append").partitionBy("topic")).save()


def slots(stream: DataFrame, table: MergeTable, checkpoint: str, order: str = "updated_at"):
    """Partial results of a stream merged into a table of slots by job: the last write of a slot wins, and a finished job's slots
    stay. A batch rewrites the buckets of its jobs alone, and once, however often it is tried."""
    return _started(stream, lambda batch, n: table.merge(batch, lambda old, new: merge_slots(old, new, order), "slots", n), checkpoint)


#: A job's progress as it is kept from batch to batch.
PROGRESS = "job_id string, extracted long, analyzed long, matched long, events long, marker boolean, last struct<ts: timestamp, topic: string>, status string"


def progress_of(events: DataFrame) -> DataFrame:
    """A row of PROGRESS for each job of ``events`` (job_id, topic, ts): what they add up to. Events without a job are left out."""
    n = lambda t: F.count_if(F.col("topic") == t).alias(t)
    ended = F.max(F.when(F.col("topic") == "dlq", F.struct("ts", F.lit("error").alias("s"))).when(F.col("topic") == "completed", F.struct("ts", F.lit("complete").alias("s"))))["s"]
    return events.where("job_id is not null").groupBy("job_id").agg(n("extracted"), n("analyzed"), n("matched"), F.count("*").alias("events"), F.bool_or(F.col("topic") == "extraction_complete").alias("marker"), F.max(F.struct("ts", "topic")).alias("last"), ended.alias("status"))


def snapshots(progress: DataFrame) -> DataFrame:
    """(job_id, stage, status, matched, total, total_final, progress, percent) as a client is shown it."""
    percent = F.when(F.col("extracted") > 0, F.round(100.0 * F.col("matched") / F.col("extracted"), 1)).otherwise(0.0)
    text = F.concat_ws("/", F.col("matched").cast("string"), F.col("extracted").cast("string"))
    return progress.select("job_id", F.col("last.topic").alias("stage"), F.coalesce("status", F.lit("running")).alias("status"), "matched", F.col("extracted").alias("total"), F.coalesce("marker", F.lit(False)).alias("total_final"), text.alias("progress"), percent.alias("percent"))


def index_completed(stream: DataFrame, reports: DataFrame, indexes: JobIndexes, checkpoint: str, embedder: Embedder | None = None, now: Column | None = None):
    """An index of its report for each job that a stream of firmware.completed events names: its chunks and their embeddings. A
    second completion replaces it."""

    def each(batch: DataFrame, n: int) -> None:
        chunks = rag.index_chunks(reports.join(batch.select("job_id").distinct(), "job_id", "left_semi"))
        indexes.build(chunks.select("job_id", F.sha2("text", 256).alias("id"), "text", embedded(F.col("text"), embedder).alias("embedding")), now)

    return _started(stream, each, checkpoint)


def refreshed(changes: DataFrame, to: MergeTable, checkpoint: str, known=families.FAMILIES, embedder: Embedder | None = None):
    """A corpus kept up to date from a stream of changed records (``nvd.read_paged(streaming=True)``): flattened, embedded where the table
    has embeddings, and merged by (cve_id, cpe_string). Changes that are read again, as windows overlap, change nothing."""

    def each(batch: DataFrame, n: int) -> None:
        new = corpus.records(corpus.latest(batch, ["id"], F.desc_nulls_last("lastModified")), known)
        new = corpus.with_embeddings(new, embedder) if "embedding" in to.schema.names else new
        to.merge(new.select(to.schema.names), replacing(["cve_id", "cpe_string"]), "refresh", n)

    return _started(changes, each, checkpoint)
