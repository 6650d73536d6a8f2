"""Progress of jobs kept as a stream's state, and mailboxes that hold the last snapshot only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blobsight.scratch import materialise
from blobsight.sources.tables import MergeTable, replacing
from blobsight.streaming.jobs import _started, snapshots

#: A job's row: what its events add up to, as ``jobs.progress_of`` has it. ``events`` numbers the job's snapshots.
FOLDED = "job_id string, extracted long, analyzed long, matched long, events long, marker boolean, last struct<ts: timestamp, topic: string>, status string"
ENDED = {"dlq": "error", "completed": "complete"}
COUNTED = ("extracted", "analyzed", "matched")


class Fold(StatefulProcessor):
    """A job's counts, its last event and its end. Sub-blobs are kept by topic, so an event that comes again counts once; times
    decide which event is last, so the order in which events come does not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "topic string, id string", "n int")
        self.sums = handle.getValueState("sums", "extracted long, analyzed long, matched long, events long, marker boolean, last_ts timestamp, last_topic string, ended_ts timestamp, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums = self.sums.get() if self.sums.exists() else (0, 0, 0, 0, False, None, None, None, None)
        counts, events, marker = dict(zip(COUNTED, map(int, sums[:3]), strict=True)), int(sums[3]), bool(sums[4])
        last, ended = tuple(sums[5:7]), tuple(sums[7:9])
        before = events
        for batch in rows:
            for topic, sub, ts in zip(batch["topic"], batch["sub_blob_id"], batch["ts"], strict=True):
                # an event without a sub-blob stands for itself by its time
                of = (str(topic), str(sub) if not pd.isna(sub) else f"at {ts}")
                if self.seen.containsKey(of):
                    continue
                self.seen.updateValue(of, (1,))
                events += 1
                if topic in counts:
                    counts[topic] += 1
                marker |= topic == "extraction_complete"
                at = (ts.to_pydatetime() if hasattr(ts, "to_pydatetime") else ts, topic)
                if last[0] is None or at > last:
                    last = at
                if topic in ENDED and (ended[0] is None or at[0] > ended[0] or at[0] == ended[0] and ENDED[topic] > ended[1]):
                    ended = (at[0], ENDED[topic])
        if events == before:
            return
        self.sums.update((*counts.values(), events, bool(marker), *last, *ended))
        yield pd.DataFrame([{"job_id": key[0], **counts, "events": events, "marker": bool(marker), "last": {"ts": last[0], "topic": last[1]}, "status": ended[1]}])

    def close(self) -> None:
        pass


def folded(events: DataFrame) -> DataFrame:
    """A row of FOLDED for each job of the stream ``events`` (job_id, topic, sub_blob_id, ts) and micro-batch that brought it something
    new. Events without a job are left out. Needs the RocksDB state store."""
    rows = events.where("job_id is not null").select("job_id", "topic", "sub_blob_id", "ts")
    return rows.groupBy("job_id").transformWithStateInPandas(Fold(), outputStructType=FOLDED, outputMode="Update", timeMode="None")


def table(spark, path: str, buckets: int = 64) -> MergeTable:
    return MergeTable(spark, path, FOLDED, ["job_id"], buckets=buckets)


def progress(events: DataFrame, to: MergeTable, checkpoint: str):
    """The stream of folded progress merged into a table, one row a job: what is written follows the jobs that moved."""
    return _started(folded(events), lambda batch, n: to.merge(batch, replacing(["job_id"], "events"), "progress", n), checkpoint, "update")


class Mailboxes:
    """What subscribers have read, by job. A mailbox holds one snapshot, the last: those that came and went unread are counted.
    ``read`` is a table (subscriber, job_id, events, dropped)."""

    SCHEMA = "subscriber string, job_id string, events long, dropped long"

    def __init__(self, jobs: MergeTable, path: str, buckets: int = 16):
        self.jobs = jobs
        self.read = MergeTable(jobs.spark, path, self.SCHEMA, ["subscriber", "job_id"], buckets=buckets)

    def subscribe(self, wanted: DataFrame) -> None:
        """``wanted`` (subscriber, job_id): from now on; the last snapshot known is in the mailbox at once, and counts as the first.
        One that is subscribed already stays where it is."""
        now = self.jobs.read().select("job_id", "events")
        rows = wanted.select("subscriber", "job_id").distinct().join(now, "job_id", "left")
        rows = rows.select("subscriber", "job_id", F.coalesce(F.col("events") - 1, F.lit(0)).cast("long").alias("events"), F.lit(0).cast("long").alias("dropped"))
        new = rows.join(self.read.read(), ["subscriber", "job_id"], "left_anti")
        self.read.merge(new, replacing(["subscriber", "job_id"]))

    def unsubscribe(self, gone: DataFrame) -> None:
        """``gone`` (subscriber, job_id)."""
        keys = ["subscriber", "job_id"]
        self.read.merge(gone.select(*keys, F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("dropped")), lambda old, out: old.join(out, keys, "left_anti"))

    def unread(self, subscriber: str | None = None) -> DataFrame:
        """Snapshots that wait, with ``subscriber`` and ``dropped``: how many this one took the place of."""
        own = self.read.read() if subscriber is None else self.read.get(subscriber)
        own = own.select("subscriber", "job_id", F.col("events").alias("until"))
        rows = self.jobs.read().join(own, "job_id").where(F.col("events") > F.col("until"))
        shown = snapshots(self.jobs.read())
        return shown.join(rows.select("subscriber", "job_id", (F.col("events") - F.col("until") - 1).alias("dropped"), "events"), "job_id")

    def take(self, subscriber: str) -> DataFrame:
        """The same for one subscriber, whose mailbox is empty afterwards."""
        found = materialise(self.unread(subscriber), "unread")
        moved = found.select("subscriber", "job_id", "events", "dropped")

        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.unionByName(new).groupBy("subscriber", "job_id")
            return both.agg(F.max("events").alias("events"), F.sum("dropped").alias("dropped"))

        self.read.merge(moved, how)
        return found.drop("events")
