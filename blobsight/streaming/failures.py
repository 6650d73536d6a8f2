"""Rows that make work fail are set apart, and replayed later under leases."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blobsight.scratch import materialise
from blobsight.sources.leases import Leases

#: Rows of one batch that may fail, each found by some twenty tries; more are no rows' fault, and the batch fails as a whole.
MOST_FAILURES = 200
#: Attempts of a replay, the first pause in seconds, doubled each time, and names of leases: jobs share them by hash.
ATTEMPTS, PAUSE, BUCKETS = 5, 0.5, 1024
#: Bits of the number that rows are halved by.
BITS = 62


def reason(error: Exception) -> str:
    """What went wrong, in a line: the error raised in a task, where one was."""
    lines = [x.strip() for x in str(error).splitlines() if re.match(r"\s*[\w.]*(Error|Exception|Exit|Interrupt|StopIteration)\b", x)]
    return (lines[-1] if lines and isinstance(error, PySparkException) else f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")[:500]


def isolated(rows: DataFrame, work: Callable[[DataFrame], object], most: int = MOST_FAILURES, number: Column | None = None) -> DataFrame | None:
    """Do ``work`` on all of ``rows`` but those with which it fails alone; these, with a column ``error``, or None where there are none.

    What fails is halved until the bad rows stand by themselves; so a batch with one of them takes a few tries more, and a
    batch without any takes one. ``work`` maps rows on their own: it may see any part of them, and one that failed half way
    sees its rows again. ``number``, of 0 to 2**62 - 1, says which rows stay together longest (by default any). An error
    without any rows, or with more than ``most``, isn't the rows' fault and is raised.
    """
    rows = materialise(rows.withColumn("_number", number if number is not None else F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)), "tried")
    names = [c for c in rows.columns if c != "_number"]
    bad: list[tuple[int, str]] = []

    def attempt(low: int, bits: int) -> None:
        some = rows.where(F.col("_number").between(low, low + (1 << bits) - 1))
        try:
            work(some.select(names))
            return
        except Exception as e:  # whatever the work raises
            error = e
        if low == 0 and bits == BITS:
            work(rows.select(names).limit(0))
        if not bits or some.limit(2).count() == 1:
            bad.append((low, bits, reason(error)))
            if len(bad) > most:
                raise error
            return
        for part in (low, low + (1 << bits - 1)):
            if not rows.where(F.col("_number").between(part, part + (1 << bits - 1) - 1)).isEmpty():
                attempt(part, bits - 1)

    attempt(0, BITS)
    if not bad:
        return None
    parts = [rows.where(F.col("_number").between(low, low + (1 << bits) - 1)).select(*names, F.lit(error).alias("error")) for low, bits, error in bad]
    return materialise(reduce(DataFrame.unionAll, parts), "failed")


def pauses(attempts: Column | int = ATTEMPTS, first: float = PAUSE) -> Column:
    """Seconds before each further attempt: doubled from ``first``."""
    n = attempts if isinstance(attempts, Column) else F.lit(attempts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.lit(first) * F.pow(F.lit(2.0), i))).otherwise(F.array().cast("array<double>"))


def replay_plan(letters: DataFrame, held: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Adds ``job_id`` and ``action`` to dead letters (original_topic, payload): SKIPPED without a topic or for letters about letters,
    BLOCKED where another one holds the job, by ``held`` (job_id, until: a lease that runs at ``now``), else RETRIED.
    A payload that names no job is one of job ``unknown``."""
    rows = letters.withColumn("job_id", F.coalesce(F.get_json_object("payload", "$.job_id"), F.lit("unknown")))
    own = F.coalesce(F.col("original_topic").isin("firmware.dlq", ""), F.lit(True))
    blocked = F.lit(False)
    if held is not None:
        last = held.groupBy(F.col("job_id").alias("_job")).agg(F.max("until").alias("_until"))
        rows = rows.join(last, rows["job_id"] == last["_job"], "left").drop("_job")
        blocked = F.coalesce(F.col("_until") > (now if now is not None else F.current_timestamp()), F.lit(False))
    return rows.withColumn("action", F.when(own, "SKIPPED").when(blocked, "BLOCKED").otherwise("RETRIED")).drop("_until")


def replay(letters: DataFrame, emit: Callable[[DataFrame], object], leases: Leases, order: str = "failed_at", attempts: int = ATTEMPTS, first: float = PAUSE, sleep: Callable[[float], None] = time.sleep, buckets: int = BUCKETS) -> DataFrame:
    """Emit dead letters (original_topic, payload, ``order``) again, as messages (key, value, topic), and give all of them with
    ``action``: RETRIED once emitted, EXHAUSTED after ``attempts`` failures of their own, BLOCKED where another replay has the
    lease on their job, SKIPPED where there is nothing to do.

    A job has one owner at a time: jobs are dealt to ``buckets`` names by hash, and this replay does what it gets the leases of.
    All letters of a job are emitted, in order. Letters that fail are told from those that don't by halving; they alone are
    tried again, after pauses that double. ``emit`` may see a letter again whose neighbour failed. Leases are renewed on the way;
    letters under one that was lost all the same, after a long stop, are BLOCKED too, whether they were out or not.
    """
    named = replay_plan(letters).withColumn("_bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
    rows = materialise(named.withColumn("_id", F.monotonically_increasing_id()), "letters")
    wanted = [r[0] for r in rows.where("action = 'RETRIED'").select("_bucket").distinct().collect()]  # ``buckets`` at most
    held = {b: lease for b in sorted(wanted) if (lease := leases.acquire(f"replay-{b}"))}
    lost: set[int] = set()

    def keep() -> None:
        """Renew leases with a third of their term gone; those lost to another replay, as after a long stop, are let go."""
        due = leases.clock() + leases.seconds * 2 / 3
        held.update({b: leases.renew(lease) for b, lease in held.items() if lease.until < due})
        lost.update(b for b, lease in held.items() if lease is None)
        for b in lost & set(held):
            del held[b]

    try:
        left = rows.where(F.col("action") == "RETRIED").where(F.col("_bucket").isin(*held) if held else F.lit(False))
        mine = left = materialise(left, "claimed")
        # letters of a job follow each other: halving parts jobs first, then a job's earlier letters from its later ones
        place = F.shiftrightunsigned(F.xxhash64(F.lit(0), F.col("job_id")), 64 - BITS + 24).bitwiseAND((1 << BITS - 24) - 1) * F.lit(1 << 24) + F.least(F.col("_place"), F.lit((1 << 24) - 1))
        for attempt in range(1, attempts + 1):
            if left.isEmpty():
                break
            placed = left.withColumn("_place", F.row_number().over(Window.partitionBy("job_id").orderBy(F.asc_nulls_first(order), "_id")).cast("long"))

            def send(some: DataFrame) -> None:
                keep()
                emit(_messages(some.where(F.col("_bucket").isin(*held) if held else F.lit(False))))

            failed = isolated(placed, send, most=1 << 62, number=place)
            left = failed.drop("error", "_place") if failed is not None else left.where("false")
            if failed is None or attempt == attempts:
                break
            sleep(first * 2 ** (attempt - 1))
            keep()
            left = left.where(~F.col("_bucket").isin(*lost)) if lost else left
        outcome = materialise(left.select("_id", F.lit("EXHAUSTED").alias("became")), "outcome")
    finally:
        for lease in held.values():
            leases.release(lease)
    ours = mine.select("_id", F.lit(True).alias("_mine"))
    done = rows.join(ours, "_id", "left").join(outcome, "_id", "left")
    elsewhere = F.col("_mine").isNull() | (F.col("_bucket").isin(*lost) if lost else F.lit(False))
    action = F.when((F.col("action") == "RETRIED") & elsewhere, "BLOCKED").otherwise(F.coalesce("became", "action"))
    return materialise(done.withColumn("action", action).drop("_id", "_bucket", "_mine", "became"), "replayed")


def _messages(rows: DataFrame) -> DataFrame:
    """Letters as messages, those of a job in one task and in order."""
    keyed = rows.repartition("job_id").sortWithinPartitions("job_id", "_place")
    return keyed.select(F.col("job_id").alias("key"), F.col("payload").alias("value"), F.col("original_topic").alias("topic"))
