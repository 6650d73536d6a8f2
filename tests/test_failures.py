"""Failing rows set apart, leases, and the replay of dead letters."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from blobsight.sources.leases import Leases
from blobsight.streaming import failures, jobs

LETTERS = "original_topic string, payload string, failed_at timestamp"


def at(minutes: int) -> datetime:
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def letter(job: str | None, i: int, topic: str | None = "firmware.matched") -> tuple:
    return (topic, json.dumps({"job_id": job, "n": i}) if job else f"no object {i}", at(i))


class Sink:
    """Keeps what it is given, in order; fails, before it takes anything, if it is given a payload that ``bad`` names often enough."""

    def __init__(self, bad: dict[str, int] | None = None):
        self.sent, self.bad = [], dict(bad or {})

    def __call__(self, messages) -> None:
        rows = messages.collect()
        for r in rows:
            if self.bad.get(r.value, 0) and len(rows) == 1:
                self.bad[r.value] -= 1
            if self.bad.get(r.value, 0) or any(self.bad.get(x.value, 0) for x in rows):
                raise OSError("no broker")
        self.sent += [(r.key, r.topic, r.value) for r in rows]


def test_one_bad_row_costs_no_other(spark):
    rows = spark.range(1000).withColumn("clash", F.lit("error"))
    seen = []

    def work(some):
        values = [r.id for r in some.select((F.col("id") / F.when(F.col("id") == 417, F.raise_error(F.lit("odd one")).cast("int")).otherwise(1)).cast("long").alias("id")).collect()]
        seen.append(values)

    bad = failures.isolated(rows, work)
    assert [(r.id, "odd one" in r.error) for r in bad.collect()] == [(417, True)]
    assert sorted(x for part in seen for x in part) == [i for i in range(1000) if i != 417] and len(seen) < 40
    assert failures.isolated(rows, lambda some: some.count()) is None


def test_a_broken_stage_is_no_rows_fault(spark):
    with pytest.raises(ZeroDivisionError):
        failures.isolated(spark.range(10), lambda some: 1 / 0)
    with pytest.raises(Exception, match="all bad"):
        failures.isolated(spark.range(50), lambda some: some.select(F.raise_error(F.lit("all bad"))).collect(), most=5)


def test_a_stage_that_raises_gives_letters(spark, tmp_path):
    """Good, malformed and raising messages in one batch: results, and a letter for each of the others; the stream doesn't stop."""
    good = [json.dumps({"job_id": f"j{i}", "status": "COMPLETE", "report_s3_key": "r", "sbom_s3_key": "s"}) for i in range(60)]
    spark.createDataFrame([(v,) for v in [*good, "no json"]], "value string").coalesce(1).write.text(str(tmp_path / "in"))

    def stage(events):
        return events.select(F.when(F.col("job_id") == "j7", F.raise_error(F.lit("cannot read j7")).cast("string")).otherwise(F.col("job_id")).alias("job_id"))

    out, dead = str(tmp_path / "out"), str(tmp_path / "dead")
    for _ in range(2):  # a second run finds nothing new
        query = jobs.run_stage(spark.readStream.text(str(tmp_path / "in")), "firmware.completed", stage, out, dead, str(tmp_path / "cp"))
        assert query.awaitTermination(120) and query.exception() is None
    assert sorted(r.job_id for r in spark.read.parquet(out).collect()) == sorted(f"j{i}" for i in range(60) if i != 7)
    letters = {r.payload: r for r in spark.read.parquet(dead).collect()}
    assert set(letters) == {"no json", good[7]} and "cannot read j7" in letters[good[7]].error and letters[good[7]].original_topic == "firmware.completed"


def test_leases(spark, tmp_path):
    now = [0.0]
    mine, yours = (Leases(spark, str(tmp_path), 30, lambda: now[0]) for _ in range(2))
    one = mine.acquire("job")
    assert one and yours.acquire("job") is None and yours.acquire("other")
    now[0] = 31
    two = yours.acquire("job")  # over, so it is taken over
    assert two and two.token != one.token and mine.renew(one) is None
    mine.release(one)  # frees nobody else's
    assert mine.acquire("job") is None
    three = yours.renew(two)
    now[0] = 60
    assert mine.acquire("job") is None  # renewed till 61
    yours.release(three)
    assert mine.acquire("job")


def test_of_two_claimants_one_gets_the_lease(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    claims = [Leases(spark, str(tmp_path), 30) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        for name in ("a", "b", "c"):
            assert sum(x is not None for x in pool.map(lambda c: c.acquire(name), claims)) == 1  # noqa: B023


def test_all_letters_of_a_job_are_emitted_in_order(spark, tmp_path):
    rows = [letter("a", 2), letter("a", 0), letter("a", 1), letter("b", 0), letter(None, 3), letter("a", 4, "firmware.dlq"), letter("a", 5, None)]
    sink = Sink()
    found = failures.replay(spark.createDataFrame(rows, LETTERS), sink, Leases(spark, str(tmp_path)))
    assert sorted(r.action for r in found.collect()) == ["RETRIED"] * 5 + ["SKIPPED"] * 2
    assert [json.loads(v)["n"] for k, _, v in sink.sent if k == "a"] == [0, 1, 2] and [k for k, _, _ in sink.sent if k not in "ab"] == ["unknown"]
    assert failures.replay(spark.createDataFrame([], LETTERS), sink, Leases(spark, str(tmp_path))).count() == 0


def test_letters_that_fail_are_exhausted_alone(spark, tmp_path):
    rows = [letter("a", i) for i in range(6)] + [letter("b", 0)]
    waits, sink = [], Sink({rows[2][1]: 99, rows[4][1]: 2})
    found = {r.payload: r.action for r in failures.replay(spark.createDataFrame(rows, LETTERS), sink, Leases(spark, str(tmp_path)), sleep=waits.append).collect()}
    assert found == {p: "EXHAUSTED" if p == rows[2][1] else "RETRIED" for _, p, _ in rows}
    assert waits == [0.5, 1.0, 2.0, 4.0] and sorted(v for _, _, v in sink.sent) == sorted(p for _, p, _ in rows if p != rows[2][1])


def test_a_second_claimant_is_blocked(spark, tmp_path):
    now = [0.0]
    other, own = (Leases(spark, str(tmp_path), 30, lambda: now[0]) for _ in range(2))
    rows = spark.createDataFrame([letter("a", 0), letter("a", 1), letter("b", 0)], LETTERS)
    bucket = {r.job_id: r.b for r in failures.replay_plan(rows).select("job_id", F.pmod(F.xxhash64("job_id"), F.lit(failures.BUCKETS)).alias("b")).distinct().collect()}
    lease, sink = other.acquire(f"replay-{bucket['a']}"), Sink()
    actions = lambda df: {(r.job_id, r.action) for r in df.collect()}
    assert actions(failures.replay(rows, sink, own)) == {("a", "BLOCKED"), ("b", "RETRIED")} and len(sink.sent) == 1
    now[0] = 31  # the other one was lost
    assert actions(failures.replay(rows, sink, own)) == {("a", "RETRIED"), ("b", "RETRIED")}
    assert other.renew(lease) is None and own.acquire(f"replay-{bucket['a']}")  # given back


def test_a_lease_that_is_lost_on_the_way_blocks(spark, tmp_path):
    """The replay stands still for longer than its lease; another one takes over; what was left is blocked, not sent."""
    now = [0.0]
    other, own = (Leases(spark, str(tmp_path), 30, lambda: now[0]) for _ in range(2))
    rows = spark.createDataFrame([letter("a", 0)], LETTERS)
    bucket = failures.replay_plan(rows).select(F.pmod(F.xxhash64("job_id"), F.lit(failures.BUCKETS)).alias("b")).first().b
    sink = Sink({letter("a", 0)[1]: 2})

    def stop(_: float) -> None:
        now[0] += 40
        assert other.acquire(f"replay-{bucket}")

    assert [r.action for r in failures.replay(rows, sink, own, sleep=stop).collect()] == ["BLOCKED"] and sink.sent == []
