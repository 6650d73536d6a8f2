"""The merged table: what it writes, what a crash leaves, two writers; progress as state and mailboxes on it."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from blobsight.plans import catalogue
from blobsight.sources import stores, tables
from blobsight.sources.tables import Conflict, MergeTable, replacing
from blobsight.streaming import jobs, progress

SCHEMA = "id long, name string, at long"


def parquet_files(path) -> dict[str, int]:
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows_of(table, number=None):
    return sorted(map(tuple, table.read(number).collect()))


def new(spark, path, buckets=16):
    return MergeTable(spark, str(path), SCHEMA, ["id"], buckets=buckets)


def test_merging_is_that_of_a_dictionary(spark, tmp_path):
    rng, want = random.Random(3), {}
    table = new(spark, tmp_path)
    assert rows_of(table) == [] and table.get(1).count() == 0
    for n in range(8):
        batch = [(rng.randrange(60), f"n{n}", rng.randrange(100)) for _ in range(rng.randrange(30))]
        for i, name, at in batch:
            if i not in want or (at, n) >= (want[i][2], want[i][3]):
                want[i] = (i, name, at, n)
        batch = list({(i, at): (i, name, at) for i, name, at in batch}.values())
        assert table.merge(spark.createDataFrame(batch, SCHEMA), replacing(["id"], "at"), "w", n)
        assert not table.merge(spark.createDataFrame([(1, "again", 10**6)], SCHEMA), replacing(["id"], "at"), "w", n)  # tried twice
    assert rows_of(table) == sorted(x[:3] for x in want.values())
    for i in (0, 7, 59):
        assert [tuple(r) for r in table.get(i).collect()] == [want[i][:3]] if i in want else True
    assert sorted(table._numbers()) == [6, 7]  # older ones are gone


def test_what_is_written_follows_the_batch(spark, tmp_path):
    table = new(spark, tmp_path)
    table.merge(spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(0).cast("long").alias("at")), replacing(["id"]))
    whole = parquet_files(tmp_path)
    table.merge(spark.createDataFrame([(5, "five", 1)], SCHEMA), replacing(["id"]))
    added = {f: n for f, n in parquet_files(tmp_path).items() if f not in whole}
    assert sum(added.values()) < sum(whole.values()) / 8 and table.read().count() == 50_000 and table.get(5).first().name == "five"
    for i in range(6):  # old buckets go, so the folder doesn't grow with the batches
        table.merge(spark.createDataFrame([(5, f"{i}", 2 + i)], SCHEMA), replacing(["id"]))
    assert sum(parquet_files(tmp_path).values()) < 1.4 * sum(whole.values()) and table.read().count() == 50_000


@pytest.mark.parametrize("step", ["write", "commit", "clean"])
def test_a_crash_between_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    table = new(spark, tmp_path)
    table.merge(spark.createDataFrame([(i, "old", 0) for i in range(40)], SCHEMA), replacing(["id"]), "w", 0)

    class Crash(RuntimeError):
        pass

    def fails(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(tables, "publish", fails)  # the new buckets are there, their manifest isn't
        elif step == "commit":
            m.setattr(os, "link", fails)  # the manifest is written, but hasn't its name
        else:
            m.setattr(MergeTable, "_clean", fails)
        with pytest.raises(Crash):
            table.merge(spark.createDataFrame([(i, "new", 1) for i in range(0, 80, 2)], SCHEMA), replacing(["id"]), "w", 1)
    again = new(spark, tmp_path)
    known = rows_of(again)
    assert known in (sorted([(i, "old", 0) for i in range(40)]), sorted([(i, "old", 0) for i in range(1, 40, 2)] + [(i, "new", 1) for i in range(0, 80, 2)]))
    again.merge(spark.createDataFrame([(i, "new", 1) for i in range(0, 80, 2)], SCHEMA), replacing(["id"]), "w", 1)
    assert rows_of(again) == sorted([(i, "old", 0) for i in range(1, 40, 2)] + [(i, "new", 1) for i in range(0, 80, 2)])


def test_of_two_writers_one_has_to_try_again(spark, tmp_path):
    one, two = new(spark, tmp_path), new(spark, tmp_path)
    batch = lambda name: spark.createDataFrame([(1, name, 1), (2, name, 1)], SCHEMA)

    def slowly(old, some):
        two.merge(batch("two"), replacing(["id"]))  # commits while the other one is at work
        return replacing(["id"])(old, some)

    with pytest.raises(Conflict):
        one.merge(batch("one"), slowly)
    assert {r.name for r in one.read().collect()} == {"two"}
    one.merge(batch("one"), replacing(["id"]))
    assert {r.name for r in two.read().collect()} == {"one"} and {r.name for r in two.read(0).collect()} == {"two"}


def test_rows_may_go_and_buckets_must_stay(spark, tmp_path):
    table = new(spark, tmp_path, 4)
    table.merge(spark.createDataFrame([(i, "x", 0) for i in range(10)], SCHEMA), replacing(["id"]))
    table.merge(spark.createDataFrame([(i, "x", 0) for i in range(9)], SCHEMA), lambda old, gone: old.join(gone, "id", "left_anti"))
    assert rows_of(table) == [(9, "x", 0)]
    with pytest.raises(ValueError):
        new(spark, tmp_path, 8).read()


def test_merged_table_as_sql_has_it(spark, sf):
    assert spark_rows(catalogue.queries()["merged_table"](spark, sf)) == duck_rows(catalogue.oracle_sql()["merged_table"], sf)


EVENTS = "job_id string, topic string, sub_blob_id string, ts timestamp"


def test_progress_of_events_that_come_twice_and_out_of_order(spark, tmp_path):
    rng = random.Random(9)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    made, clock = [], 0
    for job in ("a", "b", "c"):
        for topic, n in (("extracted", 12), ("analyzed", 9), ("matched", 7)):
            for i in range(n):
                clock += 1
                made.append((job, topic, f"s{i}", at(clock)))
        made.append((job, "extraction_complete", None, at(clock + 1)))
    made += [("a", "completed", None, at(900)), ("b", "completed", None, at(800)), ("b", "dlq", None, at(850)), (None, "dlq", None, at(1))]
    want = sorted(map(str, jobs.snapshots(jobs.progress_of(spark.createDataFrame(made, EVENTS))).collect()))
    sent = made * 2
    rng.shuffle(sent)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = progress.table(spark, str(tmp_path / "jobs"), 4)
    boxes = progress.Mailboxes(kept, str(tmp_path / "read"))
    boxes.subscribe(spark.createDataFrame([("slow", "a"), ("quick", "a"), ("quick", "b")], "subscriber string, job_id string"))
    taken, dropped = {}, 0
    for part in range(3):
        spark.createDataFrame(sent[part::3], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        progress.progress(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), kept, str(tmp_path / "cp")).awaitTermination(200)
        for r in boxes.take("quick").collect():
            taken[r.job_id], dropped = r.progress, dropped + r.dropped
        assert boxes.unread("quick").count() == 0
    assert sorted(map(str, jobs.snapshots(kept.read()).collect())) == want
    assert taken == {"a": "7/12", "b": "7/12"}
    events = {r.job_id: r.events for r in kept.read().collect()}
    assert events == {"a": 30, "b": 31, "c": 29}  # each event once
    slow = boxes.take("slow").collect()
    assert [(r.job_id, r.progress, r.dropped) for r in slow] == [("a", "7/12", 29)]  # one read, 29 of 30 came and went
    assert boxes.read.read().where("subscriber = 'quick'").agg(F.sum("dropped")).first()[0] == dropped
    boxes.subscribe(spark.createDataFrame([("late", "b"), ("late", "none")], "subscriber string, job_id string"))
    assert [(r.job_id, r.dropped) for r in boxes.take("late").collect()] == [("b", 0)]  # the last one at once
    boxes.unsubscribe(spark.createDataFrame([("late", "b")], "subscriber string, job_id string"))
    assert boxes.read.read().where("subscriber = 'late'").count() == 1


def test_json_reports_take_no_file_a_job(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = lambda a, b, n: spark.range(a, b).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("job_id"), F.array(F.lit(n)).alias("found"))
    stores.put_json(rows(0, 500, 1), path)
    stores.put_json(rows(0, 100, 2), path)
    assert len(list((tmp_path / "reports").rglob("part-*.json"))) < 200  # the 64 buckets of each of two versions
    kept = {r.job_id: r.found for r in stores.get_json(spark, path, "found array<int>, job_id string").collect()}
    assert kept == {(str(i) if i else None): [2 if i < 100 else 1] for i in range(500)}
    assert [tuple(r) for r in stores.get_json(spark, path, "found array<int>, job_id string", "7").collect()] == [([2], "7")]
