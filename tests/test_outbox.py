"""Stages of several outputs: rejects with their reason, batches that are tried again, attempts that were lost."""

from __future__ import annotations

import gzip
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blobsight.sources import leases
from blobsight.streaming import outbox

VALUE = "value string"


def uploaded(job: str) -> str:
    return json.dumps({"job_id": job, "s3_key": f"raw-uploads/{job}/original.bin", "uploaded_by": "me", "uploaded_at": "2024-01-01T00:00:00"})


def triaged(job: str) -> str:
    return json.dumps({"job_id": job, "sha256": "A" * 64 + " ", "is_duplicate": False, "size_bytes": 9})


def told(box, table="messages", schema=outbox.MESSAGES):
    return [r.asDict() for r in box.read(table, schema).collect()]


def test_a_batch_is_committed_once(spark, tmp_path, monkeypatch):
    box = outbox.Outbox(spark, str(tmp_path))
    rows = lambda x: {"messages": spark.createDataFrame([("k", x, "t1"), ("k", x, "t2")], outbox.MESSAGES)}
    assert box.read().count() == 0
    assert box.commit(rows("a"), "w", 0) and not box.commit(rows("again"), "w", 0) and box.commit(rows("b"), "v", 0)
    real = leases.publish
    with monkeypatch.context() as m:
        m.setattr(outbox, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            box.commit(rows("lost"), "w", 1)
    assert Counter(r["value"] for r in told(box)) == {"a": 2, "b": 2} and box.read().where("topic = 't1'").count() == 2
    assert box.clean() == 1 and box.clean() == 0
    with monkeypatch.context() as m:  # another attempt of the same batch is first
        m.setattr(outbox, "publish", lambda *a: (real(a[0], a[1], json.dumps({"folder": "data/other", "tables": {}}).encode()), real(*a))[1])
        assert not box.commit(rows("second"), "w", 2)
    assert Counter(r["value"] for r in told(box)) == {"a": 2, "b": 2} and box.commit(rows("c"), "w", 1)


def test_triage_and_unpack_rejects_arrive_with_their_reason(spark, tmp_path):
    good, image = gzip.compress(bytes(range(256)) * 4, mtime=0), b"\x7fELF" + bytes(range(200))
    contents = {"clean": good, "same": good, "short": b"\x7fELF", "odd": b"?" * 99, "elf": image, "bomb": gzip.compress(b"z" * (1 << 20), mtime=0)}
    blobs = spark.createDataFrame([(j, bytearray(x)) for j, x in contents.items()], "job_id string, content binary")
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    src = str(tmp_path / "in")

    def put(*values):
        spark.createDataFrame([(v,) for v in values], VALUE).coalesce(1).write.mode("append").text(src)

    def run(topic, route, values):
        for _ in range(2):  # started again, it finds nothing new
            outbox.run_routed(values, topic, route, box, str(tmp_path / f"cp-{topic}")).awaitTermination(200)

    put(*[uploaded(j) for j in ("clean", "same", "short", "odd", "elf")], "no json", uploaded("none"))
    run("firmware.uploaded", outbox.triage_route(blobs, spark.createDataFrame([], "sha256 string, job_id string")), spark.readStream.text(src))
    letters = {json.loads(x["payload"])["job_id"] if x["payload"][0] == "{" else x["payload"]: x["error"] for x in (json.loads(m["value"]) for m in told(box) if m["topic"] == outbox.DLQ)}
    assert letters == {"same": "duplicate", "short": "too_small", "odd": "unknown_format", "no json": "not a JSON object", "none": "too_small"}
    assert sorted(json.loads(m["value"])["job_id"] for m in told(box) if m["topic"] == "firmware.triaged") == ["clean", "elf"]
    put(uploaded("bomb"), uploaded("again"))
    seen = box.read("hashes", "sha256 string, job_id string")
    more = blobs.unionAll(blobs.where("job_id = 'elf'").select(F.lit("again").alias("job_id"), "content"))
    run("firmware.uploaded", outbox.triage_route(more, seen), spark.readStream.text(src))
    assert [json.loads(m["value"])["error"] for m in told(box) if "again" in m["value"]] == ["duplicate"]

    messages = box.read().where("topic = 'firmware.triaged'").select("value")
    messages.coalesce(1).write.text(str(tmp_path / "triaged"))
    run("firmware.triaged", outbox.unpack_route(blobs), spark.readStream.text(str(tmp_path / "triaged")))
    out = [(m["topic"], json.loads(m["value"])) for m in told(box)]
    assert sorted(v["job_id"] for t, v in out if t == "firmware.extracted") == ["clean", "elf"]
    assert [(json.loads(v["payload"])["job_id"], v["error"]) for t, v in out if t == outbox.DLQ and v["original_topic"] == "firmware.triaged"] == [("bomb", "decompression_ratio")]
    leaves = {r["s3_key"]: bytes(r["content"]) for r in told(box, "leaves", "s3_key string, content binary")}
    assert sorted(leaves.values()) == sorted([bytes(range(256)) * 4, image]) and all(v["s3_key"] in leaves for t, v in out if t == "firmware.extracted")
    assert box.clean() == 0


def test_a_route_that_raises_gives_letters(spark, tmp_path):
    spark.createDataFrame([(triaged(f"j{i}"),) for i in range(40)], VALUE).coalesce(1).write.text(str(tmp_path / "in"))
    box = outbox.Outbox(spark, str(tmp_path / "box"))

    def route(events):
        seen = events.select("job_id", "sha256", F.when(F.col("job_id") == "j11", F.raise_error(F.lit("no j11")).cast("boolean")).otherwise(F.lit(True)).alias("is_duplicate"), "size_bytes")
        return {"messages": outbox.emitted(seen, "firmware.triaged")}

    query = outbox.run_routed(spark.readStream.text(str(tmp_path / "in")), "firmware.triaged", route, box, str(tmp_path / "cp"))
    assert query.awaitTermination(200) and query.exception() is None
    found = [(m["topic"], json.loads(m["value"])) for m in told(box)]
    assert sorted(v["job_id"] for t, v in found if t == "firmware.triaged") == sorted(f"j{i}" for i in range(40) if i != 11)
    assert {v["sha256"] for t, v in found if t == "firmware.triaged"} == {"a" * 64}  # canonical
    assert [(json.loads(v["payload"])["job_id"], "no j11" in v["error"]) for t, v in found if t == outbox.DLQ] == [("j11", True)]
