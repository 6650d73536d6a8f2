"""Operators on small fixtures: what SQL over the tables does not reach."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blobsight.functions import binary, cpe, families, text, vectors
from blobsight.operators import corpus, embedding, matching, rag, report, similarity, static_analysis, triage, unpack
from blobsight.plans import blobs as blob_plans
from blobsight.plans import flows as flow_plans
from blobsight.plans.registry import Tables
from blobsight.plans.stages import Registry, subscriptions
from blobsight.scratch import dealt
from blobsight.sources import events, indexes, nvd, stores, tables
from blobsight.streaming import failures, jobs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def feed():
    def cve(name, criteria, *words):
        return {"cve": {"id": name, "descriptions": [{"lang": "es", "value": "no"}, *[{"lang": "en", "value": w} for w in words]], "configurations": [{"nodes": [{"operator": "OR", "cpeMatch": [{"vulnerable": True, "criteria": c} for c in criteria]}]}]}}

    full = lambda p, v, n, ver: f"cpe:2.3:{p}:{v}:{n}:{ver}:*:*:*:*:*:*:*"
    return [
        cve("CVE-2021-28831", [full("a", "busybox", "busybox", "1.31.1")] * 2, "gzip flaw"),
        cve("CVE-2022-28391", [full("a", "busybox", "busybox", "1.34.0")], "netstat flaw"),
        cve("CVE-2016-2107", [full("a", "openssl", "openssl", "1.0.2")]),
        cve("CVE-2020-0001", [full("o", "microsoft", "windows_10", "1809")], "not ours"),
    ]


def test_feed_to_corpus(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"totalResults": 4, "vulnerabilities": feed()}))
    (tmp_path / "b.json").write_text(json.dumps([x["cve"] for x in feed()]))
    for name in ("a.json", "b.json"):
        rows = corpus.records(nvd.read_json(spark, str(tmp_path / name)))
        found = {r.cve_id: r for r in rows.collect()}
        assert set(found) == {"CVE-2021-28831", "CVE-2022-28391", "CVE-2016-2107"} and rows.count() == 3
        assert found["CVE-2021-28831"].text == "busybox busybox 1.31.1: gzip flaw" and found["CVE-2016-2107"].description == "no"
    again = corpus.upsert(rows, rows)
    assert again.count() == 3 and corpus.metrics(again).count() == 2


def test_paged_scan(spark):
    def fetch_pages(params):
        items = [{"cve": {"id": f"CVE-{i}", "descriptions": [], "configurations": []}} for i in range(23)]
        start, size = params["startIndex"], params["resultsPerPage"]
        return {"totalResults": 23, "vulnerabilities": items[start : start + size]}

    nvd.register_paged(spark, fetch_pages, "feed_for_tests")
    assert nvd.read_paged(spark, "feed_for_tests", resultsPerPage="5").select("id").distinct().count() == 23
    assert nvd.read_paged(spark, "feed_for_tests", resultsPerPage="5", maxRecords="7").count() == 7


def test_cpe_and_versions(spark):
    of = lambda s: one(spark, cpe.parse(F.lit(s)).alias("c")).c
    assert tuple(of("cpe:2.3:a:gnu:zlib:1.2:*:*:*:*:*:*:*")) == ("a", "gnu", "zlib", "1.2")
    assert tuple(of("cpe:/a:gnu:zlib")) == ("a", "gnu", "zlib", "*") and tuple(of("cpe:/o:x:y:3")) == ("o", "x", "y", "3")
    assert of("garbage") is None and of("cpe:2.3:a:b") is None and of("cpe:/a:gnu:") is None and of("cpe:/a") is None
    assert tuple(of("CPE:2.3:A:GNU:ZLib:1.2B")) == ("a", "gnu", "zlib", "1.2B") and tuple(of("CPE:/:GNU:Zlib")) == ("a", "gnu", "zlib", "*")
    version = lambda t, f: one(spark, cpe.extract_version(F.lit(t), F.lit(f)).alias("v")).v
    assert version("BusyBox v1.31.1 (2020)", "busybox") == "1.31.1" and version("OpenSSL 1.0.2h  3 May", "openssl") == "1.0.2h"
    assert version("10.0", None) == "10.0" and version("n/a", None) is None and version("2019.78", "dropbear") == "2019.78"
    part = cpe.normalise(F.lit(" Haxx "), F.lit("Curl"), F.lit("7.1.0"))
    made = one(spark, cpe.candidates(part).alias("c")).c
    assert len(made) == 4 and all(x.startswith("cpe:2.3:a:") and ":7.1.0:" in x for x in made)
    assert one(spark, cpe.candidates(cpe.normalise(F.lit("a"), F.lit("b"), F.lit("n/a"))).alias("c")).c == []


def test_tiers_and_recalibration(spark):
    tiers = spark.createDataFrame([(x,) for x in (0.95, 0.9, 0.89, 0.7, 0.69, 0.5, 0.49, None)], "s double").select(families.tier(F.col("s"))).collect()
    assert [r[0][0] for r in tiers] == list("HHPPLLNN")
    moved = lambda rate: tuple(round(x, 2) for x in one(spark, *[c.alias(n) for c, n in zip(families.recalibrated(F.lit(rate)), "hpl", strict=True)]))
    assert moved(1.0) == (0.95, 0.75, 0.55) and moved(0.0) == (0.87, 0.67, 0.47) and moved(0.25) == (0.9, 0.7, 0.5)


def test_matching_exact_then_similar(spark):
    key = "cpe:2.3:a:busybox:busybox:1.31.1:*:*:*:*:*:*:*"
    near = lambda s: [float(s), float((1 - s * s) ** 0.5)]
    rows = spark.createDataFrame([("CVE-1", key, "busybox", near(0.95)), ("CVE-2", "b", None, near(0.78)), ("CVE-3", "c", None, near(0.55)), ("CVE-4", "d", None, near(0.3)), ("CVE-5", "e", None, None)], "cve_id string, cpe_string string, family string, embedding array<float>")
    cands = spark.createDataFrame([("s1", 0, [key.upper()], None, [1.0, 0.0]), ("s2", 0, ["x"], None, [1.0, 0.0]), ("s3", 0, [key], None, [1.0, 0.0]), ("s3", 1, [], None, [1.0, 0.0])], "sub_blob_id string, seq int, cpes array<string>, family string, v array<double>")
    found = {(r.sub_blob_id, r.cve_id): (r.confidence_tier, r.similarity_score, r.place) for r in matching.match(cands, rows).collect()}
    assert found[("s1", "CVE-1")] == ("CONFIRMED", None, 1) and ("s1", "CVE-2") not in found
    assert {k[1]: v[0] for k, v in found.items() if k[0] == "s2"} == {"CVE-1": "HIGH_CONFIDENCE", "CVE-2": "POSSIBLE", "CVE-3": "LOW_CONFIDENCE"}
    assert found[("s3", "CVE-1")][0] == "CONFIRMED" and found[("s3", "CVE-2")][0] == "POSSIBLE"
    assert matching.match(cands, rows.limit(0)).count() == 0


def test_static_analysis(spark):
    body = b"HelloWorldASCII\0\0\1" + "WideStringLE".encode("utf-16-le") + b"\1\1\1" + "WideStringBE".encode("utf-16-be") + b"\1\1-----BEGIN RSA PRIVATE KEY-----\0password = hunter2\0PATH=/usr/bin\0BusyBox v1.31.1 (2020)\0OpenSSL 1.0.2n\0libcurl/7.68.0\0Dropbear 2019.78\0uClibc 0.9.33\0Linux version 4.14.98\0__stack_chk_fail\0"
    image = blob_plans.elf(True, True, "partial")
    rows = spark.createDataFrame([("j", "text", body), ("j", "elf", image + body), ("j", "sections", os.urandom(65_536) + bytes(65_536)), ("j", "none", None)], "job_id string, sub_blob_id string, content binary")
    found = {r.sub_blob_id: r for r in static_analysis.analyse(rows).collect()}
    assert {"HelloWorldASCII", "WideStringLE", "WideStringBE"} <= set(found["text"].strings_found)
    assert {s.type for s in found["text"].secrets_flagged} == {"private_key_header", "hardcoded_credential"} and len(found["text"].version_candidates) == 6
    assert tuple(found["elf"].hardening_flags) == (True, True, "partial", True) and tuple(found["text"].hardening_flags) == (False, False, "none", True)
    assert [s.flagged_packed for s in found["sections"].entropy_sections] == [True, False]


def test_hardening_of_all_flags():
    for i in range(24):
        want = {"pie": bool(i & 1), "nx": bool(i & 2), "relro": ("none", "partial", "full")[i // 4 % 3]}
        assert binary.hardening_of(blob_plans.elf(want["pie"], want["nx"], want["relro"], i < 12)) == want
    assert binary.hardening_of(blob_plans.elf(True, True, "full")[:70]) == {"nx": False, "pie": True, "relro": "none"}


def test_triage(spark):
    clean = b"\x7fELF" + bytes(252)
    image = bytes.fromhex("27051956") + bytes(8) + (10**6).to_bytes(4) + bytes(60)
    rows = spark.createDataFrame([("a", 1, clean), ("b", 2, clean), ("a", 3, clean), ("c", 4, b"NOTAKNOWNMAGIC" * 9), ("d", 5, b"\x7fELF\0\0"), ("e", 6, image), ("f", 7, None)], "job_id string, uploaded_at int, content binary")
    found = [r.reason for r in triage.triage(rows).orderBy("uploaded_at").collect()]
    assert found == [None, "duplicate", None, "unknown_format", "too_small", "declared_size_mismatch", "too_small"]


def test_bloom(spark):
    keys = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    others = spark.range(3000, 6000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    bloom = triage.Bloom(keys)
    assert bloom.probe(keys).where("not positive").count() == 0 and bloom.probe(others).where("positive").count() <= 60
    h1, h2 = (int.from_bytes(h(b"x").digest()) for h in (hashlib.sha256, hashlib.sha3_256))
    assert one(spark, binary.bloom_positions(F.lit("x")).alias("p")).p == [(h1 + i * (h2 | 1)) % binary.BLOOM_BITS for i in range(7)]


def test_archives(spark):
    rows = spark.createDataFrame(blob_plans.crafted_archives(), "path string, content binary").withColumn("job_id", F.col("path"))
    found = unpack.unpack(rows).collect()
    assert [r.layer for r in found if r.job_id == "broken"] == ["bad_container"]
    leaves = {}
    for r in sorted(found, key=lambda r: r.name):  # levels come one after another
        leaves.setdefault(r.job_id, []).append(r.layer or r.name)
    assert leaves["zip"] == ["zip/a", "zip/b", "zip/inner.zip/c", "zip/inner.zip/d"] and leaves["tar"] == ["tar/a", "tar/dir/b"] and len(leaves["tgz"]) == 2
    assert leaves["gzip"] == ["gzip/decompressed.bin"] and leaves["plain"] == ["plain"]
    assert [leaves[k] for k in ("slip", "link", "bomb", "deep")] == [["zip_slip"], ["symlink"], ["decompression_ratio"], ["recursion_depth"]]


def test_gate_and_invariants(spark):
    gate = lambda *x: one(spark, report.completion_ready(*[F.lit(y) for y in x]).alias("r")).r
    assert [gate(None, 3, True), gate(3, 3, False), gate(3, 2, True), gate(0, 0, True), gate(3, 3, True), gate(2, 3, True)] == [False, False, False, False, True, True]
    valid = lambda *x: one(spark, families.valid_match(*[F.lit(y) for y in x]).alias("v")).v
    assert valid("CONFIRMED", "exact_cpe", None, None) and valid("POSSIBLE", "embedding_similarity", 0.78, "why") and not valid("CONFIRMED", "exact_cpe", 0.5, None)
    assert not valid("HIGH_CONFIDENCE", "embedding_similarity", 0.93, "why") and not valid("NO_MATCH", "embedding_similarity", 0.1, None) and not valid("POSSIBLE", "embedding_similarity", 1.5, None)


def test_vectors_and_text(spark):
    cos = lambda a, b: one(spark, vectors.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("c")).c
    assert cos([1.0, 0.0], [2.0, 0.0, 9.0]) == 1.0 and cos([0.0], [1.0]) == 0.0 and cos([1.0], [-1.0]) == 0.0
    assert one(spark, text.bucket(F.lit("openssl")).alias("b")).b == int.from_bytes(hashlib.sha256(b"openssl").digest()[:4]) % 384
    assert one(spark, text.redacted(F.lit("abc")).alias("r")).r == "[redacted — 3 chars]" and one(spark, text.redacted(F.lit("")).alias("r")).r == "[redacted]"
    assert one(spark, failures.pauses(4).alias("p")).p == [0.5, 1.0, 2.0]


def test_event_contracts(spark):
    good = {"job_id": "j", "sha256": "A" * 64, "is_duplicate": False, "size_bytes": 5}
    bad = [good | {"x": 1}, {k: v for k, v in good.items() if k != "job_id"}, good | {"sha256": "zz"}, good | {"size_bytes": -1}, good | {"size_bytes": "many"}]
    rows = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]] + [("oops",), (None,)], "value string")
    errors = [r.error for r in events.validated(rows, "firmware.triaged").collect()]
    assert errors[0] is None and all(errors[1:]) and len(errors) == 8
    sent = events.emitted(spark.createDataFrame([("j", "s")], "job_id string, sub_blob_id string"), "firmware.extracted").first()
    assert sent.key == "s"


def test_registry():
    r = Registry()
    r.register("firmware.uploaded")(lambda df: df)
    with pytest.raises(ValueError):
        r.register("firmware.uploaded")(lambda df: df)
    assert r.missing(["triage", "unpack"]) == ["firmware.triaged"] and subscriptions(["match", "triage"]) == ["firmware.uploaded", "firmware.analyzed"]


def test_streams(spark, tmp_path):
    """Bad messages go to the dead letters, and completion is emitted once though events come again and late."""
    src, schema = tmp_path / "in", "job_id string, topic string, sub_blob_id string"
    src.mkdir()
    say = lambda n, *rows: (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("job_id", "topic", "sub_blob_id"), r, strict=True))) for r in rows))
    stream = lambda: spark.readStream.schema(schema).json(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = str(tmp_path / "done")

    def run():
        jobs.completions(stream()).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(100)
        return spark.read.schema("job_id string, total long, status string").parquet(out).collect()

    say(1, ("a", "extracted", "1"), ("a", "extracted", "2"), ("a", "matched", "1"), ("b", "extraction_complete", None))
    assert run() == []
    say(2, ("a", "matched", "1"), ("a", "extraction_complete", None), ("a", "matched", "2"))
    say(3, ("a", "matched", "2"), ("b", "extracted", "9"))
    assert [tuple(r) for r in run()] == [("a", 2, "COMPLETE")]
    say(4, ("a", "matched", "2"), ("b", "matched", "9"))
    assert sorted(tuple(r) for r in run()) == [("a", 2, "COMPLETE"), ("b", 1, "COMPLETE")]

    (tmp_path / "msg").mkdir()
    ok = {"job_id": "j", "status": "COMPLETE", "report_s3_key": "r", "sbom_s3_key": "s"}
    (tmp_path / "msg/1.txt").write_text("\n".join([json.dumps(ok), "poison", json.dumps(ok | {"more": 1})]))
    stages = Registry()
    stages.register("firmware.completed")(lambda df: df)
    stages.run("firmware.completed", spark.readStream.text(str(tmp_path / "msg")), str(tmp_path / "o"), str(tmp_path / "d"), str(tmp_path / "c2")).awaitTermination(100)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1 and spark.read.parquet(str(tmp_path / "d")).count() == 2
    import shutil

    shutil.copytree(tmp_path / "c2/sources", tmp_path / "c3/sources")  # the same batch once more, as after a failure before its commit
    shutil.copytree(tmp_path / "c2/offsets", tmp_path / "c3/offsets")
    jobs.run_stage(spark.readStream.text(str(tmp_path / "msg")), "firmware.completed", lambda df: df, str(tmp_path / "o"), str(tmp_path / "d"), str(tmp_path / "c3")).awaitTermination(100)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1 and spark.read.parquet(str(tmp_path / "d")).count() == 2


def claims_by_hand(rows):
    """SET NX EX: (key, hours) let in, in order of time."""
    last, out = {}, []
    for k, h in sorted(rows, key=lambda r: r[1]):
        if k not in last or h - last[k] > 24:
            last[k] = h
            out.append((k, h))
    return sorted(out)


def test_claims_run_from_the_last_one_let_in(spark, tmp_path):
    """A refused message renews nothing, in batch and in a stream."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [("a", 10 * i) for i in range(20)] + [("b", 0), ("b", 24), ("b", 25), ("c", 3), ("c", 3.5)]
    want = claims_by_hand(rows)
    assert ("a", 30) in want and ("b", 25) in want and len(want) > 8
    hours = lambda t: (t - start).total_seconds() / 3600
    made = [("t", k, "{}", start + timedelta(hours=h)) for k, h in sorted(rows, key=lambda r: r[1])]
    schema = "topic string, key string, value string, ts timestamp"
    found = jobs.claimed(spark.createDataFrame(made, schema))
    assert sorted((r.key, hours(r.ts)) for r in found.collect()) == want

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (made[:8], made[8:]):  # the second batch goes on from the first one's state
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.claimed(spark.readStream.schema(schema).parquet(src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(100)
    assert sorted((r.key, hours(r.ts)) for r in spark.read.schema(schema).parquet(out).collect()) == want


def test_idempotent_claim_is_the_rule_of_the_reference(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = sorted(((r.ts, r.event_id, (r.user_id, r.event_type)) for r in events.collect()), key=lambda r: r[0])
    last, want = {}, set()
    for ts, event, k in rows:
        if k not in last or (ts - last[k]).total_seconds() > 24 * 3600:
            last[k] = ts
            want.add(event)
    assert {r.event_id for r in flow_plans.idempotent_claim(Tables(spark, sf)).collect()} == want


def cosine_by_hand(a, b):
    n = min(len(a), len(b))
    dot, x, y = (sum(p * q for p, q in zip(u[:n], v[:n], strict=True)) for u, v in ((a, b), (a, a), (b, b)))
    return max(0.0, min(1.0, dot / math.sqrt(x * y))) if x and y else 0.0


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_top_k_of_ragged_vectors(spark, small):
    """By both ways: a side that is sent, and pairs of blocks. Each pair is cut to its own shorter width."""
    rng = random.Random(1)
    vector = lambda: [float(rng.randint(-2, 3)) for _ in range(rng.choice([0, 1, 3, 5]))]
    q, c = [(i, vector(), i % 2) for i in range(20)] + [(99, None, 0)], [(i, vector(), i % 2) for i in range(60)] + [(98, None, 1)]
    for scoped in (False, True):
        frames = (spark.createDataFrame(rows, f"{name} int, v array<double>, scope int") for rows, name in ((q, "qid"), (c, "id")))
        a, b = (f if scoped else f.drop("scope") for f in frames)
        found = {}
        for r in similarity.top_k(a, b, 4, block=7, small=small).collect():
            found.setdefault(r.qid, []).append((r["rank"], r.id, round(r.score, 9)))
        want = {}
        for i, v, s in q[:-1]:
            near = sorted(((-round(cosine_by_hand(v, w), 9), j) for j, w, t in c[:-1] if not scoped or s == t))[:4]
            want[i] = [(n + 1, j, -x + 0.0) for n, (x, j) in enumerate(near)]
        assert {k: sorted(v) for k, v in found.items()} == want
    named = similarity.top_k(a.select(F.struct(F.lit("").alias("blob"), "qid").alias("qid"), "v"), b.select(F.struct("id").alias("id"), "v"), 1, block=7, small=small)
    assert named.count() == 20 and named.first().qid.blob == ""


def test_sparse_cosines_in_blocks(spark):
    rng = random.Random(2)
    rows = lambda n: spark.createDataFrame([(i, b, rng.randint(1, 4)) for i in range(n) for b in rng.sample(range(20), 4)], "id int, bucket int, n int")
    a, b = rows(30), rows(12)
    one, other = (sorted((r.a, r.b, round(r.score, 9)) for r in similarity.sparse_cosine(a, b, 0.4, small=size, block=5).collect()) for size in (0, 1 << 30))
    vectors = lambda df: {i: {r.bucket: r.n for r in df.collect() if r.id == i} for i in {r.id for r in df.collect()}}
    x, y = vectors(a), vectors(b)
    size = lambda v: math.sqrt(sum(n * n for n in v.values()))
    want = [(i, j, round(sum(n * w.get(k, 0) for k, n in v.items()) / (size(v) * size(w)), 9)) for i, v in x.items() for j, w in y.items()]
    assert one == other == sorted(t for t in want if t[2] >= 0.4)


def test_containers_that_are_damaged_or_odd(spark):
    import gzip
    import io
    import zipfile

    def zipped(name, body, mode=None):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            info.external_attr = (mode or 0) << 16
            z.writestr(info, body)
        return out.getvalue()

    good = zipped("a", bytes(range(256)) * 8)
    at = good.index(b"a", 30) + 1
    broken = good[:at] + bytes(x ^ 255 for x in good[at : at + 40]) + good[at + 40 :]
    squeezed = gzip.compress(bytes(range(256)) * 8)
    rows = [("zip", broken), ("gz", squeezed[:30] + b"\xff" * 30 + squeezed[60:]), ("cut", squeezed[:-20]), ("safe", zipped("..data/x", b"fine")), ("up", zipped("a/../../x", b"bad")), ("link", zipped("l", b"../../etc", 0o120777)), ("mine", b"OWN:body")]
    own = lambda data: [("inner", data[4:])] if data[:4] == b"OWN:" else []
    found = {r.job_id: r.layer or r.name for r in unpack.unpack(spark.createDataFrame([(n, n, x) for n, x in rows], "job_id string, path string, content binary"), (own,)).collect()}
    assert found == {"zip": "bad_container", "gz": "bad_container", "cut": "bad_container", "safe": "safe/..data/x", "up": "zip_slip", "link": "symlink", "mine": "mine/inner"}


def test_embedders(spark):
    rows = spark.createDataFrame([("a b a",), ("",), ("!?",), (None,)], "text string")
    found = [r.v for r in rows.select(embedding.embedded(F.col("text")).alias("v")).collect()]
    at = lambda t: int.from_bytes(hashlib.sha256(t.encode()).digest()[:4]) % 384
    assert found[0][at("a")] == pytest.approx(2 / math.sqrt(5)) and found[0][at("b")] == pytest.approx(1 / math.sqrt(5))
    assert found[1][at("empty")] == found[3][at("empty")] == 1 and found[2][at("!?")] == 1
    assert all(sum(x * x for x in v) == pytest.approx(1) and len(v) == 384 for v in found)

    class Lengths:
        width = 2

        def encode(self, texts):
            return [[len(t), 1.0] for t in texts]

    assert isinstance(Lengths(), embedding.Embedder)
    assert rows.select(embedding.embedded(F.col("text"), Lengths()).alias("v")).first().v == [5.0, 1.0]
    wrong = Lengths()
    wrong.width = 3
    with pytest.raises(Exception, match="in place of 3"):
        rows.select(embedding.embedded(F.col("text"), wrong)).collect()


def test_components_are_matched_once(spark):
    key = "cpe:2.3:a:busybox:busybox:1.31.1:*:*:*:*:*:*:*"
    records = corpus.with_embeddings(spark.createDataFrame([("CVE-1", key, "busybox", "busybox busybox 1.31.1: gzip flaw"), ("CVE-2", "x", "openssl", "openssl openssl 1.0.2: tls flaw")], "cve_id string, cpe_string string, family string, text string"))
    comps = spark.createDataFrame([(1, [key], "busybox", "busybox busybox 1.31.1"), (2, ["none"], "openssl", "openssl openssl 1.0.2"), (3, ["none"], None, "other thing")], "seq int, cpes array<string>, family string, text string").withColumn("v", embedding.embedded(F.col("text")))
    lines = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 2), ("s3", 3)], "sub_blob_id string, seq int")
    found = {(r.sub_blob_id, r.cve_id): (r.confidence_tier, r.matched_via, r.place) for r in matching.match_lines(lines, comps, records).collect()}
    assert found == {("s1", "CVE-1"): ("CONFIRMED", "exact_cpe", 1), ("s1", "CVE-2"): ("POSSIBLE", "embedding_similarity", 2), ("s2", "CVE-2"): ("POSSIBLE", "embedding_similarity", 1)}
    bad = spark.createDataFrame([("openssl", 0.5, 0.7, 0.1)], "family string, high double, possible double, low double")
    with pytest.raises(Exception, match="thresholds must satisfy"):
        matching.match_lines(lines, comps, records, bad).collect()


def test_refresh_and_upsert(spark, tmp_path):
    from datetime import UTC, datetime

    asked, made = str(tmp_path / "asked"), feed()

    def fetch(params):
        with open(asked, "w") as f:
            f.write(params.get("lastModStartDate", ""))
        return {"totalResults": 4, "vulnerabilities": made[params["startIndex"] :]}

    nvd.register_paged(spark, fetch, "feed_of_changes")
    old = corpus.with_embeddings(spark.createDataFrame([("CVE-2016-2107", "cpe:2.3:a:openssl:openssl:1.0.2:*:*:*:*:*:*:*", "old", "openssl", "old"), ("CVE-1", "c", "kept", "zlib", "kept")], "cve_id string, cpe_string string, description string, family string, text string"))
    new = corpus.refresh(old, datetime(2026, 7, 12, tzinfo=UTC), source="feed_of_changes")
    rows = {r.cve_id: r for r in new.collect()}
    assert len(rows) == 4 and rows["CVE-2016-2107"].description == "no" and rows["CVE-1"].description == "kept" and len(rows["CVE-2021-28831"].embedding) == 384
    assert open(asked).read().startswith("2026-07-10T22:00:00")
    with pytest.raises(ValueError):
        corpus.upsert(old, old.drop("embedding"))
    with pytest.raises(Exception, match="no embedding"):
        corpus.upsert(old, old.withColumn("embedding", F.array().cast("array<float>"))).collect()
    assert corpus.ingested(spark.range(5), new).first() == (5, 4)


def test_retrieval_and_contexts(spark):
    finding = "struct<cve_id: string, confidence_tier: string, llm_rationale: string>"
    reports = spark.createDataFrame([("j1", "PARTIAL", "all bad", [("CVE-9", "HIGH_CONFIDENCE", None), (None, None, None)], [("", "", ""), ("gnu", "zlib", "1.2")]), ("j2", "COMPLETE", " ", [], [])], f"job_id string, status string, executive_summary string, findings array<{finding}>, components array<struct<vendor: string, product: string, version: string>>")
    assert sorted(r.text for r in rag.index_chunks(reports).collect()) == ["Component: gnu zlib 1.2", "Executive summary: all bad", "Finding: CVE-9 HIGH_CONFIDENCE"]
    records = corpus.with_embeddings(spark.createDataFrame([("CVE-1", "a", "gzip flaw", "gzip flaw"), ("CVE-2", "b", "tls flaw", "tls flaw")], "cve_id string, cpe_string string, description string, text string"))
    questions = spark.createDataFrame([("j1", "which gzip flaw?"), ("j2", "tls"), ("j3", "tls flaw")], "job_id string, question string")
    found = {r.job_id: r for r in rag.grounded(questions, reports, records, 1).collect()}
    assert found["j1"].chunks == ["Report summary: all bad", "This job's findings: CVE-9 [HIGH_CONFIDENCE], None [None]", "CVE-1 (a): gzip flaw"]
    assert (found["j1"].status, found["j1"].finding_count, found["j1"].sources) == ("PARTIAL", 2, ["CVE-9", "CVE-1"])
    assert found["j2"].chunks == ["CVE-2 (b): tls flaw"] and found["j3"].sources == ["CVE-2"] and found["j3"].status is None


def test_narrators(spark):
    class Narrator:
        def triage_rationale(self, component, cve_id, description, tier, score):
            if cve_id == "CVE-2":
                raise OSError("no model")
            return f"{component} may have {cve_id}"

        def executive_summary(self, job_id, findings):
            return f"{job_id}: {len(findings)}, first {findings[0]}"

    rows = spark.createDataFrame([("c", f"CVE-{i}", "d", t, 0.6) for i, t in enumerate(["POSSIBLE", "HIGH_CONFIDENCE", "LOW_CONFIDENCE"])], "component string, cve_id string, description string, confidence_tier string, similarity_score double")
    assert [r.llm_rationale for r in report.with_rationales(rows, Narrator()).orderBy("cve_id").collect()] == ["c may have CVE-0", None, None]
    assert report.with_rationales(rows).where("llm_rationale is not null").count() == 0
    jobs_ = spark.createDataFrame([("j", [("CVE-1", "POSSIBLE")] * 60), ("k", [])], "job_id string, findings array<struct<cve_id: string, confidence_tier: string>>")
    assert [r.executive_summary for r in report.with_summaries(jobs_, Narrator()).orderBy("job_id").collect()] == ["j: 50, first - CVE-1 [POSSIBLE]", None]


def test_answers_are_grounded(spark):
    class Narrator:
        def rag_answer(self, question, chunks):
            if question == "broken?":
                raise OSError("no model")
            return f"{question} {len(chunks)} {chunks[0]}"

    rows = spark.createDataFrame([("j", "why?", [f"c{i}" for i in range(30)]), ("k", "broken?", ["c"]), ("l", "what?", []), ("m", "who?", None)], "job_id string, question string, chunks array<string>")
    assert [r.answer for r in report.with_answers(rows, Narrator()).orderBy("job_id").collect()] == ["why? 20 c0", None, None, None]
    assert report.with_answers(rows).where("answer is not null").count() == 0


def test_blobs_by_key(spark, tmp_path):
    kept = stores.Blobs(spark, str(tmp_path), 4)
    rows = lambda *x: spark.createDataFrame([(k, bytearray(v)) for k, v in x], stores.Blobs.SCHEMA)
    assert kept.get("a") is None and kept.read().count() == 0
    assert kept.put(rows(("a", b"one"), ("b", b"")), "w", 0) and not kept.put(rows(("a", b"two")), "w", 0)
    assert kept.put(rows(("a", b"three")), "w", 1)
    assert kept.get("a") == b"three" and kept.get("a", 2) == b"th" and kept.get("b") == b"" and kept.get("none") is None
    found = kept.read(spark.createDataFrame([("a",), ("none",), ("a",)], "key string"), most=3).collect()
    assert [(r.key, r.size_bytes, bytes(r.content)) for r in found] == [("a", 5, b"thr")]


def test_lint_of_samples(spark, tmp_path):
    (tmp_path / "firmware.completed.json").write_text(json.dumps({"job_id": "j", "status": "COMPLETE", "report_s3_key": "r", "sbom_s3_key": "s"}, indent=1))
    (tmp_path / "firmware.triaged.json").write_text("{}")
    (tmp_path / "other.json").write_text("{}")
    found = {r.topic: r.error for r in events.lint(spark, str(tmp_path)).collect()}
    assert found.pop("firmware.completed") is None and found.pop("firmware.triaged") and found.pop("other") == "unknown topic"
    assert set(found.values()) == {"missing"} and len(found) == 5


def test_tables_of_jobs_and_feedback(spark, tmp_path):
    table, uploaded = stores.register_upload(spark.createDataFrame([("j", "me")], "job_id string, uploaded_by string"))
    assert uploaded.first().s3_key == "raw-uploads/j/original.bin" and table.first().status == "UPLOADED"
    assert stores.get(table, "j").count() == 1 and stores.get(table, "k").count() == 0
    path = str(tmp_path / "feedback")
    say = lambda verdict: spark.createDataFrame([("j", "CVE-1", verdict, "me")], "job_id string, cve_id string, verdict string, submitted_by string")
    stores.append_feedback(path, say("confirmed"))
    with pytest.raises(Exception, match="verdict must be one of"):
        stores.append_feedback(path, say("maybe"))
    assert spark.read.parquet(path).count() == 1
    moved = spark.createDataFrame([("zlib", 0.95, 0.75, 0.55)], "family string, high double, possible double, low double")
    rows = {r.family: r.high for r in stores.current_thresholds(moved, spark).collect()}
    assert rows["zlib"] == 0.95 and rows["openssl"] == families.HIGH and len(rows) == len(families.FAMILIES)


def test_slots_and_indexes_of_streams(spark, tmp_path):
    def feed_in(name, schema, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))

    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    slots = tables.MergeTable(spark, str(tmp_path / "slots"), "job_id string, sub_blob_id string, found int, updated_at timestamp, finalized boolean", ["job_id", "sub_blob_id"])
    slots.merge(spark.createDataFrame([("done", "1", 1, at(1), True)], slots.schema), tables.replacing(["job_id", "sub_blob_id"]))
    schema = "job_id string, sub_blob_id string, found int, updated_at timestamp"
    jobs.slots(feed_in("s", schema, ("a", "1", 1, at(1)), ("a", "1", 2, at(3)), ("done", "1", 9, at(9))), slots, str(tmp_path / "cp2")).awaitTermination(100)
    jobs.slots(feed_in("s", schema, ("a", "1", 3, at(2)), ("a", "2", 4, at(4))), slots, str(tmp_path / "cp2")).awaitTermination(100)
    assert sorted((r.job_id, r.sub_blob_id, r.found) for r in slots.read().collect()) == [("a", "1", 2), ("a", "2", 4), ("done", "1", 1)]

    reports = spark.createDataFrame([("a", "summary", [], []), ("b", "other", [], [])], "job_id string, executive_summary string, findings array<struct<cve_id: string, confidence_tier: string, llm_rationale: string>>, components array<struct<vendor: string, product: string, version: string>>")
    kept = indexes.JobIndexes(spark, str(tmp_path / "index"))
    for _ in range(2):
        jobs.index_completed(feed_in("c", "job_id string", ("a",)), reports, kept, str(tmp_path / "cp3"), now=F.lit(at(1)).cast("timestamp")).awaitTermination(100)
    index = kept.read(at(1))
    assert [(r.job_id, r.text, len(r.embedding)) for r in index.collect()] == [("a", "Executive summary: summary", 384)]
    assert rag.retrieve(spark.createDataFrame([("a", "summary"), ("b", "summary")], "job_id string, question string"), index).count() == 1


@pytest.mark.parametrize("sent", [True, False])
def test_top_k_of_many_copies_compares_each_vector_once(spark, monkeypatch, sent):
    plain, asked = similarity.top_k, []

    def counted(q, c, k, **how):
        asked.append((q.count(), c.count()))
        return plain(q, c, k, **({} if sent else {"small": 0, "block": 7}))

    monkeypatch.setattr(similarity, "top_k", counted)
    rows = spark.range(400).select(F.col("id"), F.array(F.lit(1.0), (F.col("id") % 4).cast("double")).alias("v"))
    q = rows.where("id % 3 = 0").select(F.struct("id").alias("qid"), F.when(F.col("id") != 9, F.col("v")).alias("v"))
    shown = lambda df: sorted((r.qid.id, r["rank"], r.id, round(r.score, 12)) for r in df.collect())
    assert shown(similarity.top_k_distinct(q, rows, 3)) == shown(plain(q, rows, 3))
    assert asked == [(4, 12)]


def test_scores_of_long_sides_come_in_tiles(monkeypatch):
    rng, most, plain = np.random.default_rng(3), [], similarity.cosines
    monkeypatch.setattr(similarity, "cosines", lambda a, b: most.append(len(a[0]) * len(b[0])) or plain(a, b))
    side = lambda name, n: pa.table({name: np.arange(n), "v": pa.array(list(rng.integers(0, 3, (n, 3)).astype(np.float64)))})
    q, c = side("qid", 1200), side("id", 9000)
    found = similarity._nearest(q, c, 4)
    assert max(most) <= similarity.TILE[0] * similarity.TILE[1]
    score = plain(similarity._dense(q["v"]), similarity._dense(c["v"]))
    row, column = similarity._best(score, 4)
    assert found["qid"].to_pylist() == row.tolist() and found["id"].to_pylist() == column.tolist()


def test_hashed_words_are_dealt_once_by_id(spark):
    rows = spark.createDataFrame([(1, "a b a"), (1, "a c"), (None, "b"), (None, "b B"), (2, ""), (3, None), (4, "?!")], "k long, text string")
    found = embedding.sparse(rows, "k")
    got = {(r.id, r.bucket): r.n for r in found.collect()}
    want = {}
    for k, words in ((1, "abaac"), (None, "bbb"), (2, ["empty"]), (3, ["empty"]), (4, ["?!"])):
        for w in words:
            at = (k, embedding._bucket(w, 384))
            want[at] = want.get(at, 0) + 1
    assert got == want and dict(found.dtypes) == {"id": "bigint", "bucket": "int", "n": "bigint"}
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_exact_lines_look_up_each_set_of_names_once(spark):
    """4,000 components under two sets of names: pairs with their CVEs are made in the last join alone."""
    components = spark.range(4000).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, F.array(F.lit("CPE:a"), F.lit("cpe:b"))).otherwise(F.array(F.lit("cpe:c"))).alias("cpes"))
    components = components.unionAll(spark.sql("select 1L, array('cpe:a')")).unionAll(spark.sql("select 4000L, cast(array() as array<string>)"))
    corpus = spark.range(300).select(F.concat(F.lit("CVE-"), F.floor(F.col("id") / 2)).alias("cve_id"), F.when(F.col("id") % 2 == 0, "cpe:a").otherwise("cpe:b").alias("cpe_string"))
    lines = spark.range(0, 4001).select((F.col("id") % 7).alias("sub_blob_id"), F.col("id").alias("seq"))
    members, once = matching.by_names(components)
    assert once.count() == 4 and members.count() == 4001 and matching.exact_of(once, corpus).count() == 2 * 150  # of a and b; of a and c, in two rows
    want = {(i % 7, i, f"CVE-{c}") for i in [*range(0, 4000, 2), 1] for c in range(150)}
    found = matching.exact_lines(lines, components, corpus).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert {r.seq for r in matching.lines_without_hit(lines, components, corpus).collect()} == {*range(3, 4000, 2), 4000}


def test_lines_are_dealt_by_their_number(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"))
    counts = dealt(rows, 5000, "k", most=100).groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == 50 and max(r["count"] for r in counts) < 200
    assert dealt(rows.limit(0), 0, "k").count() == 0


@pytest.mark.parametrize("most", [1, 2, 64])
def test_lines_match_as_each_by_itself(spark, most):
    """Whatever is settled in the join and whatever is dealt by sub-blob: the best match of each CVE among all of a sub-blob's."""
    rng = random.Random(most)
    vectors = [[1.0, x] for x in (0.0, 0.3, 0.6, 0.9)]
    records = [(f"CVE-{rng.randint(0, 7)}", f"cpe:{rng.randint(0, 9)}", rng.choice([None, "f"]), rng.choice(vectors)) for _ in range(25)]
    corpus_rows = spark.createDataFrame(sorted(set((a, b, "f", tuple(v)) for a, b, _, v in records)), "cve_id string, cpe_string string, family string, embedding array<double>").dropDuplicates(["cve_id", "cpe_string"]).localCheckpoint()
    parts = [(i, [f"CPE:{rng.randint(0, 30)}" for _ in range(rng.randint(0, 2))], rng.choice([None, "f"]), rng.choice([*vectors, None])) for i in range(40)]
    comps = spark.createDataFrame([*parts, (3, ["cpe:1"], None, None)], "seq int, cpes array<string>, family string, v array<double>")
    held = {(f"s{rng.randint(0, 20)}", rng.randint(0, 41)) for _ in range(90)}
    lines = spark.createDataFrame([*held, (None, 1), ("s1", None)], "sub_blob_id string, seq int")
    found = matching.found_matches(comps.withColumn("sub_blob_id", F.lit("")), corpus_rows).drop("sub_blob_id")
    want = matching.ordered(matching.best_per_cve(lines.join(found, "seq").select(*matching.MATCH)))
    got = matching.match_lines(lines, comps, corpus_rows, most=most)
    rows = lambda df: sorted((tuple(r) for r in df.select(*matching.MATCH, "place").collect()), key=repr)
    assert rows(got) == rows(want) and {r.matched_via for r in got.collect()} == {"exact_cpe", "embedding_similarity"}


def test_matched_lines_are_not_dealt_out(spark):
    """30 components and 30 records under one name: 30 times 30 matches of each line's sub-blobs are made, but only lines are shuffled."""
    key = "cpe:2.3:a:busybox:busybox:1.31.1:*:*:*:*:*:*:*"
    records = spark.range(30).select(F.concat(F.lit("CVE-"), "id").alias("cve_id"), F.lit(key).alias("cpe_string"), F.lit("busybox").alias("family"), F.array(F.lit(1.0)).alias("embedding"))
    comps = spark.range(30).select(F.col("id").alias("seq"), F.array(F.lit(key)).alias("cpes"), F.lit("busybox").alias("family"), F.array(F.lit(1.0)).alias("v"))
    lines = spark.range(600).select(F.col("id").alias("sub_blob_id"), (F.col("id") % 30).alias("seq"))
    found = matching.match_lines(lines, comps, records).select("sub_blob_id", "cve_id")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext.setJobGroup("lines", "lines")
    assert len(set(found.collect())) == 600 * 30
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("lines") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) <= 4 * 600
