"""Images carved out of blobs: every format, any offset, pieces of large blobs, headers that only look right."""

from __future__ import annotations

import random

import pytest
from compare import duck_rows, spark_rows

from blobsight.operators import carving, unpack
from blobsight.plans import blobs, catalogue

IMAGES = blobs.crafted_images()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_carving_as_sql_has_it(spark, folder):
    at = f"/root/testdata/{folder}"
    assert spark_rows(catalogue.queries()["carve_offsets"](spark, at)) == duck_rows(catalogue.oracle_sql()["carve_offsets"], at)


@pytest.mark.parametrize("name, length, image", IMAGES, ids=[i[0] for i in IMAGES])
def test_each_format_at_odd_offsets(name, length, image):
    for before in (b"", b"x", b"y" * 4093):
        own = [f for f in carving.starts(before + image + b"tail") if f[1] == name]
        assert own[0][0] == len(before) and (length is None) == (own[0][2] is None or own[0][2] < 0)


def test_pieces_of_a_large_blob_give_what_the_whole_does(spark):
    rng = random.Random(4)
    parts, planted = [], []
    for i in range(120):
        parts.append(rng.randbytes(rng.randrange(1, 3000)))
        planted.append((sum(map(len, parts)), IMAGES[i % len(IMAGES)][0], IMAGES[i % len(IMAGES)][1]))
        parts.append(IMAGES[i % len(IMAGES)][2])
    rows = spark.createDataFrame([("j", "p", bytearray(b"".join(parts))), ("n", "p", None), ("e", "p", bytearray())], "job_id string, path string, content binary")
    whole = sorted((r.offset, r.format, r.length, r.until) for r in carving.carve(rows).collect())
    cut = sorted((r.offset, r.format, r.length, r.until) for r in carving.carve(rows, window=1500).collect())
    assert whole == cut and {x[:3] for x in whole} >= set(planted)
    bodies = {(r.offset, r.format): bytes(r.content) for r in carving.cut_out(rows, carving.carve(rows, window=1500)).collect()}
    for at, name, length in planted:
        if length is not None:
            assert bodies[at, name] == b"".join(parts)[at : at + length]


def test_marks_without_a_header_are_no_images():
    rng = random.Random(5)
    noise = b"".join(bytes.fromhex(m) + rng.randbytes(40) for m, _ in carving.MAGIC for _ in range(50))
    assert len(carving.starts(noise)) < 30  # a short mark may look right by chance, most do not
    assert carving.starts(b"BZh is text, MZ too, 07070 and PK\x03\x04, ustar" * 50) == []


def test_carved_members_are_unpacked(spark):
    """A firmware image: text, a zip and a gzip behind each other; the carver stands in for an outside tool."""
    made = dict((n, x) for n, _, x in IMAGES)
    blob = b"boot loader " * 30 + made["zip"] + b"\xff" * 64 + made["gzip"]
    rows = spark.createDataFrame([("j", "fw", bytearray(blob))], "job_id string, path string, content binary")
    found = {r.name: r for r in unpack.unpack(rows, (carving.extractor,)).collect()}
    start = len(b"boot loader " * 30)
    assert set(found) == {f"fw/{start:08x}.zip/a", f"fw/{start:08x}.zip/b", f"fw/{start + len(made['zip']) + 64:08x}.gzip/decompressed.bin"}
    assert all(r.depth == 2 and r.layer is None for r in found.values())
    assert carving.extractor(made["uimage"]) == [] and carving.extractor(b"text") == []
