"""Unpacking by levels against a plain walk that goes down first, with defects anywhere in the tree."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from blobsight.operators import unpack


def zipped(*files: tuple[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files:
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tarred(*files: tuple[str, bytes], link: str | None = None) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in files:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        if link:
            info = tarfile.TarInfo("link")
            info.type, info.linkname = tarfile.SYMTYPE, link
            t.addfile(info)
    return out.getvalue()


def walked(data: bytes, name: str):
    """Leaves (name, depth, body) or the layer that turns the blob away: all members of a container first, then each in turn."""
    made = 0

    def go(body: bytes, trail: str, depth: int):
        nonlocal made
        if depth > 8:
            raise unpack.Unsafe("recursion_depth")
        children = list(unpack.members(body))
        if not children:
            return [(trail, depth, body)]
        out = []
        for child, inner in children:
            made += len(inner)
            unpack.check_ratio(len(data), made)
            out += go(inner, f"{trail}/{child}", depth + 1)
        return out

    try:
        return go(data, name, 0)
    except unpack.Unsafe as e:
        return e.args[0]
    except unpack.DAMAGED:
        return "bad_container"


def tree(rng: random.Random, depth: int, bad: float) -> bytes:
    kind = rng.random()
    if kind < bad:
        return rng.choice([zipped(("../up", b"x")), tarred(("a", b"x"), link="/etc/passwd"), zipped(("zeros", bytes(1 << 18))), gzip.compress(b"cut short " * 9, mtime=0)[:25]])
    if depth > 9 or kind < 0.35:
        return rng.randbytes(rng.randrange(200))
    files = [(f"{rng.choice('abc')}{i}", tree(rng, depth + 1, bad)) for i in range(rng.randrange(4))]
    return rng.choice([lambda: zipped(*files), lambda: tarred(*files), lambda: gzip.compress(files[0][1] if files else b"", mtime=0)])()


def deep(n: int) -> bytes:
    body = b"bottom"
    for _ in range(n):
        body = zipped(("n", body))
    return body


@pytest.mark.parametrize("bad", [0.0, 0.12])
def test_levels_give_what_a_walk_does(spark, bad):
    rng = random.Random(int(bad * 100))
    made = [tree(rng, 0, bad) for _ in range(150)] + [deep(8), deep(9), b"", zipped(), tarred(), bytes(2048)]
    made += [zipped(("a", deep(9)), ("b", zipped(("../c", b"")))), zipped(("a", zipped(("../c", b""))), ("b", deep(9)))]  # the first in order counts
    rows = spark.createDataFrame([(f"job{i}", "p", bytearray(x)) for i, x in enumerate(made)], "job_id string, path string, content binary")
    found: dict[str, list] = {}
    for r in unpack.unpack(rows).collect():
        found.setdefault(r.job_id, []).append(r)
    for i, data in enumerate(made):
        want, own = walked(data, "p"), found[f"job{i}"]
        if isinstance(want, str):
            assert [(r.layer, r.name, r.content) for r in own] == [(want, "p", None)], (i, want)
        else:
            assert sorted((r.name, r.depth, bytes(r.content)) for r in own) == sorted(want) and all(r.layer is None and r.size == len(r.content) for r in own)
            assert all(r.sub_blob_id == hashlib.sha256(f"job{i}\n{r.name}".encode()).hexdigest() for r in own)
            assert all(r.parent_blob_id == (hashlib.sha256(f"job{i}\n{r.name.rpartition('/')[0]}".encode()).hexdigest() if r.depth else None) for r in own if r.name.count("/") == r.depth)


def test_the_output_of_a_whole_job_is_bounded(spark):
    """No container is over the ratio by itself, all together are."""
    squeezed = lambda n: gzip.compress(b"z" * n, mtime=0)
    inner = zipped(*[(f"f{i}", squeezed(2500)) for i in range(40)])
    assert walked(zipped(("in", inner)), "p") == "decompression_ratio"
    rows = spark.createDataFrame([("j", "p", bytearray(zipped(("in", inner)))), ("k", "p", bytearray(zipped(("in", b"fine"))))], "job_id string, path string, content binary")
    assert sorted((r.job_id, r.layer) for r in unpack.unpack(rows).collect()) == [("j", "decompression_ratio"), ("k", None)]


def test_members_of_one_blob_are_spread_over_tasks(spark):
    rng = random.Random(1)
    blob = zipped(*[(f"m{i:03d}", zipped(("x", rng.randbytes(500)), ("y", rng.randbytes(500)))) for i in range(64)])
    rows = spark.createDataFrame([("j", "p", bytearray(blob))], "job_id string, path string, content binary")
    seen = []
    real = unpack._opened

    def counted(batches, extractors):
        from pyspark import TaskContext

        for b in real(batches, extractors):
            import pyarrow as pa

            yield b.set_column(b.schema.get_field_index("path"), "path", pa.array([str(TaskContext.get().partitionId())] * b.num_rows))

    unpack._opened = counted
    try:
        found = unpack.materialise
        unpack.materialise = lambda df, name: (seen.append(out := found(df, name)), out)[1]
        assert unpack.unpack(rows).where("layer is null").count() == 128
    finally:
        unpack._opened, unpack.materialise = real, found
    second = [d for d in seen if "parent" in d.columns][1]
    assert second.select("path").distinct().count() >= 4  # one container of 64, opened by several tasks


def test_names_and_repeats(spark):
    """A colon or a backslash within a name is a name; the last of equal names counts; repeated rows are unpacked each."""
    assert [unpack.inside(n) for n in ("a:b", "c\\d", "x/../y")] == ["a:b", "c\\d", "y"]
    for n in ("/a", "\\a", "../a", "a/../../b"):
        with pytest.raises(unpack.Unsafe):
            unpack.inside(n)
    with pytest.warns(UserWarning):
        twice = zipped(("a", b"one"), ("a:b", b"x"), ("a", b"two"))
    rows = spark.createDataFrame([("j", "p", bytearray(twice))] * 2 + [(None, None, None)], "job_id string, path string, content binary").withColumns({n: F.lit("clash") for n in ("root", "place", "kind", "name")})
    assert sorted((r.job_id, r.name, bytes(r.content)) for r in unpack.unpack(rows).collect()) == [("", "", b"")] + sorted([("j", "p/a", b"two"), ("j", "p/a:b", b"x")] * 2)
    assert unpack.unpack(rows.limit(0)).count() == 0
