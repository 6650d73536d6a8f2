"""Containers taken apart, with defences; lineage and running output of nested containers."""

from __future__ import annotations

import gzip
import io
import lzma
import posixpath
import stat
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blobsight.scratch import materialise, spread

MOST_DEPTH, MOST_RATIO = 8, 100
OUTPUT = "decompressed.bin"
#: Bytes of members, and members, that a task hands on at a time.
KEPT, MOST_ROWS = 32 << 20, 1000


class Unsafe(Exception):
    """A defence that tripped; the argument is its layer's name."""


def inside(name: str) -> str:
    """The entry's normalised path; Unsafe if it is absolute or leaves the container."""
    path = posixpath.normpath(name)
    if name.startswith(("/", "\\")) or path.split("/")[0] == "..":
        raise Unsafe("zip_slip")
    return path


def check_link(at: str, target: str) -> None:
    if posixpath.isabs(target) or posixpath.normpath(posixpath.join(posixpath.dirname(at), target)).split("/")[0] == "..":
        raise Unsafe("symlink")


def check_ratio(size_in: int, size_out: int, most: int = MOST_RATIO) -> None:
    if size_in > 0 and size_out > size_in * most:
        raise Unsafe("decompression_ratio")


def _tar(data: bytes) -> tarfile.TarFile | None:
    try:
        return tarfile.open(fileobj=io.BytesIO(data))
    except (tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError):
        return None


def is_container(data: bytes) -> bool:
    """Whether ``members`` can open it by itself: a zip by its header, a tar, also a compressed one, or a gzip."""
    return data[:4] == b"PK\x03\x04" and zipfile.is_zipfile(io.BytesIO(data)) or data[:2] == b"\x1f\x8b" or _tar(data) is not None


#: What readers raise for a container that is cut short, damaged, locked or packed in a way they don't know.
DAMAGED = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError, ValueError)

#: Takes a blob's bytes and gives its members, or none where it isn't its kind of container: for formats that need a tool of
#: their own, such as ``carving.extractor``. Tried in order, after the containers above.
Extractor = Callable[[bytes], "list[tuple[str, bytes]]"]


def members(data: bytes, extractors: tuple[Extractor, ...] = ()) -> Iterator[tuple[str, bytes]]:
    """Regular members of a container in the order of their names, one at a time; of equal names the last. None for anything else.
    Names, links and declared sizes are checked before a byte is unpacked, gzip as it streams; links are left out."""
    if data[:4] == b"PK\x03\x04" and zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            check_ratio(len(data), sum(i.file_size for i in infos))
            kept = {}
            for i in infos:
                name = inside(i.filename)
                if stat.S_ISLNK(i.external_attr >> 16 & 0xFFFF):
                    check_link(i.filename, z.read(i).decode(errors="replace"))
                else:
                    kept[name] = i
            yield from ((name, z.read(kept[name])) for name in sorted(kept))
    elif (t := _tar(data)) is not None:
        with t:
            try:
                infos = t.getmembers()
            except DAMAGED:
                if data[:2] == b"\x1f\x8b":  # a gzip that only looked like a tar
                    yield OUTPUT, _gunzipped(data)
                    return
                raise
            check_ratio(len(data), sum(m.size for m in infos if m.isreg()))
            kept = {}
            for m in infos:
                name = inside(m.name)
                if m.issym() or m.islnk():
                    check_link(m.name, m.linkname)
                elif m.isreg():
                    kept[name] = m
            yield from ((name, t.extractfile(kept[name]).read()) for name in sorted(kept))
    elif data[:2] == b"\x1f\x8b":
        yield OUTPUT, _gunzipped(data)
    else:
        for more in extractors:
            found = sorted(dict((inside(name), body) for name, body in more(data)).items())
            yield from found
            if found:
                return


def _gunzipped(data: bytes) -> bytes:
    out = bytearray()
    with gzip.open(io.BytesIO(data)) as g:
        while part := g.read(1 << 20):
            out += part
            check_ratio(len(data), len(out))
    return bytes(out)


#: What opening a blob gives. ``place`` orders a job's entries as a walk that goes down first meets them; ``kind`` is leaf,
#: container (perhaps: it is to be opened at the next level) or error.
OPENED = "root long, job_id string, path string, size_in long, name string, parent string, place string, depth int, size long, kind string, layer string, content binary"
KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
NAMES = [x.split()[0] for x in OPENED.split(", ")]


def _of(row: dict, extractors: tuple[Extractor, ...]) -> Iterator[tuple]:
    """Rows of OPENED for one blob: its members, or itself as a leaf where it has none. What a container gave before it turned out
    to be unsafe comes too: places behind the error's don't count."""
    own = (row["root"], row["job_id"], row["path"], row["size_in"])
    any_member = False
    try:
        for i, (name, body) in enumerate(members(row["content"], extractors)):
            any_member, depth = True, row["depth"] + 1
            at = (*own, f"{row['name']}/{name}", row["name"], f"{row['place']}/{i:08d}", depth, len(body))
            if depth > MOST_DEPTH:
                yield (*at, "error", "recursion_depth", None)
            else:
                yield (*at, "container" if extractors or is_container(body) else "leaf", None, body)
        if not any_member:
            yield (*own, row["name"], row["parent"], row["place"], row["depth"], len(row["content"]), "leaf", None, row["content"])
    except (Unsafe, *DAMAGED) as e:
        layer = e.args[0] if isinstance(e, Unsafe) else "bad_container"
        yield (*own, row["name"], row["parent"], row["place"], row["depth"], 0, "error", layer, None)


def _opened(batches: Iterator[pa.RecordBatch], extractors: tuple[Extractor, ...]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)
    for batch in batches:
        for i in range(batch.num_rows):
            for found in _of(batch.slice(i, 1).to_pylist()[0], extractors):
                rows.append(found)
                size += found[8]
                if size >= KEPT or len(rows) >= MOST_ROWS:
                    yield batch_of()
                    rows, size = [], 0
    if rows:
        yield batch_of()


def rejections(entries: DataFrame, most: int = MOST_RATIO) -> DataFrame:
    """(root, place, layer): what turns a job away first, of ``entries`` (root, place, depth, size, size_in, kind, layer) known so far: an
    error, or the entry with which the output of the whole job is over ``most`` times its input. Only such jobs' entries are put in order."""
    errors = entries.where("kind = 'error'").select("root", "place", F.lit(1).alias("turn"), "layer")
    made = entries.where("depth > 0")
    over = made.groupBy("root").agg(F.sum("size").alias("made"), F.first("size_in").alias("size_in")).where((F.col("size_in") > 0) & (F.col("made") > F.col("size_in") * most)).select("root")
    walked = running_output(made.join(over, "root", "left_semi"), "root", ["place"], "size", "size_in", most)
    tripped = walked.where("tripped").select("root", "place", F.lit(0).alias("turn"), F.lit("decompression_ratio").alias("layer"))
    first = errors.unionAll(tripped).groupBy("root").agg(F.min(F.struct("place", "turn", "layer")).alias("first"))
    return first.select("root", "first.place", "first.layer")


def unpack(blobs: DataFrame, extractors: tuple[Extractor, ...] = ()) -> DataFrame:
    """Leaves (layer null) and rejected jobs (layer set) of ``blobs`` (job_id, path, content): (job_id, sub_blob_id, parent_blob_id, name,
    depth, size, content, layer).

    Containers are opened level by level, all of one level together, so the members of one large blob are worked on by many
    tasks. A blob that trips a defence, or holds a damaged container, has one row with the layer that a walk through it, down
    first, meets first; what comes later in that order is no longer opened. Ids are derived from the job and the path within,
    so reruns agree; rows that are repeated are unpacked each. Null contents count as empty, null ids and paths as ''.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.coalesce("content", F.lit(b""))
    level = blobs.select(F.monotonically_increasing_id().alias("root"), text("job_id").alias("job_id"), text("path").alias("path"), F.length(body).cast("long").alias("size_in"), body.alias("content"))
    level = level.withColumns({"name": F.col("path"), "parent": F.lit(None).cast("string"), "place": F.lit(""), "depth": F.lit(0)})
    levels, first = [], None
    while True:
        level = level.select("root", "job_id", "path", "size_in", "name", "parent", "place", "depth", "content")
        found = materialise(level.mapInArrow(lambda batches: _opened(batches, extractors), OPENED), "level")
        levels.append(found)
        # a container without members comes a second time, as a leaf: its size counts where it was made
        made = [x.drop("content").withColumn("size", F.when(F.col("depth") == i + 1, F.col("size")).otherwise(0)) for i, x in enumerate(levels)]
        entries = reduce(DataFrame.unionAll, made)
        first = materialise(rejections(entries), "rejected")
        level = found.where("kind = 'container'")
        if level.isEmpty():
            break
        on = first.select("root", F.col("place").alias("stop"))
        level = spread(level.join(on, "root", "left").where(F.col("stop").isNull() | (F.col("place") < F.col("stop"))), "root", "place")
        if level.isEmpty():
            break
    digest = lambda c: F.when(F.col(c).isNotNull(), F.sha2(F.concat_ws("\n", "job_id", c), 256))
    leaves = reduce(DataFrame.unionAll, levels).where("kind = 'leaf'").join(first, "root", "left_anti")
    leaves = leaves.select("job_id", digest("name").alias("sub_blob_id"), digest("parent").alias("parent_blob_id"), "name", "depth", "size", "content", F.lit(None).cast("string").alias("layer"))
    turned = levels[0].select("root", "job_id", "path").distinct().join(first, "root")
    none = lambda kind: F.lit(None).cast(kind)
    return leaves.unionAll(turned.select("job_id", none("string"), none("string"), "path", none("int"), none("long"), none("binary"), "layer"))


def lineage(edges: DataFrame, most: int = MOST_DEPTH) -> DataFrame:
    """(id, root, depth) by following parents, ``edges`` (id, parent; null at a root). A node deeper than ``most`` keeps
    depth null: its job is turned away."""
    edges = materialise(edges.select("id", "parent"), "edges")
    found = level = materialise(edges.where("parent is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth")), "level")
    for d in range(1, most + 1):  # each level is written, so that the next one's plan is a single join
        up = level.select(F.col("id").alias("parent"), "root")
        level = materialise(edges.join(up, "parent").select("id", "root", F.lit(d).alias("depth")), "level")
        if level.isEmpty():
            break
        found = found.unionAll(level)
    return edges.select("id").join(found, "id", "left")


def running_output(rows: DataFrame, key: str, order: list[str], size: str, size_in: str, most: float = MOST_RATIO) -> DataFrame:
    """Adds ``total``, the output of a container so far, and ``tripped``: it is over ``most`` times the input."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum(size).over(w))
    return rows.withColumn("tripped", (F.col(size_in) > 0) & (F.col("total") > F.col(size_in) * most))
