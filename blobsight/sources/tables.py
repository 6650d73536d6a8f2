"""A table merged by key, in buckets: a batch rewrites the buckets that it touches, and no others."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blobsight.scratch import files, materialise
from blobsight.sources.leases import publish, read_text

BUCKETS = 64
#: Versions whose files stay, for readers that have begun with them.
KEPT = 2


class Conflict(RuntimeError):
    """Another writer has committed since this one began: read again and try anew."""


class MergeTable:
    """Rows of ``schema`` by ``keys`` under ``path``, in buckets by the hash of ``by`` (the first key), each a folder of files.

    A version is a manifest: which folder holds each bucket, and the last batch of each writer. A write puts the buckets it
    touches in new folders and then creates the next manifest, which only one writer can: until then nobody sees them, so a
    crash at any step loses nothing and leaves at most folders that no manifest names. A batch that comes again, by its
    writer's name and number, is not merged twice. Folders of versions older than the last ``KEPT`` are removed. ``kind`` is
    the format of the files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], by: str | None = None, buckets: int = BUCKETS, kind: str = "parquet"):
        self.spark, self.path, self.keys, self.by, self.buckets, self.kind = spark, path.rstrip("/"), keys, by or keys[0], buckets, kind
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _numbers(self) -> list[int]:
        fs, at = files(self.spark, f"{self.path}/manifests")
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def manifest(self, number: int | None = None) -> tuple[int, dict]:
        """The last version's number, or the one asked for, and what it says; -1 and an empty one for a new table."""
        known = self._numbers()
        number = (known[-1] if known else -1) if number is None else number
        if number < 0:
            return -1, {"buckets": self.buckets, "folders": {}, "batches": {}}
        found = json.loads(read_text(self.spark, f"{self.path}/manifests/{number}.json"))
        if found["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {found['buckets']} buckets")
        return number, found

    def _read(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).format(self.kind)
        return rows.load([f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the last version, or of another one that is still there."""
        return self._read(sorted(set(self.manifest(number)[1]["folders"].values())))

    def bucket(self):
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def get(self, value) -> DataFrame:
        """Rows with this value of ``by``: one bucket is read."""
        at = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast(self.schema[self.by].dataType)), F.lit(self.buckets))).first()[0]
        folder = self.manifest()[1]["folders"].get(str(at))
        return self._read([folder] if folder else []).where(F.col(self.by) == F.lit(value))

    def merge(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "", number: int | None = None) -> bool:
        """Commit ``how(old, batch)`` for the buckets that ``batch`` touches, ``old`` being their rows; False if the batch was in before.

        ``how`` keeps rows in their bucket: it may leave rows out, or add some of the same values of ``by``.
        """
        version, was = self.manifest()
        if number is not None and was["batches"].get(writer, -1) >= number:
            return False
        batch = materialise(batch, "batch")  # read for its buckets and again for its rows
        touched = [str(r[0]) for r in batch.select(self.bucket()).distinct().collect()]  # ``buckets`` at most
        folders = dict(was["folders"])
        if touched:
            old = self._read([folders[b] for b in touched if b in folders])
            new = f"data/{version + 1}-{uuid.uuid4().hex}"
            merged = how(old, batch).select(self.schema.names).withColumn("_bucket", self.bucket())
            merged.repartition("_bucket").write.partitionBy("_bucket").format(self.kind).save(f"{self.path}/{new}")
            fs, at = files(self.spark, f"{self.path}/{new}")
            there = {x.getPath().getName().partition("=")[2] for x in fs.listStatus(at) if x.isDirectory()}
            for b in touched:
                folders.pop(b, None)
            folders |= {b: f"{new}/_bucket={b}" for b in there}
        batches = was["batches"] | ({writer: number} if number is not None else {})
        body = json.dumps({"buckets": self.buckets, "folders": folders, "batches": batches}).encode()
        if not publish(self.spark, f"{self.path}/manifests/{version + 1}.json", body):
            raise Conflict(f"{self.path}: version {version + 1} is there already")
        self._clean(version + 1)
        return True

    def _clean(self, version: int) -> None:
        """Remove versions before the last ``KEPT``, and the folders that none of those left names."""
        kept = [n for n in self._numbers() if version - KEPT < n <= version]
        named = {f.rsplit("/", 1)[0]: set() for n in kept for f in self.manifest(n)[1]["folders"].values()}
        for n in kept:
            for f in self.manifest(n)[1]["folders"].values():
                named[f.rsplit("/", 1)[0]].add(f)
        fs, _ = files(self.spark, self.path)
        for n in self._numbers():
            if n < min(kept):
                _, before = self.manifest(n)
                for f in set(before["folders"].values()):
                    if f not in named.get(f.rsplit("/", 1)[0], ()):
                        fs.delete(files(self.spark, f"{self.path}/{f}")[1], True)
                    if f.rsplit("/", 1)[0] not in named:
                        fs.delete(files(self.spark, f"{self.path}/{f.rsplit('/', 1)[0]}")[1], True)
                fs.delete(files(self.spark, f"{self.path}/manifests/{n}.json")[1], False)


def replacing(keys: list[str], order: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge where a row of the batch takes the place of the one with its keys; with ``order``, the one that comes last by it."""

    def how(old: DataFrame, batch: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        last = F.max_by(F.struct(*old.columns), F.struct(*([F.col(order)] if order else []), "_new")).alias("r")
        return both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(last).select("r.*")

    return how
