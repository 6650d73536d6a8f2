"""Triage: cheap checks, then duplicates; exact, and by a Bloom filter for membership probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsight.functions import binary


def triage(blobs: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("uploaded_at", "job_id")) -> DataFrame:
    """Adds sha256, size_bytes, reason (null: clean) to ``blobs`` (content and the columns named). A clean blob that has come before, by
    ``order``, is a ``duplicate``; a job is never a duplicate of itself. Contents are hashed before the shuffle, so that
    a window over equal blobs holds no contents."""
    rows = blobs.withColumns({"sha256": F.sha2("content", 256), "size_bytes": F.coalesce(F.length("content").cast("long"), F.lit(0))})
    rows = rows.withColumn("reason", binary.precheck(F.substring("content", 1, binary.HEADER), F.col("size_bytes"))).drop("content")
    first = rows.where("reason is null").groupBy("sha256").agg(F.min_by(F.struct(key), F.struct(*order)).alias("_first"))
    rows = rows.join(first, "sha256", "left")
    return rows.withColumn("reason", F.coalesce("reason", F.when(F.col("_first")[key] != F.col(key), "duplicate"))).drop("_first")


def duplicates(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Adds sha256 and is_duplicate: whether a row with this content comes before by ``order``. Firsts are found by an aggregation, so
    a content that most rows share is no hot key."""
    rows = rows.withColumn("sha256", F.sha2(text, 256))
    first = rows.groupBy("sha256").agg(F.min(order).alias("_first"))
    rows = rows.join(first, rows["sha256"].eqNullSafe(first["sha256"])).drop(first["sha256"])
    return rows.withColumn("is_duplicate", F.col(order) > F.col("_first")).drop("_first")


class Bloom:
    """A filter as a table of (word, bits), 64 positions each: 15,000 rows at the default size, whatever goes in."""

    def __init__(self, keys: DataFrame, key: str = "key", bits: int = binary.BLOOM_BITS, hashes: int = binary.BLOOM_HASHES):
        self.bits, self.hashes = bits, hashes
        at = keys.select(F.explode(binary.bloom_positions(F.col(key), bits, hashes)).alias("p"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
        self.table = at.select(F.floor(F.col("p") / 64).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))

    def probe(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """(key, positive): no false negatives. The table has a fixed bound, so it is broadcast."""
        rows = keys.select(key).distinct().select(key, F.explode(binary.bloom_positions(F.col(key), self.bits, self.hashes)).alias("p"))
        hit = F.getbit(F.coalesce("bits", F.lit(0).cast("long")), F.pmod("p", F.lit(64)).cast("int"))
        rows = rows.withColumn("word", F.floor(F.col("p") / 64)).join(F.broadcast(self.table), "word", "left")
        return rows.groupBy(key).agg((F.min(hit) == 1).alias("positive"))
