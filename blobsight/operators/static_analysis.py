"""Static analysis of blobs: strings, banners, secrets, entropy, hardening."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsight.functions import binary, text

MOST_BYTES = 64 << 20


def analyse(blobs: DataFrame) -> DataFrame:
    """The analysed event of each row of ``blobs`` (job_id, sub_blob_id, content): strings are extracted once; banners and secrets look
    at all of them, the event carries the first 5000."""
    rows = blobs.select("job_id", "sub_blob_id", F.substring("content", 1, MOST_BYTES).alias("content"))
    rows = rows.withColumn("_s", text.strings(F.col("content"))).withColumn("_h", binary.hardening("content"))
    flags = F.struct(F.col("_h.nx").alias("nx"), F.col("_h.pie").alias("pie"), F.col("_h.relro").alias("relro"), F.coalesce(text.has_canary(F.col("_s")), F.lit(False)).alias("canary"))
    return rows.select(
        "job_id",
        "sub_blob_id",
        F.slice("_s", 1, text.MOST_STRINGS).alias("strings_found"),
        binary.entropy_sections("content").alias("entropy_sections"),
        text.banners(F.col("_s")).alias("version_candidates"),
        text.secrets(F.col("_s")).alias("secrets_flagged"),
        flags.alias("hardening_flags"),
    )


def _entropies(texts: pd.Series) -> pd.Series:
    def of(text: str | None) -> float | None:
        if not text:
            return None
        _, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        p = n / n.sum()
        return float(-(p * np.log2(p)).sum()) + 0.0

    return texts.map(of).astype("float64")


def character_entropy(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, entropy) of the characters of each text, counted in its own task; empty texts have none."""
    return rows.select(key, F.pandas_udf(_entropies, "double")(F.col(body)).alias("entropy")).where("entropy is not null and not isnan(entropy)")


def joined(items: Column) -> Column:
    return F.array_join(items, "|")
