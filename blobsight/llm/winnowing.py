"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; in every window of w k-grams the smallest hash is chosen, the rightmost
of equal ones, and chosen hashes are kept with their positions. Two texts that share a passage of w + k - 1 code points
share a mark; no match shorter than k makes one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsight.llm.common import range_bounds, slices

#: Code points in a gram and grams in a window (powers of two): shared passages of 47 code points are found.
GRAM, WINDOW = 16, 32
_MULTIPLY, _SPREAD, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_LOW = np.uint64(0xFFFFFFFF)
#: Bytes of text that are marked together.
CHUNK = 1 << 20

Marks = tuple[np.ndarray, np.ndarray]


def _hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """32 bits for each gram, by doubling: the hash of 2m code points is that of the first m times b^m plus that of the rest."""
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD
        h ^= h >> np.uint64(29)
        m, power, have, of = 1, _MULTIPLY, None, 0
        while True:
            if gram & m:  # parts of the gram's length, from the lowest bit up
                have = h if have is None else h[: len(h) - of] * np.uint64(pow(int(_MULTIPLY), of, 1 << 64)) + have[m : m + len(h) - of]
                of += m
            if 2 * m > gram:
                break
            h = h[:-m] * power + h[m:] if len(h) > m else h[:0]
            power, m = power * power, 2 * m
        have = have ^ (have >> np.uint64(33))
        return (have * _FINISH) >> np.uint64(32)


def marks(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[Marks]:
    """(hashes, positions) of each text, by position. A text with fewer than ``window`` grams has windows of a quarter of
    its grams; one shorter than a gram is one mark at 0; an empty one has none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.cumsum(sizes) - sizes
    grams = sizes - gram + 1
    out: list[Marks] = [(np.zeros(0, np.uint32), np.zeros(0, np.int32))] * len(texts)
    keys = np.zeros(0, np.uint64)
    if len(codes) >= gram:
        h = _hashes(codes, gram)
        keys = (h << np.uint64(32)) | (_LOW - np.arange(len(h), dtype=np.uint64))  # the least is the rightmost of the least hashes
    if (grams >= window).any():
        m, s = keys, 1
        while 2 * s <= window:
            m, s = np.minimum(m[:-s], m[s:]), 2 * s
        if s < window:
            m = np.minimum(m[: -(window - s)], m[window - s :])
        last = np.repeat(np.where(grams >= window, offsets + grams - window, -1), sizes)[: len(m)]
        m = m[np.arange(len(m)) <= last]
        m = m[np.r_[True, m[1:] != m[:-1]]]
        at = (_LOW - (m & _LOW)).astype(np.int64)
        cut = np.searchsorted(at, np.append(offsets, len(codes)))
        hashes = (m >> np.uint64(32)).astype(np.uint32)
        for i in np.flatnonzero(grams >= window):
            part = slice(cut[i], cut[i + 1])
            out[i] = hashes[part], (at[part] - offsets[i]).astype(np.int32)
    for i in np.flatnonzero((grams < window) & (sizes > 0)):
        if grams[i] < 1:
            own = codes[offsets[i] : offsets[i] + sizes[i]]
            out[i] = _hashes(own, len(own)).astype(np.uint32), np.zeros(1, np.int32)
            continue
        part, w = keys[offsets[i] : offsets[i] + grams[i]], max(1, int(grams[i]) // 4)
        m = np.lib.stride_tricks.sliding_window_view(part, w).min(1)
        m = m[np.r_[True, m[1:] != m[:-1]]]
        out[i] = (m >> np.uint64(32)).astype(np.uint32), ((_LOW - (m & _LOW)).astype(np.int64) - offsets[i]).astype(np.int32)
    return out


def likeness(a: Marks, b: Marks) -> float:
    """Jaccard likeness of the sets of hashes; 1 for two without any."""
    x, y = set(a[0].tolist()), set(b[0].tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", CHUNK):
        found = marks([x or "" for x in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int32()))], ["doc_id", "hashes", "positions"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes array<long>, positions array<int>) for every row of ``docs`` (doc_id, text; others are left out).
    Null text counts as empty and has no marks."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_marked, "doc_id long, hashes array<long>, positions array<int>")


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) dealt out by ranges of doc_id, each partition in descending order, with one more
    row (ahead = 1) at its end: the document that follows in the next range, after the lowest the highest of all.

    Whole texts are shuffled once. Only the range bounds and each range's highest id reach the driver. Null ids come
    last; rows of one id are ordered by text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-1 << 63)))
    bounds = np.array(range_bounds(rows, "key", docs.count(), 20_000), np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "left").astype(np.int32))

    tops = sorted((r["part"], r["top"]) for r in rows.groupBy(part("key").alias("part")).agg(F.max("key").alias("top")).collect())
    to = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}

    @F.pandas_udf("array<int>")
    def parts(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(), "left")
        return pd.Series([[2 * o, 2 * to[k] + 1] if k in to else [2 * o] for o, k in zip(own.tolist(), key.tolist(), strict=True)])

    dealt = rows.withColumn("to", F.explode(parts("key"))).select("doc_id", "text", "key", F.shiftright("to", 1).alias("part"), F.col("to").bitwiseAND(1).alias("ahead"))
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "ahead", F.desc("key"), "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []  # the row that waits for the one after it
    for batch in slices(batches, "text", CHUNK):
        texts = batch.column("text").to_pylist()
        rows = held + list(zip(batch.column("doc_id").to_pylist(), texts, batch.column("ahead").to_pylist(), marks(texts), strict=True))
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[2]]  # noqa: B905
        held = rows[-1:]
        changed = [edited(a[1], b[1]) for a, b in pairs]
        others = marks(changed) if changed else []
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()),
            "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed], pa.string()),
            "fingerprint": pa.array([text_form(a[3]) for a, _ in pairs], pa.string()),
            "edited_fingerprint": pa.array([text_form(x) for x in others], pa.string()),
            "positions": pa.array([a[3][1] for a, _ in pairs], pa.list_(pa.int32())),
            "near_edited": pa.array([likeness(a[3], x) for (a, _), x in zip(pairs, others, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
        })


def text_form(m: Marks) -> str:
    """A mark's hash as 8 hex digits, by position."""
    return m[0].astype(">u4").tobytes().hex()


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text; others are left out): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, positions (of the fingerprint's marks), near_edited, near_next. The next document is the one with the next smaller doc_id, for the last
    the first; null ids come last, null text is empty. A table of one row has itself as next; an empty one gives none. Repeated
    rows follow each other and each have a row; texts of any length are fingerprinted whole.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, positions array<int>, near_edited double, near_next double"
    return neighbours(docs).select("doc_id", "text", "ahead").mapInArrow(_compared, schema)
