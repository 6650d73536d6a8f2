"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits have a common variant within two bits of each. So every
fingerprint has all its 2,081 variants within half the radius; equal variants meet; those that meet are linked.

The variants are not shuffled one by one. A slice holds the variants with one prefix of ``h`` bits; a fingerprint
goes once to each slice in which it has variants (1 + h + h(h-1)/2 of them), with the flips that are left, and the
slice completes the variants itself and sorts them. ``h`` grows with the logarithm of the fingerprints, so that a
slice has about ``TARGET`` variants. A slice with more, as a large group of near copies makes, is dealt out over
salts: the salt of a variant is a linear function of its bits, so each salt completes only its own share.

Members of one variant are within four bits of each other, so each is linked to the smallest of them: k - 1 links
in place of k(k-1)/2, with the same components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blobsight.llm.common import fresh, partitions, slices
from blobsight.llm.components import components
from blobsight.scratch import materialise

SHINGLE, SEED, BITS, HALF = 4, 42, 64, 2
#: Variants that a slice or salt holds, and at most so many salts for a slice. They bound memory, not what is found.
TARGET, MOST_SALTS = 1 << 21, 1024
#: Fewest bits of a prefix.
LEAST_PREFIX = 4
#: Hot slices are broadcast up to so many rows of 16 bytes; beyond, joined by shuffle.
BROADCAST_ROWS = 100_000
#: A fingerprint of so many rows, as that of many exact copies or of all blank texts, is hot: its rows get their component by broadcast.
HOT = 500


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in over half the shingles' XXH64. No words: 0; fewer than ``width``: one shingle."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII blanks
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        starts = [0 if i == 0 else ends[i - 1] + 1 for i in range(at, to)]
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[at + width - 1 : to + width - 1], strict=True)), "<u8", to - at)
        total += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long: the fingerprint's bits). A row for each row; null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


@lru_cache(maxsize=4)
def _masks(low: int) -> list[np.ndarray]:
    """Masks of up to 0, 1 and 2 of the ``low`` lowest bits."""
    one = [1 << i for i in range(low)]
    two = [x | y for x, y in combinations(one, 2)]
    return [np.array([0, *one, *two][:n], np.uint64) for n in (1, 1 + low, 1 + low + len(two))]


def _parities(x: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` parities of fixed halves of the bits: linear, so the salt of a ^ b is that of a ^ that of b."""
    out = np.zeros(len(x), np.int64)
    for i in range(bits):
        row = np.uint64(xxhash.xxh64_intdigest(str(i), 7))
        out |= (np.bitwise_count(x & row) & 1).astype(np.int64) << i
    return out


def _variants(fps: np.ndarray, low: int, budget: int, bits: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The low parts of the variants that have this salt (the slice has the prefix), and the fingerprint of each."""
    masks, lows = _masks(low)[budget], fps & np.uint64((1 << low) - 1)
    if not bits:
        return (lows[:, None] ^ masks[None, :]).ravel(), np.repeat(fps, len(masks))
    of_mask, of_fp, out, own = _parities(masks, bits), _parities(lows, bits), [], []
    for c in np.unique(of_fp):
        some, rows = masks[of_mask == (c ^ salt)], of_fp == c
        if len(some):
            out.append((lows[rows][:, None] ^ some[None, :]).ravel())
            own.append(np.repeat(fps[rows], len(some)))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(out), np.concatenate(own)) if out else (none, none)


def _met(fps: np.ndarray, budget: np.ndarray, low: int, bits: int, salt: int) -> np.ndarray:
    """Pairs (smallest, other) of fingerprints that share a variant with this salt."""
    made = [_variants(fps[budget == b], low, b, bits, salt) for b in range(HALF + 1)]
    v = np.concatenate([x for x, _ in made])
    s = np.sort(v)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros((0, 2), np.uint64)
    at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
    hit = twice[at] == v
    group, own = at[hit], np.concatenate([x for _, x in made])[hit]
    order = np.lexsort((own, group))
    group, own = group[order], own[order]
    first = np.r_[True, group[1:] != group[:-1]]
    least = own[first][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([least, own], 1)[least != own], axis=0)
    return pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * HALF]


def _slice_links(table: pa.Table, prefix: int) -> pa.Table:
    """Links within one slice and salt; what is over ``TARGET`` variants is worked off share by share."""
    fps = table.column("fp").to_numpy().view(np.uint64)
    budget = table.column("budget").to_numpy()
    salts, salt = table.column("salts")[0].as_py(), table.column("salt")[0].as_py()
    low = BITS - prefix
    share = sum(int((budget == b).sum()) * len(_masks(low)[b]) for b in range(HALF + 1)) / salts
    more = max(0, math.ceil(math.log2(max(1, share / (2 * TARGET)))))
    bits = int(math.log2(salts))
    pairs = np.concatenate([_met(fps, budget, low, bits + more, salt | x << bits) for x in range(1 << more)])
    pairs = np.unique(pairs, axis=0).view(np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def links(nodes: DataFrame, target: int = TARGET) -> DataFrame:
    """(a, b) between distinct fingerprints (fp) with at most four differing bits, enough of them for the same components."""
    n = nodes.count()
    per = sum(math.comb(BITS, i) for i in range(HALF + 1))
    h = min(30, max(LEAST_PREFIX, math.ceil(math.log2(max(1, n * per / target)))))
    low = BITS - h
    flips = [(sum(1 << i for i in c), HALF - len(c)) for k in range(HALF + 1) for c in combinations(range(h), k)]
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(b).alias("budget")) for m, b in flips]))
    entries = nodes.select("fp", kinds.alias("k")).select("fp", F.col("k.budget").alias("budget"), F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("k.m").cast("long")).alias("slice"))
    sizes = [math.comb(low, 0), 1 + low, 1 + low + math.comb(low, 2)]
    made = F.when(F.col("budget") == 2, sizes[2]).when(F.col("budget") == 1, sizes[1]).otherwise(sizes[0]).cast("long")
    loads = entries.groupBy("slice").agg(F.sum(made).alias("made"), F.count("*").alias("n"))
    power = F.ceil(F.log2(F.col("made") / (2.0 * target)))
    hot = materialise(loads.where(F.col("made") > 2 * target).select("slice", F.least(F.lit(MOST_SALTS), F.pow(F.lit(2.0), power)).cast("int").alias("hot")), "hot")
    many = hot.agg(F.count("*"), F.sum("hot")).first()
    if many[0]:
        entries = entries.join(F.broadcast(hot) if many[0] <= BROADCAST_ROWS else hot, "slice", "left")
    else:
        entries = entries.withColumn("hot", F.lit(None).cast("int"))
    entries = entries.withColumn("salts", F.coalesce("hot", F.lit(1))).drop("hot")
    entries = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    tasks = partitions(nodes, math.ceil(((1 << h) + (many[1] or 0)) / 16))
    groups = entries.repartition(tasks, "slice", "salt").groupBy("slice", "salt")

    def met(table: pa.Table) -> pa.Table:
        return _slice_links(table, h)

    return groups.applyInArrow(met, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are left out).

    component_id is the smallest doc_id that links reach, the row's own included. Null and blank texts have
    fingerprint zero and are linked like any other. A null doc_id is no smallest id: a component without any other
    has component_id null. Repeated rows and repeated ids each keep their row. An empty table gives an empty table.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = materialise(components(links(nodes.select("fp"))).withColumnRenamed("node", "fp"), "roots")
    linked = found.join(nodes.drop("n"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = materialise(linked.join(least, "root").select("fp", "component_id"), "linked")
    of_all = nodes.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    often = max(HOT, -(-rows.count() // BROADCAST_ROWS))  # so many rows have at most BROADCAST_ROWS fingerprints
    hot = F.broadcast(of_all.where(F.col("n") >= often).select("fp", F.struct("component_id").alias("hot")))
    rows = rows.join(hot, "fp", "left")
    done = rows.where("hot is not null").select("doc_id", "fp", "hot.component_id")
    rest = rows.where("hot is null").select("doc_id", "fp").join(of_all.where(F.col("n") < often), "fp")
    return done.unionAll(rest.select("doc_id", "fp", "component_id"))


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies, with its columns: of each component the document that gives it its id.

    Of several rows with that id the first by text stays. Rows without a doc_id can't stand for a component; they stay.
    """
    first, place = fresh(docs.columns, "first"), fresh(docs.columns, "place")
    firsts = classes(docs).select(F.col("component_id").alias(first)).distinct()
    named = docs.join(firsts, F.col("doc_id").cast("long") == F.col(first), "left_semi")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = named.withColumn(place, order).where(F.col(place) == 1).drop(place)
    return one.unionAll(docs.where("doc_id is null"))
