"""Hard negatives by bit-sliced integer products.

A block of rows keeps the bits of its components in planes, the sign's first. An anchor's product with a plane is a sum of
the anchor's components where the bit is set; planes are added up from the most significant one, each at half the weight of
the one before. After each plane a row's score is known within an interval: what the planes that are left can add lies
between their weight times the anchor's negative and positive components. A row is dropped once its interval misses what is
looked for, or once enough rows are sure to come before it; those that remain go on to the next plane, and after the last
one their scores are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blobsight.llm import blocks
from blobsight.scratch import materialise

#: Anchors that are multiplied with a plane at once.
TOGETHER = 128
#: Rows are tested from the plane on after which the interval is at most one part in so many of the scores' own spread.
SPREAD = 4
NO_LIMIT = 1 << 62
#: Hard negatives: scores from 50 to 95 hundredths of the positive's.
LEAST, MOST = 50, 95

INDEX = "ids array<long>, labels array<long>, planes binary, bits int, width int"
ANCHORS = "ids array<long>, labels array<long>, keys array<long>, data binary, kind string, width int, positives binary"


def _row(**columns) -> pa.Table:
    kinds = {"planes": pa.binary(), "data": pa.binary(), "positives": pa.binary(), "kind": pa.string(), "bits": pa.int32(), "width": pa.int32()}
    return pa.table({n: pa.array([v], kinds.get(n, pa.list_(pa.int64()))) for n, v in columns.items()})


def _sliced(table: pa.Table) -> pa.Table:
    """One block's bit planes, the sign's first, its rows by label and id."""
    table = table.sort_by([("label", "ascending"), ("id", "ascending")])
    x = blocks.matrix(table["v"])
    bits = 1 + int(np.maximum(x, ~x).max(initial=0)).bit_length()
    planes = np.stack([(x >> j) & 1 for j in reversed(range(bits))]).astype(np.uint8)
    return _row(ids=table["id"].to_pylist(), labels=table["label"].to_pylist(), planes=np.packbits(planes).tobytes(), bits=bits, width=x.shape[1])


def _anchors(table: pa.Table) -> pa.Table:
    data, kind, width = blocks.packed(blocks.matrix(table["v"]))
    lists = [x or [] for x in table["positives"].to_pylist()] if "positives" in table.column_names else []
    most = max(map(len, lists), default=0)
    scores = np.array([x + [-NO_LIMIT] * (most - len(x)) for x in lists], np.int64)
    return _row(ids=table["id"].to_pylist(), labels=table["label"].to_pylist(), keys=table["key"].to_pylist(), data=data, kind=kind, width=width, positives=scores.tobytes())


class Planes:
    """A block's planes in memory."""

    def __init__(self, row: dict):
        self.n, self.width, self.bits = len(row["ids"]), row["width"], row["bits"]
        self.labels = np.array(row["labels"], np.int64)
        flat = np.unpackbits(np.frombuffer(row["planes"], np.uint8), count=self.bits * self.n * self.width)
        self.planes = flat.reshape(self.bits, self.n, self.width)
        self.ids = row["ids"]
        self.place = np.empty(self.n, np.int64)  # among ids; nulls last
        self.place[np.lexsort(([i or 0 for i in self.ids], [i is None for i in self.ids]))] = np.arange(self.n)
        self.kept = np.zeros(self.bits, np.int64)  # rows that were left for each plane, for those who measure

    def best(self, q: np.ndarray, own: list[int | None], rows: list[np.ndarray | slice], least: np.ndarray, most: np.ndarray, k: int, span: slice = slice(None)):
        """(anchor, range, row, score) arrays: for each anchor and each of its ranges [least, most] (anchors x ranges) the ``k`` best
        rows of ``span`` with a score in it, ties by id; only where ``rows`` (a mask over the span for each anchor) allows it."""
        width = min(self.width, q.shape[1])
        q, planes = q[:, :width].astype(np.int64), self.planes[:, span, :width]
        ids = np.array([-1 if i is None else i for i in self.ids[span]], np.int64)
        null = np.array([i is None for i in self.ids[span]], bool)
        place = self.place[span]
        kind = blocks.exact_type((int(np.abs(q).sum(1).max(initial=0)) << self.bits) + 1)
        out = []
        for at in range(0, len(q), TOGETHER):
            out += self._together(q[at : at + TOGETHER], planes, kind, ids, null, place, own[at : at + TOGETHER], rows[at : at + TOGETHER], least[at : at + TOGETHER], most[at : at + TOGETHER], k, at)
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4

    def _together(self, q, planes, kind, ids, null, place, own, rows, least, most, k, base):
        negative, positive = np.minimum(q, 0).sum(1), np.maximum(q, 0).sum(1)
        total, fast = np.zeros((len(q), planes.shape[1]), kind), q.astype(kind)
        for b in range(self.bits):
            j = self.bits - 1 - b
            total += (fast * kind(-(1 << j) if b == 0 else 1 << j)) @ planes[b].T.astype(kind)
            self.kept[b] += total.size
            width = ((1 << j) - 1) * (positive - negative)
            if j == 0 or (np.median(width) * SPREAD <= np.median(np.ptp(total, axis=1)) if total.size else True):
                break
        out = []
        for i in range(len(q)):
            here = rows[i] & (null | (ids != own[i]) if own[i] is not None else True)
            some = np.flatnonzero(here)
            score = total[i, some]
            for c in range(b, self.bits):
                j = self.bits - 1 - c
                if c > b and len(some):
                    score = score + planes[c][some].astype(kind) @ (fast[i] * kind(1 << j))
                    self.kept[c] += len(some)
                rest = (1 << j) - 1
                keep = _alive(score + kind(rest * negative[i]), score + kind(rest * positive[i]), least[i], most[i], k)
                some, score = some[keep], score[keep]
            for r in range(least.shape[1]):
                fits = np.flatnonzero((score >= least[i, r]) & (score <= most[i, r]))
                fits = fits[np.lexsort((place[some[fits]], -score[fits]))[:k]]
                if len(fits):
                    out.append((np.full(len(fits), base + i), np.full(len(fits), r), some[fits], score[fits].astype(np.int64)))
        return out


def _alive(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """Rows whose interval [low, high] may put them among the ``k`` best of one range at least."""
    alive = np.zeros(len(low), bool)
    for a, b in zip(least, most, strict=True):
        if a > b:
            continue
        can = (high >= a) & (low <= b)
        sure = low[(low >= a) & (high <= b)]
        if len(sure) >= k:
            can &= high >= np.partition(sure, len(sure) - k)[-k]
        alive |= can
    return alive


def _positives(q: dict, r: dict, k: int) -> dict:
    held, given = Planes(r), blocks.unpacked(q["data"], q["kind"], q["width"], len(q["ids"]))
    labels, found = np.array(q["labels"], np.int64), []
    for label in np.unique(labels):
        a, b = np.searchsorted(held.labels, [label, label + 1])
        if a == b:
            continue
        mine = np.flatnonzero(labels == label)
        free = np.full((len(mine), 1), -NO_LIMIT), np.full((len(mine), 1), NO_LIMIT)
        i, _, row, score = held.best(given[mine], [q["ids"][x] for x in mine], [np.ones(b - a, bool)] * len(mine), *free, k, slice(int(a), int(b)))
        found.append((mine[i], row + a, score))
    if not found:
        return {}
    anchor, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return {"anchor_id": [q["ids"][i] for i in anchor], "key": [q["keys"][i] for i in anchor], "positive_id": [r["ids"][i] for i in row], "positive_score": score}


def _negatives(q: dict, r: dict, k: int) -> dict:
    held, n = Planes(r), len(q["ids"])
    given = blocks.unpacked(q["data"], q["kind"], q["width"], n)
    positive = np.frombuffer(q["positives"], np.int64).reshape(n, -1)
    there = positive > -NO_LIMIT
    p = np.where(there, positive, 0).astype(object)  # products with 95 need not fit in a long
    least = np.where(there, -((-LEAST * p) // 100), 1).astype(np.int64)
    most = np.where(there, (MOST * p) // 100, 0).astype(np.int64)
    rows = {label: held.labels != label for label in set(q["labels"])}
    i, place, row, score = held.best(given, q["ids"], [rows[x] for x in q["labels"]], least, most, k)
    return {"anchor_id": [q["ids"][x] for x in i], "key": [q["keys"][x] for x in i], "place": place, "negative_id": [r["ids"][x] for x in row], "negative_score": score}


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, row_components: int = blocks.ROW_COMPONENTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of ``anchors`` (id, label, v) and
    each of its first ``positives`` rows of the same label in ``rows`` (id, label, v), the first ``negatives`` rows of other
    labels whose score is 50 to 95 hundredths of the positive's.

    Scores are integer inner products with the anchor; higher ones come first, ties by id, rows without one last. ``v`` is an
    array of integers of up to 2**26 in size; a shorter one counts as filled up with zeros. Rows whose label or vector is null
    take no part, nor do rows of the anchor's own id as its positives or negatives. Repeated rows count as often as they are
    there; a repeated anchor is one, and different vectors or labels under one id are anchors of their own. A positive with a
    score below zero has no negatives, one of zero has those of zero. No rows or no anchors: no result.
    """
    typed = lambda df: df.where("v is not null and label is not null").select(F.col("id").cast("long"), F.col("label").cast("long"), "v")
    own = materialise(typed(rows), "vectors")
    asked = materialise(typed(anchors).distinct().withColumn("key", F.xxhash64("id", "label", "v")), "anchors")
    index = blocks.pack(own, _sliced, INDEX, row_components)
    least = blocks.tasks(rows, index.count)
    first = blocks.meet(blocks.pack(asked, _anchors, ANCHORS, blocks.QUERY_COMPONENTS, least=least), index, lambda q, r: _positives(q, r, positives), {"anchor_id": "long", "key": "long", "positive_id": "long", "positive_score": "long"})
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    first = first.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    first = materialise(first, "positives")
    lists = first.groupBy(F.col("anchor_id").alias("id"), "key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # so many as ``positives``
    pairs = asked.join(lists, (asked["id"].eqNullSafe(lists["id"])) & (asked["key"] == lists["key"])).select(asked["id"], "label", "v", asked["key"], F.col("p.positive_score").alias("positives"))
    pairs = materialise(pairs, "anchors")
    some = blocks.meet(blocks.pack(pairs, _anchors, ANCHORS, blocks.QUERY_COMPONENTS, least=least), index, lambda q, r: _negatives(q, r, negatives), {"anchor_id": "long", "key": "long", "place": "int", "negative_id": "long", "negative_score": "long"})
    order = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    best = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    joined = best.join(first, (best["anchor_id"].eqNullSafe(first["anchor_id"])) & (best["key"] == first["key"]) & (best["place"] == first["place"]))
    return joined.select(best["anchor_id"], "positive_id", "rank", "negative_id", "positive_score", "negative_score")
