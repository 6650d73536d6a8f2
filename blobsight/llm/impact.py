"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Each block of rows has, for every component, the rows in falling order of the component's quantised size, its level. A
posting is a row and its signed level; postings of one level are a segment. A segment's impact is the size of the query's
component times the level; queries are searched in groups, and then the query counts that it moves most. Segments of all
components are worked off in falling order of impact, in rounds that end at ever lower impacts. After a round it is known
what a posting that is left can add to a score at most, and how many of a row's are left, so every row's score is known
within a bound. The scores of the rows that lead are computed exactly; where no more than a share of the rows can still
reach the k-th of them, that is the proof to stop: the query leaves its group, and those rows are scored exactly. Where
there is no such proof, the rounds go on to the last segment. So the result is exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blobsight.llm import blocks
from blobsight.scratch import materialise

#: Levels of a component: what a segment's rows have in common.
LEVELS = 64
#: Queries of a group.
GROUP = 64
#: A round ends at this share of the impact that the one before ended at; the first one at FIRST of the greatest impact.
FALL, FIRST = 0.5, 0.05
#: The proof is accepted if at most one row in so many is left to be scored exactly.
SHARE = 4

INDEX = "ids array<long>, data binary, kind string, width int, rows binary, levels binary, upto binary, shift int"


def _index(table: pa.Table) -> pa.Table:
    """One block's index: its rows by id, and for each component its postings in falling order of level."""
    table = table.sort_by([("id", "ascending")])
    x = blocks.matrix(table["v"])
    size = np.abs(x)
    shift = max(0, int(size.max(initial=0)).bit_length() - (LEVELS - 1).bit_length())
    level = size >> shift
    order = np.argsort(-level, axis=0, kind="stable").T  # a component's postings
    signed = np.take_along_axis(np.where(x < 0, -1, 1) * (2 * level + 1), order.T, 0).T  # the level's middle, in half steps
    upto = np.stack([(level >= at).sum(0) for at in range(LEVELS + 1)], 1)  # postings of this level and above
    data, kind, width = blocks.packed(x)
    row = {"ids": table["id"].to_pylist(), "data": data, "kind": kind, "width": width, "rows": order.astype(np.uint32).tobytes(), "levels": signed.astype(np.int8).tobytes(), "upto": upto.astype(np.uint32).tobytes(), "shift": shift}
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
    return pa.table({n: pa.array([v], t) for (n, v), t in zip(row.items(), kinds, strict=True)})


def _queries(table: pa.Table) -> pa.Table:
    data, kind, width = blocks.packed(blocks.matrix(table["v"]))
    row = {"ids": table["id"].to_pylist(), "keys": table["key"].to_pylist(), "data": data, "kind": kind, "width": width}
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string(), pa.int32()]
    return pa.table({n: pa.array([v], t) for (n, v), t in zip(row.items(), kinds, strict=True)})


class Index:
    """A block's index in memory, to be searched by one query after another."""

    def __init__(self, row: dict):
        n, w = len(row["ids"]), row["width"]
        self.ids, self.n, self.width, self.step = row["ids"], n, w, 1 << row["shift"]
        self.known = np.array([i for i in self.ids if i is not None], np.int64)  # in order; nulls come last
        self.x = blocks.unpacked(row["data"], row["kind"], w, n)
        self.rows = np.frombuffer(row["rows"], np.uint32).reshape(w, n).astype(np.intp)
        self.levels = np.frombuffer(row["levels"], np.int8).reshape(w, n)
        self.upto = np.frombuffer(row["upto"], np.uint32).reshape(w, LEVELS + 1).astype(np.int64)
        self.most = np.abs(self.x.astype(np.int64)).max(0, initial=0)
        self.scored = 0  # rows scored exactly, for those who measure

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        kind = blocks.exact_type(int((np.abs(q) * self.most[: len(q)]).sum()) + 1)
        return (self.x[rows, : len(q)].astype(kind) @ q.astype(kind)).astype(np.int64)

    def search(self, queries: np.ndarray, own: list[int | None], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query places and scores of the ``k`` best rows, ties by place, without rows of its own id."""
        width = min(self.width, queries.shape[1])
        q = queries[:, :width].astype(np.int64)
        apart = [np.searchsorted(self.known, [i, i + 1]) if i is not None else (0, 0) for i in own]
        found = [None] * len(q)
        for at in range(0, len(q), GROUP):
            for i, members in self._members(q[at : at + GROUP], apart[at : at + GROUP], k):
                score = self.exact(members, q[at + i])
                order = np.lexsort((members, -score))[:k]
                found[at + i] = members[order], score[order]
        return found

    def _members(self, q: np.ndarray, apart: list[tuple[int, int]], k: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each query of a group the rows that can be among its ``k`` best: few where a proof is found, else all others."""
        others = lambda i: np.r_[0 : apart[i][0], apart[i][1] : self.n]
        size, most, step = np.abs(q), self.most[: q.shape[1]], self.step
        alive = np.array([i for i in range(len(q)) if size[i].any() and self.n - (apart[i][1] - apart[i][0]) > SHARE * k], np.int64)
        yield from ((i, others(i)) for i in set(range(len(q))) - set(alive.tolist()))
        if not len(alive):
            return
        kind = blocks.exact_type(2 * int((size * (most + step)).sum(1).max()) + 2)
        total, count = np.zeros((self.n, len(alive)), kind), np.zeros(self.n, np.int64)  # sums are in halves, for the levels' middles
        done, end = np.zeros(len(most), np.int64), FIRST * float((size[alive].max(0) * most).max())
        while True:
            peak, adds = size[alive].max(0), (q[alive] * step).T.astype(kind)
            # the lowest level worked off: no posting below it adds more than ``left``
            low = np.clip((end / np.maximum(peak, 1) / step).astype(np.int64), 1, LEVELS)
            upto = np.where(peak > 0, self.upto[np.arange(len(most)), low], 0)
            for d in np.flatnonzero(upto > done):
                rows = self.rows[d, done[d] : upto[d]]
                total[rows] += self.levels[d, done[d] : upto[d], None] * adds[d]
                count[rows] += 1
            done = np.maximum(done, upto)
            sums, going = np.ascontiguousarray(total.T), []
            for place, i in enumerate(alive):
                left = np.sort(np.minimum(size[i] * (low * step - 1), size[i] * most))[::-1]
                missing = np.concatenate([[0], np.cumsum(left)])  # most that so many postings can add
                error = size[i].sum() * step + 2 * missing[len(left) - count]
                about = sums[place].copy()
                a, b = apart[i]
                about[a:b] = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min // 2
                lead = np.argpartition(about, self.n - 2 * k)[-2 * k :]
                kth = np.sort(self.exact(lead, q[i])[(lead < a) | (lead >= b)])[-k]
                can = about + error >= 2 * kth
                can[a:b] = False
                if np.count_nonzero(can) * SHARE <= self.n or (low[size[i] > 0] == 1).all():
                    yield int(i), np.flatnonzero(can)
                else:
                    going.append(place)
            if not going:
                return
            total, alive, end = np.ascontiguousarray(total[:, going]), alive[going], end * FALL


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, row_components: int = blocks.ROW_COMPONENTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (id, v) the ``k`` rows of ``rows`` (id, v) of the highest
    integer inner product (all, if fewer), ties to the smaller id, without rows that have the query's own id.

    ``v`` is an array of integers of up to 2**26 in size, such as ``blocks.integers`` makes; a shorter vector counts as filled
    up with zeros, so one without components scores 0. Null vectors take no part. A row without an id is found like any
    other, last among ties. Repeated rows are found as often as they are there; a query that is repeated is asked once, and
    different vectors under one id are queries of their own. Without rows or queries there is no result.
    """
    own = materialise(rows.where("v is not null").select(F.col("id").cast("long"), "v"), "vectors")
    asked = queries.where("v is not null").select(F.col("id").cast("long"), "v").distinct()
    asked = materialise(asked.withColumn("key", F.xxhash64("id", "v")), "queries")
    index = blocks.pack(own, _index, INDEX, row_components)
    chunks = blocks.pack(asked, _queries, "ids array<long>, keys array<long>, data binary, kind string, width int", blocks.QUERY_COMPONENTS, least=blocks.tasks(rows, index.count))

    def work(q: dict, r: dict) -> dict:
        held, given = Index(r), blocks.unpacked(q["data"], q["kind"], q["width"], len(q["ids"]))
        found = held.search(given, q["ids"], k)
        times = [len(at) for at, _ in found]
        at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        repeat = lambda x: [v for v, n in zip(x, times, strict=True) for _ in range(n)]
        return {"query_id": repeat(q["ids"]), "key": repeat(q["keys"]), "vec_id": [r["ids"][i] for i in at], "score": score}

    some = blocks.meet(chunks, index, work, {"query_id": "long", "key": "long", "vec_id": "long", "score": "long"})
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
