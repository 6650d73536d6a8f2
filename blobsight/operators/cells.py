"""Nearest vectors by an inverted file of cells: approximately, at a measured recall, or exactly, by proof.

Centroids are fitted on a bounded sample; every record lies in the cell of its nearest centroid. A query goes to its nearest
cells by an equi-join. Cells over ``CELL_ROWS`` records are split, and so are the queries that meet in one cell, so that no
task grows with a popular cell. For exact results a query goes on to all further cells that may hold a nearer record than
the k-th it has: a cell's records lie within an angle of its centroid, which bounds their cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from blobsight.operators.similarity import _dense, _nearest
from blobsight.scratch import materialise

#: Vectors that centroids are fitted on at most, rounds of fitting, and cells at most: 4,096 of 384 numbers are 12 MB, sent to every task.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 12, 4096
#: Records of a part of a cell, and queries that meet it at once.
CELL_ROWS, QUERY_ROWS = 8192, 8192
#: Pairs of a query and a cell that a task hands on at once, however many cells a query goes to.
SENT_ROWS = 8192
#: Cells that an exact search looks at before it takes its bounds.
FIRST = 4
#: Records that the number of cells is measured with, and the share of true neighbours that are to be found.
MEASURED, TARGET = 200, 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids of unit length by spherical k-means; an empty cell starts again at the vector worst placed."""
    x = _unit(sample)
    found = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        score = x @ found.T
        own = score.argmax(1)
        total = np.zeros_like(found)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(found)) == 0)
        worst = np.argsort(score[np.arange(len(x)), own], kind="stable")[: len(empty)]
        total[empty[: len(worst)]] = x[worst]
        found = _unit(total)
    return found


def _sent(queries: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, most: int = SENT_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows of ``queries`` with their cells, ``most`` at once: a query's vector goes along to each of its cells."""
    for at in range(0, len(row), most):
        yield queries.take(pa.array(row[at : at + most])).append_column("cell", pa.array(cell[at : at + most].astype(np.int32)))


@dataclass
class Cells:
    """The index: ``rows`` (cell, id, v) as written, its centroids, and records and angle of each cell by its number."""

    rows: DataFrame
    centroids: np.ndarray
    records: np.ndarray
    angles: np.ndarray
    cell_rows: int = CELL_ROWS
    query_rows: int = QUERY_ROWS

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def _to_cells(self, queries: DataFrame, pick) -> DataFrame:
        """(qid, v, cell): queries in the cells that ``pick`` names by their cosines to all centroids, and the table's other columns."""
        shared = queries.sparkSession.sparkContext.broadcast(self.centroids)
        schema = StructType([*queries.select("qid", "v").schema.fields, *StructType.fromDDL("cell int").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    row, cell = pick(_unit(_same_width(batch.column("v"), len(shared.value[0]))) @ shared.value.T, batch)
                    yield from _sent(batch.select(["qid", "v"]), row, cell)

        return (queries if self.records.any() else queries.limit(0)).mapInArrow(run, schema)

    def _meet(self, sent: DataFrame, k: int) -> DataFrame:
        """(qid, id, score): each query's ``k`` best of every part of the cells it goes to."""
        sent = materialise(sent, "probes")
        asked = sent.groupBy("cell").agg(F.count("*").alias("queries"))
        of = self.rows.sparkSession.createDataFrame([(i, int(-(-n // self.cell_rows))) for i, n in enumerate(self.records)], "cell int, parts int")  # a row for each cell
        plan = F.broadcast(asked.join(F.broadcast(of), "cell").where("parts > 0").select("cell", "parts", F.ceil(F.col("queries") / self.query_rows).cast("int").alias("turns")))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        q = sent.join(plan, "cell").withColumn("turn", deal("qid", "turns")).withColumn("part", every("parts"))
        c = self.rows.join(plan, "cell").withColumn("part", deal("id", "parts")).withColumn("turn", every("turns"))
        schema = StructType([StructField("qid", sent.schema["qid"].dataType), StructField("id", self.rows.schema["id"].dataType), StructField("score", DoubleType())])
        keys = ["cell", "part", "turn"]
        return q.select(*keys, "qid", "v").groupBy(*keys).cogroup(c.select(*keys, "id", "v").groupBy(*keys)).applyInArrow(lambda a, b: _nearest(a, b, k), schema)

    def search(self, queries: DataFrame, k: int = 5, probes: int = FIRST) -> DataFrame:
        """(qid, id, score, rank): the ``k`` nearest records of each query's ``probes`` nearest cells, for ``queries`` (qid, v), by
        cosine clamped to [0, 1], ties by id. Null vectors are left out."""
        return _ranked(self._meet(self._to_cells(queries.where("v is not null").select("qid", "v"), _first(probes)), k), k)

    def exact(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The same over all records: after the nearest cells, each query goes to all others whose angle lets a record be as near as
        its k-th. What ``similarity.top_k`` gives for vectors of one width."""
        queries = queries.where("v is not null").select("qid", "v")
        some = materialise(_ranked(self._meet(self._to_cells(queries, _first(FIRST)), k), k).drop("rank"), "first")
        kth = some.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("kth"))
        asked = queries.join(kth, "qid", "left").select("qid", "v", F.coalesce("kth", F.lit(-1.0)).alias("kth"))
        angles, there = self.angles, self.records > 0

        def pick(score: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            nearest = np.cos(np.maximum(0.0, np.arccos(np.clip(score, -1, 1)) - angles))
            may = (np.maximum(nearest, 0.0) >= np.asarray(batch.column("kth"))[:, None] - 1e-9) & there
            may[_first(FIRST)(score, batch)] = False
            return np.nonzero(may)

        return _ranked(some.unionAll(self._meet(self._to_cells(asked, pick), k)), k)

    def probes_for(self, k: int = 5, target: float = TARGET) -> int:
        """Cells that a query has to go to so that ``target`` of true neighbours are found, measured with at most ``MEASURED`` of the
        records, whose true neighbours come from an exact search over all."""
        n = int(self.records.sum())
        if not n:
            return 1
        some = materialise(_some(self.rows.select(F.col("id").alias("qid"), "v"), "qid", n, MEASURED), "measured")
        near = self.exact(some, k).join(self.rows.select("id", F.col("cell").alias("of")), "id").select("qid", "of").toArrow()
        asked = some.toArrow()
        order = np.argsort(-(_unit(_same_width(asked["v"].combine_chunks(), self.width)) @ self.centroids.T), axis=1, kind="stable")
        place = np.argsort(order, 1)
        row = {q: i for i, q in enumerate(asked["qid"].to_pylist())}
        ranks = np.array([place[row[q], c] for q, c in zip(near["qid"].to_pylist(), near["of"].to_pylist(), strict=True)])
        return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def _same_width(column: pa.Array, width: int) -> np.ndarray:
    x, widths = _dense(column)
    if len(widths) and not (widths == width).all():
        raise ValueError(f"an index holds vectors of one width, here {width}")
    return x


def _first(n: int):
    def pick(score: np.ndarray, _: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        best = np.argsort(-score, axis=1, kind="stable")[:, :n]
        return np.repeat(np.arange(len(score)), best.shape[1]), best.ravel()

    return pick


def _some(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """About ``most`` of ``n`` rows, twice as many at most, by a hash of their key: the same ones each time."""
    if n <= most:
        return rows
    share = int(most / n * (1 << 62)) * 2
    return rows.where(F.xxhash64(key, F.lit("sample")).bitwiseAND((1 << 63) - 1) < share).limit(2 * most)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS) -> Cells:
    """An index of ``corpus`` (id, v): every record with a vector is in it. As many cells as the root of the records, ``MOST_CELLS`` at most.

    Vectors have one width, else it raises ValueError. A vector without length lies in some cell and is near nothing. An empty
    corpus gives an index that finds nothing.
    """
    rows = corpus.where("v is not null").select("id", "v")
    n, low, high = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"an index holds vectors of one width, here {low} to {high}")
    cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))
    drawn, _ = _dense(_some(rows, "id", n, sample).select("v").toArrow()["v"]) if n else (np.zeros((1, 1)), None)
    shared = rows.sparkSession.sparkContext.broadcast(fit(drawn, cells))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("cell int, angle double").fields])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                score = _unit(_same_width(batch.column("v"), len(shared.value[0]))) @ shared.value.T
                cell = score.argmax(1)
                angle = np.arccos(np.clip(score[np.arange(len(cell)), cell], -1, 1)) + 1e-7
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("angle", pa.array(angle))

    table = materialise(rows.mapInArrow(placed, schema), "cells")
    records, angles = np.zeros(len(shared.value), np.int64), np.zeros(len(shared.value))
    for r in table.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():  # a row for each cell
        records[r["cell"]], angles[r["cell"]] = r["n"], r["angle"]
    return Cells(table.drop("angle"), shared.value, records, angles, cell_rows, query_rows)
