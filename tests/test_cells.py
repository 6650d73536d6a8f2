"""The index of cells: exact results, measured recall, split cells, odd vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from blobsight.operators import cells, similarity
from blobsight.plans import catalogue


def recall(found, truth) -> float:
    near = lambda rows: {(r.qid, r.id) for r in rows}
    return len(near(found) & near(truth)) / len(truth)


def vectors(spark, n=3000, width=24, groups=30, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, width))[rng.integers(groups, size=n)] + 0.4 * rng.normal(size=(n, width))
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_exact_search_as_sql_has_it(spark, folder):
    at = f"/root/testdata/{folder}"
    assert spark_rows(catalogue.queries()["cells_topk"](spark, at)) == duck_rows(catalogue.oracle_sql()["cells_topk"], at)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_probed_cells(spark, folder):
    """The recall over all queries of the table, against the exact result over all rows."""
    at = f"/root/testdata/{folder}"
    found, truth = (catalogue.queries()[n](spark, at).collect() for n in ("cells_probed", "cells_topk"))
    print(f"{folder}: recall at 5 {recall(found, truth):.3f}")
    assert recall(found, truth) >= 0.9


def test_few_cells_suffice_where_vectors_have_groups(spark):
    rows = vectors(spark)
    index = cells.build(rows)
    queries = rows.where("id % 20 = 0").withColumnRenamed("id", "qid")
    probes = index.probes_for(5)
    truth = similarity.top_k(queries, rows, 5).collect()
    found = index.search(queries, 5, probes).collect()
    print(f"{probes} of {len(index.records)} cells: recall at 5 {recall(found, truth):.3f}")
    assert probes <= len(index.records) / 3 and recall(found, truth) >= 0.9
    assert sorted(map(tuple, index.exact(queries, 5).select("qid", "id", F.round("score", 9), "rank").collect())) == sorted((r.qid, r.id, round(r.score, 9), r.rank) for r in truth)


def test_large_cells_and_many_queries_are_split(spark):
    """Nearly all vectors in one cell: its parts and turns give what one task would."""
    rows = spark.createDataFrame([(i, [1.0, 1e-4 * (i % 50), 0.0]) for i in range(900)] + [(900 + i, [0.0, float(i), 1.0]) for i in range(9)], "id long, v array<double>")
    queries = rows.withColumnRenamed("id", "qid")
    index = cells.build(rows, cells=3, cell_rows=64, query_rows=100)
    assert index.records.max() > 64 * 5
    shown = lambda df: sorted((r.qid, r.id, round(r.score, 9), r.rank) for r in df.collect())
    assert shown(index.exact(queries, 3)) == shown(similarity.top_k(queries, rows, 3))


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [-1.0, 0.0]), (5, [1.0, 0.0])], "id long, v array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "qid long, v array<double>")
    index = cells.build(rows, cells=2)
    shown = lambda df: sorted((r.qid, r.id, round(r.score, 9), r.rank) for r in df.collect())
    assert shown(index.exact(queries, 4)) == shown(similarity.top_k(queries, rows, 4))
    nothing = cells.build(rows.limit(0))
    assert nothing.exact(queries, 3).count() == 0 and nothing.probes_for() == 1
    with pytest.raises(ValueError):
        cells.build(rows.unionAll(spark.createDataFrame([(9, [1.0])], "id long, v array<double>")))


def test_queries_go_to_cells_in_parts(spark):
    """However many cells a query goes to, a task holds a bounded number of copies of its vector."""
    batch = pa.RecordBatch.from_pydict({"qid": [7, 8, 9], "v": [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]})
    row, cell = np.repeat(np.arange(3), 4000), np.tile(np.arange(4000), 3)
    parts = list(cells._sent(batch, row, cell, 1000))
    assert [p.num_rows for p in parts] == [1000] * 12 and all(p.num_rows <= cells.SENT_ROWS for p in cells._sent(batch, row, cell))
    whole = pa.Table.from_batches(parts)
    assert whole["qid"].to_pylist() == [7 + r for r in row] and whole["cell"].to_pylist() == cell.tolist() and whole["v"][8000].as_py() == [1.0, 1.0]
    assert list(cells._sent(batch, row[:0], cell[:0])) == []
