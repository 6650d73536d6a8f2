"""Integer vectors dealt into blocks of bounded size, and blocks of queries met with blocks of rows.

A side's blocks are written once, each packed into one row by an operator's own ``pack``. Every pair of a query block and a
row block is one group, so memory is bounded by two blocks and a pair that is lost with its executor is done again alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsight.llm.common import partitions
from blobsight.scratch import materialise

SCALE = 256.0
#: Integers beyond are taken as this; with up to 2,048 of them, products fit in a long.
MOST = 1 << 26
#: Components of a block of rows and, at most, of a block of queries.
ROW_COMPONENTS, QUERY_COMPONENTS = 1 << 19, 1 << 22


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def integers(vector: Column) -> Column:
    """Components x as floor(256 * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * SCALE))).cast("int"))


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of integers; shorter ones are filled up with zeros."""
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    widths = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(v), int(widths.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < widths[:, None]] = pc.list_flatten(v).to_numpy(zero_copy_only=False)
    return out


def packed(x: np.ndarray) -> tuple[bytes, str, int]:
    """An integer matrix as bytes of its narrowest type, the type's name and the number of columns."""
    least = np.int16 if not x.size or int(np.abs(x).max()) < 1 << 15 else np.int32
    return x.astype(least).tobytes(), np.dtype(least).name, x.shape[1]


def unpacked(data: bytes, kind: str, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, width)


def exact_type(bound: int) -> type:
    """The fastest type that adds up whole numbers below ``bound`` without an error."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


@dataclass
class Blocks:
    """A written table of packed blocks, a row each with its number in column ``block``, and how many there are."""

    table: DataFrame
    count: int


def pack(rows: DataFrame, build: Callable[[pa.Table], pa.Table], schema: str, components: int, vector: str = "v", least: int = 1) -> Blocks:
    """Deal ``rows``, a table that is written, into blocks of about ``components`` components of ``vector``, at least ``least``
    blocks where there are rows enough, and pack each by ``build``. Rows are dealt by turn, so equal ones spread too."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(vector) + 1), F.lit(0))).first()
    count = max(1, -(-size // components), min(least, -(-n // 16)))
    dealt = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(count)).cast("int"))

    def one(table: pa.Table) -> pa.Table:
        return build(table.drop_columns(["block"])).append_column("block", pa.array([table["block"][0].as_py()], pa.int32()))

    return Blocks(materialise(dealt.groupBy("block").applyInArrow(one, f"{schema}, block int"), "blocks"), count)


#: Arrow types of the columns that a meeting of blocks gives.
KINDS = {"long": pa.int64(), "int": pa.int32()}


def meet(queries: Blocks, rows: Blocks, work: Callable[[dict, dict], dict], columns: dict[str, str]) -> DataFrame:
    """``work`` on each pair of a block of queries and a block of rows, both as dicts of their packed columns; it gives arrays by
    name for ``columns``, whose types are long or int."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.table.withColumnRenamed("block", "_q").withColumn("_r", every(rows.count))
    r = rows.table.withColumnRenamed("block", "_r").withColumn("_q", every(queries.count))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found = work(left.to_pylist()[0], right.to_pylist()[0]) if left.num_rows and right.num_rows else {}
        return pa.table({name: pa.array(found.get(name, []), KINDS[kind]) for name, kind in columns.items()})

    schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    return q.groupBy("_q", "_r").cogroup(r.groupBy("_q", "_r")).applyInArrow(pair, schema)


def tasks(df: DataFrame, blocks: int) -> int:
    """Blocks of queries that give every task something to do beside so many blocks of rows."""
    return -(-2 * partitions(df) // blocks)
