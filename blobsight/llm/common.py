"""What several operators share: the word pattern, Arrow batches cut to size, dealing rows out by ranges of ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space; the same split as ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, for translate().
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions asked for in the session, or ``least`` where that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)


#: Rows that bounds of ranges are drawn from at most, as many as Spark's own range partitioning takes, and ranges at most.
SAMPLED, MOST_RANGES = 1_000_000, 50_000


def range_bounds(df: DataFrame, column: str, rows: int, per_range: int) -> list[int]:
    """Rising values that cut ``column`` of ``df``, which has ``rows`` rows, into ranges of about ``per_range`` rows.

    Only the column itself is read, of a bounded sample, and only the bounds reach the driver. They decide where a row
    is worked on, not what comes out. A value that many rows share stays within one range.
    """
    ranges = min(MOST_RANGES, partitions(df, -(-rows // per_range)))
    if ranges < 2:
        return []
    share = min(1.0, 200 * ranges / max(1, rows), SAMPLED / max(1, rows))
    some = df.select(column) if share == 1.0 else df.select(column).sample(share, 42)
    cuts = [i / ranges for i in range(1, ranges)]
    found = some.agg(F.percentile_approx(column, cuts, max(10_000, 10 * ranges)).alias("b")).first()["b"]
    return sorted({int(x) for x in found or []})


def fresh(taken: Iterable[str], name: str) -> str:
    """``name`` behind as many underscores as set it apart from all ``taken`` names, case aside."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` one after another, and the index of each one's text; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    there = np.asarray(pc.binary_length(words)) > 0  # white space at either end leaves an empty piece
    doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    return words.filter(pa.array(there)), doc[there]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start`` and have ``size`` items, one after another."""
    upto = np.cumsum(size)
    return flat[np.repeat(start - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)]


def contents(path: str | bytes) -> bytes:
    """A vocabulary file's bytes, or these as they are. Files are read by the driver and sent to the tasks, which need not have them."""
    if isinstance(path, bytes):
        return path
    with open(path, "rb") as f:
        return f.read()
