"""Connected components by randomised contraction (Bögeholz, Brand and Todor, 2020): only joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsight.scratch import materialise


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): two nodes have the same root if edges connect them.

    In each round every node moves to the neighbour (or itself) that comes first in an order drawn anew for the
    round, and edges follow. That keeps connected nodes connected and leaves a constant share of the nodes in
    expectation, whatever the shape, so rounds grow with the logarithm of the nodes, on long chains too. A hub's
    edges are pre-aggregated before the shuffle (min) and joined with one row for the hub, which AQE splits.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        if len(moves) == most_rounds:
            raise RuntimeError("components: no end after the rounds allowed")
        order = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), F.col(c)).alias("o"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("first"))
        move = materialise(first.select(F.col("a").alias("node"), F.least(order("a"), "first")["node"].alias("root")), "moves")
        moves.append(move)
        a = move.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = move.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(a, "a").join(b, "b").where("ra <> rb")
        left = materialise(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    found = moves[-1]
    for move in reversed(moves[:-1]):
        on = found.select(F.col("node").alias("mid"), F.col("root").alias("to"))
        found = move.join(on, move["root"] == on["mid"], "left").select("node", F.coalesce("to", "root").alias("root"))
    return found
