"""Mixing sources to target weights: a curriculum of time-varying weights, all in DataFrame operations.

Training runs over t from 0 to 1. Each source has a weight schedule, piecewise linear in t; its integral is the
source's overall weight. A source's target is its share of all words by that weight, at most ``repeats`` times the
words it has, with the excess reshared by weight. Its demand up to t is the target times the integral up to t over
the whole integral. Documents of a source come in a fixed pseudo-random order, over and over; the words before a
copy, inverted through the demand, are the copy's training position. Sorting copies by position is the mix.

A source's order is cut into buckets by hash, so that running sums need no task with a whole source: words per bucket
are summed first, their running sum gives each bucket's start, and rows are summed up within a bucket only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blobsight.llm.common import WORD, partitions, word_count
from blobsight.scratch import materialise

REPEATS = 3
#: Documents that a bucket holds on average.
BUCKET = 4_000
#: Knots of a schedule are at 0, 1/2 and 1. Shapes that a source without its own schedule gets, in turn by rank:
#: even, falling, rising; each has integral 1 and is multiplied by the source's weight.
SHAPES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))
CYCLE = (1.0, 2.0, 3.0)
SEED = 42


def weights(sizes: DataFrame) -> DataFrame:
    """Default weights for (source, source_size): by code point, null last, 1, 2, 3 repeating, with a shape in turn.

    There is one row a source here; callers with another mix pass their own table with these columns.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    pick = lambda rows, k: F.element_at(F.array(*[F.lit(x) for x in rows]), (k % len(rows) + 1).cast("int"))
    out = sizes.withColumn("rank", rank).withColumn("weight", pick(CYCLE, F.col("rank")))
    for i in range(3):
        out = out.withColumn(f"w{i}", F.col("weight") * pick([s[i] for s in SHAPES], F.col("rank")))
    return out.drop("rank")


def integral(t: Column) -> Column:
    """Integral of the schedule with knots w0, w1, w2 from 0 to t, by the trapezoids' closed form."""
    first = F.col("w0") * t + (F.col("w1") - F.col("w0")) * t * t
    u = t - 0.5
    half = 0.25 * (F.col("w0") + F.col("w1"))
    return F.when(t <= 0.5, first).otherwise(half + F.col("w1") * u + (F.col("w2") - F.col("w1")) * u * u)


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight, w0, w1, w2): the share of all words by the schedule's integral,
    at most ``repeats`` times source_size, the excess reshared by weight until none is above.

    Sorted by size over weight, the sources that are full come first; the k-th is full if the level that is left for
    it and those after it lifts it over its limit. One row a source.
    """
    by = Window.orderBy(F.col("cap") / F.col("mass"), F.col("source").isNull(), "source")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = sizes.withColumn("mass", integral(F.lit(1.0))).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    rows = rows.withColumn("all", F.sum("source_size").over(everything)).withColumn("masses", F.sum("mass").over(everything))
    rows = rows.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.col("masses") - F.coalesce(F.sum("mass").over(upto), F.lit(0.0))))
    rows = rows.withColumn("open", F.col("level") * F.col("mass") < F.col("cap")).withColumn("place", F.row_number().over(by))
    final = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)["level"]  # of the first that is open
    rows = rows.withColumn("open", F.col("place") >= F.min(F.when(F.col("open"), F.col("place"))).over(everything)).withColumn("final", final)
    return rows.withColumn("target", F.when(F.col("open"), F.col("final") * F.col("mass")).otherwise(F.col("cap"))).drop("all", "masses", "level", "open", "final", "cap", "place")


def position(words: Column) -> Column:
    """The t at which the demand for the source reaches ``words``: the quadratic of the half that it falls in, solved.

    Written with the root in the denominator, so it holds for even schedules as well.
    """
    need = F.least(F.col("mass"), words / F.col("target") * F.col("mass"))
    half = 0.25 * (F.col("w0") + F.col("w1"))

    def root(a: Column, b: Column, c: Column) -> Column:
        """t >= 0 with a t^2 + b t = c."""
        return F.when(c <= 0, F.lit(0.0)).otherwise(2 * c / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * a * c))))

    before = root(F.col("w1") - F.col("w0"), F.col("w0"), need)
    after = 0.5 + root(F.col("w2") - F.col("w1"), F.col("w1"), need - half)
    return F.least(F.lit(1.0), F.when(need <= half, before).otherwise(after))


def plan(docs: DataFrame, weighted=weights, repeats: int = REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, source, text; others are left out but for ``keep``):
    doc_id, source, size, source_size, target, and copies: array of (copy, position, words).

    A copy takes the words of the document that the demand still covers, so a source's words come within one word of
    its target; only the copy at which demand ends takes less than the whole. Null text has size 0 and takes nothing,
    as do all documents of a source without words. A null source is a source of its own, last. Repeated rows count as
    often as they are there. The order depends on doc_id and size alone, so reruns agree.
    """
    size = word_count(F.col("text"))
    rows = materialise(docs.select(F.col("doc_id"), F.col("source"), *keep, size.alias("size")), "sizes")
    buckets = max(1, math.ceil(rows.count() / BUCKET))
    rows = rows.withColumn("o", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("bucket", F.floor((F.shiftrightunsigned("o", 40) * buckets) / float(1 << 24)).cast("int"))
    sums = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "buckets")
    sizes = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    sources = materialise(targets(weighted(sizes), repeats), "targets")
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0))).select("source", "bucket", "start")
    starts = starts.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "source_size", "target", "mass", "w0", "w1", "w2")
    within = Window.partitionBy("source", "bucket").orderBy("o", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("r")
    on = F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket"))
    out = dealt.join(starts.alias("b"), on).select("r.doc_id", "r.source", *[f"r.{c}" for c in keep], "r.size", "source_size", "target", "mass", "w0", "w1", "w2", (F.col("start") + F.col("within")).alias("before"))

    def copy(k: int) -> Column:
        before = F.col("before") + F.lit(k) * F.col("source_size")
        takes = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target") + 1e-6).cast("long") - before))
        return F.struct(F.lit(k).alias("copy"), position(before.cast("double")).alias("position"), takes.alias("words"))

    copies = F.filter(F.array(*[copy(k) for k in range(repeats)]), lambda c: c["words"] > 0)
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weighted=weights, repeats: int = REPEATS) -> DataFrame:
    """The mixed documents themselves, in training order: the columns of ``docs``, a row for each copy taken.

    A copy at which its source's demand ends has its text cut after the words taken, and n_chars to match where that
    column is there. Rows are range-sorted by position. The plan's rows find their documents by doc_id, source and the
    text's hash; rows that agree in all three, where there are any, take what the plan gives them in turn. Columns keep
    their names and values, whatever they are called: a row goes through the join as one value. Null and empty texts hold no words
    to be taken. An empty table gives an empty one.
    """
    hashed = F.xxhash64("text")
    nth = lambda *order: F.row_number().over(Window.partitionBy("id", "of").orderBy(*order))
    key = lambda h: [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("id"), F.xxhash64("source", h).alias("of")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *key(hashed))
    named = docs.select("doc_id", "source", "text", hashed.alias("hashed"))
    taken = materialise(plan(named, weighted, repeats, keep=("hashed",)).select(*key("hashed"), "copies").withColumn("nth", nth("copies")), "taken")
    if taken.where("nth > 1").isEmpty():  # no need to number the texts' rows as well, which would shuffle them once more
        rows = own.join(taken, ["id", "of"])
    else:
        rows = own.withColumn("nth", nth("doc.text")).join(taken, ["id", "of", "nth"])
    rows = rows.select("doc", F.explode("copies").alias("c"))
    text = F.col("doc.text")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    rows = rows.withColumn("less", F.col("c.words") < word_count(text))
    rows = rows.withColumn("cut", F.when(F.col("less"), F.array_join(F.slice(pieces, F.lit(1), F.col("c.words").cast("int")), "")))
    order = [F.col("c.position"), F.col("doc.doc_id")]
    rows = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    instead = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    column = lambda c: F.when(F.col("less"), instead[c]).otherwise(F.col("doc").getField(c)) if c in instead else F.col("doc").getField(c)
    return rows.select(*[column(c).alias(c) for c in docs.columns])
