"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold k - score). The score is one set of weights over hashed text features, shared by all
thresholds; thresholds are ordered. Words and their beginnings count by presence, so that one word tells in a long text as
in a short one; shapes of words and immediate repeats count by their share of the words. Only features that tell grades
apart in the rated sample get a weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from blobsight.llm.common import fresh, slices, words_of
from blobsight.scratch import materialise

#: Features are hashed to 2^BITS weights.
BITS = 18
SIZE = 1 << BITS
#: Rated documents that training takes, the first by the hash of their id: a bound on what is fitted only.
MOST_RATED = 12_000
EPOCHS, RATE, L2, BATCH = 40, 0.2, 1e-6, 64
#: Words whose features a task keeps.
MOST_WORDS = 300_000
#: A document stays if the odds of the highest grade are at least these.
LIMIT = 0.6
#: Lengths of the beginnings of words that are features too.
BEGINNINGS = (4, 5, 6)
#: A feature gets a weight if the shares of documents that have it, among those up to some grade and those above, are this
#: many standard errors apart.
APART = 6.0
_SHAPE = str.maketrans({c: "0" for c in "0123456789"})
_RUNS = re.compile(r"(.)\1+")
REPEAT = xxhash.xxh64_intdigest("again", 1) % SIZE


def grade(quality: Column, toxic: Column) -> Column:
    """0: poor; 1: good but toxic; 2: good. A null rating is not graded."""
    return quality.cast("int") * (2 - F.coalesce(toxic.cast("int"), F.lit(0)))


def _word(word: str) -> tuple[int, ...]:
    """Features of a word, of its beginnings, and of its shape."""
    bare = word.lower().strip(".,;:!?\"'()[]")
    shape = _RUNS.sub(r"\1", "".join("a" if c.islower() else "A" if c.isupper() else c for c in word.translate(_SHAPE)))
    digest = xxhash.xxh64_intdigest
    return digest(bare, 2) % SIZE, *(digest(bare[:n], 10 + n) % SIZE for n in BEGINNINGS), digest(shape, 3) % SIZE


class Features:
    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.table = np.zeros((0, len(BEGINNINGS) + 2), np.int64)

    def rows(self, texts: pa.Array, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value), by document; none for a text without words. With ``live``, a mask, only those features."""
        found, doc = words_of(texts)
        counts = np.bincount(doc, minlength=len(texts))
        coded = found.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.of) > MOST_WORDS:
            self.clear()
        new = [w for w in words if w not in self.of]
        if new:
            self.of.update(zip(new, range(len(self.of), len(self.of) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.array([_word(w) for w in new], np.int64)])
        codes = np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))[np.asarray(coded.indices)]
        pairs, times = np.unique((doc << 32) | codes, return_counts=True)  # a document's different words
        own, table = (pairs >> 32) << BITS, self.table[pairs & 0xFFFFFFFF]
        every = live is None
        plain = [column if every else column[live[column]] for column in table[:, :-1].T]
        present = np.unique(np.concatenate([(own if every else own[live[c]]) | x for c, x in zip(table[:, :-1].T, plain, strict=True)]))
        again = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) + 1
        shape = np.concatenate([own | table[:, -1], (doc[again] << BITS) | REPEAT]).astype(np.int64)
        times = np.concatenate([times, np.ones(len(again), np.int64)])
        shares, place = np.unique(shape, return_inverse=True)
        key = np.concatenate([present, shares])
        value = np.concatenate([np.ones(len(present)), 4.0 * np.bincount(place, times, len(shares)) / np.maximum(1, counts[shares >> BITS])])
        order = np.argsort(key, kind="stable")
        return key[order] >> BITS, key[order] & (SIZE - 1), value[order]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, n: int, doc: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.bincount(doc, self.weights[feature] * value, minlength=n)

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each threshold k, a row a score."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def telling(rated: DataFrame, levels: int, apart: float = APART) -> DataFrame:
    """(feature) of those in ``rated`` (grade, features: each once a document) that tell grades apart. Features that are spread alike over the grades only add noise."""
    n = {r["grade"]: float(r["count"]) for r in rated.groupBy("grade").count().collect()}  # a row for each grade
    each = rated.select("grade", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(*[F.count(F.when(F.col("grade") == k, 1)).cast("double").alias(f"n_{k}") for k in range(levels)])
    tells = F.lit(False)
    for k in range(1, levels):
        a, b = (sum(n.get(g, 0.0) for g in grades) for grades in (range(k), range(k, levels)))
        if a and b:
            x, y = (sum((F.col(f"n_{g}") for g in grades), F.lit(0.0)) for grades in (range(k), range(k, levels)))
            p = F.least(F.greatest((x + y) / (a + b), F.lit(1e-9)), F.lit(1 - 1e-9))
            tells |= F.abs(x / a - y / b) >= apart * F.sqrt(p * (1 - p) * (1 / a + 1 / b))
    return counts.where(tells).select("feature")


def fit(docs: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int) -> Model:
    """Adagrad on the cumulative likelihood. docs: (features, values) of each rated document."""
    grades = np.asarray(grades, np.int64)
    share = np.clip(np.array([(grades <= k).mean() if len(grades) else (k + 1) / levels for k in range(levels - 1)]), 1e-3, 1 - 1e-3)
    share = np.maximum.accumulate(share + 1e-6 * np.arange(levels - 1))
    model = Model(np.zeros(SIZE), np.log(share / (1 - share)))
    if not len(docs):
        return model
    squares, t_squares = np.full(SIZE, 1e-2), np.full(levels - 1, 1e-2)
    rng = np.random.default_rng(42)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            doc = np.repeat(np.arange(len(some)), [len(docs[i][0]) for i in some])
            feature, value = np.concatenate([docs[i][0] for i in some]), np.concatenate([docs[i][1] for i in some])
            y = grades[some]
            s = model.scores(len(some), doc, feature, value)
            c = np.concatenate([np.zeros((len(some), 1)), model.at_most(s), np.ones((len(some), 1))], 1)
            upper, lower = c[np.arange(len(y)), y + 1], c[np.arange(len(y)), y]
            slip = upper + lower - 1  # how the loss rises with the score
            weight, place = np.unique(feature, return_inverse=True)
            grad = np.bincount(place, -slip[doc] * value) / len(some) + L2 * model.weights[weight]
            squares[weight] += grad * grad
            model.weights[weight] -= RATE * grad / np.sqrt(squares[weight])
            slope, gap = c * (1 - c), np.maximum(upper - lower, 1e-9)
            t = np.zeros(levels - 1)
            np.add.at(t, y[y < levels - 1], -(slope[np.arange(len(y)), y + 1] / gap)[y < levels - 1])
            np.add.at(t, y[y > 0] - 1, (slope[np.arange(len(y)), y] / gap)[y > 0])
            t /= len(some)
            t_squares += t * t
            model.thresholds = np.sort(model.thresholds - RATE * t / np.sqrt(t_squares))
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in slices(batches, "text"):
        doc, feature, value = features.rows(batch.column("text"))
        cut = np.searchsorted(doc, np.arange(1, batch.num_rows))
        yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("o"), pa.array(np.split(feature.astype(np.int32), cut), pa.list_(pa.int32())), pa.array(np.split(value.astype(np.float32), cut), pa.list_(pa.float32()))], ["grade", "o", "features", "values"])


def _only(shared):
    """The rows of ``_vectors`` with the shared features alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.zeros(SIZE, bool)
        live[shared.value] = True
        for batch in batches:
            lists, values = batch.column("features"), pc.list_flatten(batch.column("values"))
            feature = pc.list_flatten(lists)
            kept = live[feature.to_numpy(zero_copy_only=False)]
            ends = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]]
            cut = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x.filter(pa.array(kept))) for x in (feature, values)]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("o"), *cut], ["grade", "o", "features", "values"])

    return run


def train(docs: DataFrame, ratings: DataFrame, levels: int = 3, most: int = MOST_RATED) -> Model:
    """Fit on ``docs`` (doc_id, text) rated by ``ratings`` (doc_id, grade from 0 to levels - 1).

    Of several ratings of a document the lowest counts, of several rows of a rated id the one with the least text; grades
    out of range are left out. The sample of ratings has a fixed bound, so it is broadcast to the documents. Which features
    tell is found in the tasks; the driver gets those of each document that do, which are few, and no others. Without
    ratings all documents get the same odds.
    """
    graded = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1)).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    some = graded.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade"), F.first("o").alias("o")).drop("doc_id")
    schema = "grade int, o long, features array<int>, values array<float>"
    rated = materialise(rows.mapInArrow(_vectors, schema), "rated")
    told = rated.sparkSession.sparkContext.broadcast(np.sort(telling(rated, levels).toArrow()["feature"].to_numpy()))
    found = rated.mapInArrow(_only(told), schema).toArrow().sort_by("o").combine_chunks()
    grades, lists = found["grade"].to_numpy(), found["features"]
    cut = np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]
    vectors = zip(*(np.split(pc.list_flatten(x).to_numpy(), cut) for x in (lists, found["values"])), strict=True) if len(found) else ()
    return fit(list(vectors), grades, levels)


def _judged(shared, grade_name: str = "expected_grade", tail_name: str = "tail_probability"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), Model(*shared.value)
        live = model.weights != 0
        for batch in slices(batches, "text"):
            below = model.at_most(model.scores(batch.num_rows, *features.rows(batch.column("text"), live)))
            out = {c: batch.column(c) for c in batch.schema.names}
            out[grade_name] = pa.array((1 - below).sum(1))
            out[tail_name] = pa.array(1 - below[:, -1])
            yield pa.RecordBatch.from_pydict(out)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, expected_grade, tail_probability: odds of the highest grade) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_judged(shared), "doc_id long, text string, expected_grade double, tail_probability double")


def judge(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) for every row of ``docs`` (doc_id, text; others are left out).

    Null and blank texts have no features; their odds are those of the thresholds alone.
    """
    return score(docs, model).select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= limit).alias("kept"))


def keep_good(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, in one pass and without a shuffle. Null and empty texts have
    the grade of a text without features; repeated rows are kept or left each; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    names = [fresh(docs.columns, c) for c in ("expected_grade", "tail_probability")]
    schema = StructType([*docs.schema.fields, *[StructField(c, DoubleType()) for c in names]])
    return docs.mapInArrow(_judged(shared, *names), schema).where(F.col(names[1]) >= limit).drop(*names)
