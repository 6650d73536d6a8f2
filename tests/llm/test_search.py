"""Top-k search, spelling variants and hard negatives against brute force, and on edge cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from blobsight.llm import blocks, impact, negatives, queries, spelling

VECTORS = "vec_id long, embedding array<double>, label int"


def vector_rows() -> list[tuple]:
    """Ties, copies under other ids and the same one, nulls, parts that are not finite, odd widths, very large and zero parts."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) / 3], int(rng.integers(10))) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, -0.125, 0.0, 0.0, 1.0], i % 10) for i in range(120)]  # many equal rows
    rows += [(2000, None, 1), (2050, [0.1, None, 0.2], 1), (2100, [0.1, math.nan], 1), (2150, [math.inf, 0.1], 1), (2200, [0.1, -math.inf], 2)]
    rows += [(2250, [], 1), (2300, [0.0] * 6, 1), (2350, [0.7], 1), (2400, [0.3] * 9, 3), (2450, [90_000.0, -90_000.0, 90_000.0], 4), (2460, [90_000.0, 0.1, 1e-300], 5)]
    rows += [(2500, [0.4] * 6, None), (None, [0.4] * 6, 3), (None, None, None), (-50, [-0.4] * 6, 3)]
    return rows + [rows[7], rows[7], rows[50]]


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(256 * x) for x in vector]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, k=5):
    have = [(i, v) for i, x, _ in rows if (v := whole(x)) is not None]
    out = []
    for q, v in {(i, tuple(v)) for i, v in have if i is not None and i % 50 == 0}:
        found = sorted((-product(v, w), c is None, c or 0) for c, w in have if c != q)[:k]
        out += [(q, r + 1, None if null else c, -s) for r, (s, null, c) in enumerate(found)]
    return sorted(out, key=str)


def brute_mine(rows):
    have = [(i, v, lab) for i, x, lab in rows if (v := whole(x)) is not None and lab is not None]
    have = [(i, v, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in have]
    out = []
    for a, v, lab in {(i, tuple(v), lab) for i, v, lab in have if i is not None and i % 50 == 0}:
        scored = [(-product(v, w), c is None, c or 0, other == lab) for c, w, other in have if c != a]
        for p, null, pid, _ in sorted(x for x in scored if x[3])[:5]:
            fits = sorted(x for x in scored if not x[3] and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(a, None if null else pid, r + 1, None if n else c, -p, -s) for r, (s, n, c, _) in enumerate(fits)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vector_table(spark, tmp_path_factory):
    """The rows as a table of the data set, with columns whose names operators use themselves."""
    at = str(tmp_path_factory.mktemp("vectors"))
    rows = spark.createDataFrame(vector_rows(), VECTORS)
    rows.withColumns({n: F.lit("clash") for n in ("id", "v", "key", "block", "_q", "score", "rank", "place")}).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("components", [64, 1 << 19])
def test_top_k_by_brute_force(spark, vector_table, monkeypatch, components):
    monkeypatch.setattr(blocks, "ROW_COMPONENTS", components)
    rows = queries.vectors(spark, vector_table)
    found = impact.top_k(rows, rows.where("id % 50 = 0"), row_components=components)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_top(vector_rows())


@pytest.mark.parametrize("components", [64, 1 << 19])
def test_hard_negatives_by_brute_force(spark, vector_table, components):
    rows = queries.vectors(spark, vector_table).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = negatives.mine(rows, rows.where("id % 50 = 0"), row_components=components)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.columns == names and len(brute_mine(vector_rows())) > 50
    assert sorted(map(tuple, found.collect()), key=str) == brute_mine(vector_rows())


@pytest.mark.parametrize("name", ["op11_top_k_search", "op13_hard_negatives"])
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_vectors_as_sql_has_them(spark, name, folder):
    at = f"/root/testdata/{folder}"
    assert spark_rows(queries.queries()[name](spark, at)) == duck_rows(queries.oracle_sql()[name], at)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, label int, v array<int>")
    one = spark.createDataFrame([(50, 1, [3, 4])], "id long, label int, v array<int>")
    for rows, asked in ((none, none), (one, none), (none, one), (one, one)):
        assert impact.top_k(rows, asked).count() == 0 and negatives.mine(rows, asked).count() == 0


def test_search_stops_on_proof_before_all_rows_are_scored():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(4000, 64)) * 32).astype(np.int32)
    import pyarrow as pa

    index = impact.Index(impact._index(pa.table({"id": np.arange(4000), "v": list(x)})).to_pylist()[0])
    found = index.search(x[:64], list(range(64)), 5)
    assert index.scored < 64 * 4000 / impact.SHARE + 64 * 200  # most rows are never scored exactly
    score = x[:64].astype(int) @ x.T.astype(int)
    for i, (at, s) in enumerate(found):
        score[i, i] = -(1 << 60)
        best = np.lexsort((np.arange(4000), -score[i]))[:5]
        assert at.tolist() == best.tolist() and s.tolist() == score[i, best].tolist()


def test_planes_drop_rows_before_the_last():
    rng = np.random.default_rng(4)
    import pyarrow as pa

    x = np.floor(rng.normal(size=(4000, 64)) * 32).astype(np.int32)
    held = negatives.Planes(negatives._sliced(pa.table({"id": np.arange(4000), "label": np.zeros(4000, int), "v": list(x)})).to_pylist()[0])
    free = np.full((32, 1), -negatives.NO_LIMIT), np.full((32, 1), negatives.NO_LIMIT)
    i, _, row, score = held.best(x[:32], list(range(32)), [np.ones(4000, bool)] * 32, *free, 5)
    assert held.kept[-1] < 32 * 4000 / 20 and (score == (x[i].astype(int) * x[row]).sum(1)).all() and len(i) == 160


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute_near(words):
    near, gaps = {w: set() for w in words}, defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
            if (v := w[:i] + w[i + 1 :]) in near:
                near[v].add(w)
                near[w].add(v)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_variants(rows):
    n = brute_words(rows)
    near = brute_near(n)
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda v: (-n[v], v))] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def word_rows():
    """Chains of forms, ties, edits at both ends and in the middle, letters that are no ASCII, words of one segment, long ones."""
    counts = {"spelling": 40, "speling": 12, "spelin": 5, "pelin": 3, "spellings": 12, "Spelling": 2, "xspelling": 3, "spexlling": 3, "aaaaa": 9, "aaaab": 9, "aaaac": 3, "éclair": 30, "eclair": 3, "éclairs": 15, "Éclair": 4, "naïve×": 3, "naïve": 7, "bcdef": 2, "abcde": 2}
    counts |= {f"same{a}{b}end": 3 + (ord(a) + ord(b)) % 5 for a in "abcdefgh" for b in "abcdefgh"}
    counts |= {"long" * 5000: 6, "long" * 5000 + "x": 3, "long" * 2500 + "y" + "long" * 2500: 3}
    rows = [(i, f" {w}7" * c) for i, (w, c) in enumerate(counts.items())]
    return rows + [(None, "spelling speling"), (7, None), (8, ""), (9, " \t "), (9, "aaaaa"), (9, "aaaaa"), (97, "a b é " * 50_000)] + [(i, "spelling éclairs longer words here") for i in range(1000, 1400)]


@pytest.mark.parametrize("target, hot", [(spelling.TARGET, spelling.HOT), (40, 6)])
def test_spelling_variants_by_brute_force(spark, target, hot):
    docs = spark.createDataFrame(word_rows(), "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("word", "n", "kind", "size", "segment", "salt", "shard")})
    found = spelling.variants(docs, target, hot)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_variants(word_rows())


def test_spelling_variants_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    assert sorted(map(tuple, queries.op12_spelling_variants(spark, sf).collect()), key=str) == brute_variants(rows)


def test_near_pairs(spark, sf):
    words = spelling.vocabulary(queries.documents(spark, sf))
    near = brute_near([r.word for r in words.collect()])
    want = sorted((w, v) for w, some in near.items() for v in some)
    assert sorted(map(tuple, spelling.near_pairs(words).collect())) == want  # each pair once


def test_no_words(spark, empty):
    assert spelling.variants(empty).count() == 0
