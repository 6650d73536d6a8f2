"""The Bloom filter before a join, and the reference's filter over all documents."""

from __future__ import annotations

import hashlib

import pyarrow.parquet as pq
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from blobsight.functions import binary
from blobsight.operators import corpus, prefilter
from blobsight.plans import catalogue


def test_hits_and_about_one_other_of_a_hundred_pass(spark):
    keys = spark.range(0, 20_000).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(0, 400_000).select(F.col("id").cast("string").alias("k"), F.lit("clash").alias("word"), F.lit("clash").alias("bits"))
    left, right = prefilter.prefiltered(rows.unionAll(spark.sql("select cast(null as string), 'a', 'b'")), keys, "k")
    assert right is keys and left.columns == rows.columns
    passed = left.count()
    assert left.join(keys, "k", "left_semi").count() == 20_000 and passed < 20_000 + 380_000 / 100
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    print(f"passed {passed}: hits and {(passed - 20_000) / 3800:.2f} % of the others")
    swapped = prefilter.prefiltered(keys, rows, "k")
    assert swapped[0] is keys and swapped[1].count() == passed
    assert prefilter.prefiltered(keys, keys, "k")[0] is keys  # no side is much larger


def test_filters_of_parts_merge(spark):
    part = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("k"))
    both = prefilter.words_of(part(0, 500), "k", 64).unionAll(prefilter.words_of(part(500, 900), "k", 64)).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert shown(both) == shown(prefilter.words_of(part(0, 900), "k", 64))


def test_exact_join_shuffles_hits_and_little_else(spark):
    """As before row by row, where the corpus is much larger than what is looked up."""
    known = spark.range(100_000).select(F.format_string("cpe:%d", "id").alias("cpe_string"), F.col("id").alias("cve_id"))
    asked = spark.range(0, 300_000, 100).select(F.format_string(" CPE:%d ", "id").alias("cpe_string"), F.col("id").alias("seq"))
    found = corpus.exact(asked, known)
    assert sorted((r.seq, r.cve_id) for r in found.collect()) == [(i, i) for i in range(0, 100_000, 100)]
    _, right = prefilter.prefiltered(asked.withColumn("k", F.lower(F.trim("cpe_string"))), known.withColumn("k", F.col("cpe_string")), "k")
    assert right.count() < 1000 + 990


def test_prefiltered_join_as_sql_has_it(spark):
    at = "/root/testdata/sf0.01"
    assert spark_rows(catalogue.queries()["prefiltered_join"](spark, at)) == duck_rows(catalogue.oracle_sql()["prefiltered_join"], at)


def positions(key: str) -> list[int]:
    h1, h2 = (int.from_bytes(h(key.encode()).digest()) for h in (hashlib.sha256, hashlib.sha3_256))
    return [(h1 + i * (h2 | 1)) % binary.BLOOM_BITS for i in range(binary.BLOOM_HASHES)]


def test_bloom_positions_of_all_documents(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = sorted((d["doc_id"], i, p) for d in docs if d["text"] is not None for i, p in enumerate(positions(d["text"])))
    assert sorted((r.doc_id, r.i, r.position) for r in catalogue.queries()["bloom_positions"](spark, sf).collect()) == want


def test_bloom_probes_of_all_documents(spark, sf):
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist() if t is not None]
    inserted, probed = ({hashlib.sha256((t + end).encode()).hexdigest() for t in texts} for end in ("", "?"))
    bits = {p for k in inserted for p in positions(k)}
    want = {flag: (len(keys), sum(all(p in bits for p in positions(k)) for k in keys)) for flag, keys in ((True, inserted), (False, probed))}
    found = {r.inserted: (r.probes, r.positives) for r in catalogue.queries()["bloom_fpr_probe"](spark, sf).collect()}
    assert found == want and found[True][0] == found[True][1]
