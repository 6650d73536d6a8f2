"""The registered queries of this package: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobsight.llm import blocks, impact, ledger, lm, mixing, negatives, pieces, quality, rans, rules, simhash, spelling, urls, winnowing
from blobsight.llm.common import partitions
from blobsight.scratch import new_path


def vocabulary(name: str) -> str:
    """A public tokenizer's file. Its path is a parameter of the operators; this is the queries' choice."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix's plan, a row a document, range-sorted by the first position (documents that the mix leaves out last)."""
    rows = mixing.plan(documents(spark, sf_dir))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    first = F.array_min(F.transform("copies", lambda c: c["position"]))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), first.alias("first_position"))
    order = [F.asc_nulls_last("first_position"), F.col("doc_id")]
    return rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """The quality classifier, fitted on the rated documents of the data set."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.train(documents(spark, sf_dir), labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), quality_model(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edited(documents(spark, sf_dir))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces, in the segmentation of the greatest sum of their scores."""
    return pieces.encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), by_scores=True)


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*ledger.BASE))
    return rows.select("doc_id", *[count(k) for k in ledger.BASE], F.sha2(ledger.joined(base), 256).alias("base_sha256"), ledger.joined(F.col("spans")).alias("spans"))


def secret_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every document under two versions of the rules: (path, version, rules, run, n_assign, n_access, n_hex), run
    being the one of the rules' runs that scanned the blob. Each document's first version may hold a token that its second
    one lacks. The ledger is opened again for each step: the second run scans only blobs that the first one hasn't seen, and
    with the new rules all of them are scanned once more."""
    docs, at = documents(spark, sf_dir), new_path(spark, "ledger")
    path, odd = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.pmod("doc_id", F.lit(2)) == 1
    leak = F.when(odd, F.concat(F.lit(" token=abcdef"), F.col("doc_id").cast("string"))).otherwise("")
    first = docs.select(path, F.lit(1).alias("version"), F.concat(ledger.body(), leak).alias("text"))
    both = first.unionAll(docs.select(path, F.lit(2).alias("version"), ledger.body().alias("text")))
    few, base = (tuple(r for r in ledger.RULES if r.kind in kinds) for kinds in (("assign", "access"), ledger.BASE))
    ledger.Ledger(spark, at, few).record(first)
    old = ledger.Ledger(spark, at, few)
    old.record(both)
    new = ledger.Ledger(spark, at, base)
    new.update(both)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    parts = [book.history().join(book.table(), "blob").select("path", "version", F.lit(n).alias("rules"), "run", *[count(k) for k in ledger.BASE]) for n, book in ((1, old), (2, new))]
    return parts[0].unionAll(parts[1])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = rans.write(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return rans.read(spark, path)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, v): whole numbers of the embeddings that are there and finite."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(blocks.usable(F.col("embedding")))
    return rows.select(F.col("vec_id").alias("id"), "label", blocks.integers(F.col("embedding")).alias("v"))


def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return impact.top_k(rows, rows.where("id % 50 = 0"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, rows.where("id % 50 = 0"))


def queries() -> dict:
    ops = (
        op1_mix_sources,
        op2_quality_classifier,
        op3_simhash,
        op4_winnowing,
        op5_lm_score,
        op6_sentence_pieces,
        viterbi_pieces,
        op7_secret_ledger,
        secret_history,
        op8_token_files,
        op9_url_filter,
        op10_quality_rules,
        op11_top_k_search,
        op12_spelling_variants,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in ops}


ASSIGN_SQL = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRET_HISTORY_SQL = rf"""WITH v AS (SELECT 'doc/' || doc_id AS path, 1 AS version, coalesce(text, '') || CASE WHEN doc_id % 2 = 1 THEN ' token=abcdef' || doc_id ELSE '' END AS text FROM documents
 UNION ALL SELECT 'doc/' || doc_id, 2, coalesce(text, '') FROM documents),
 n AS (SELECT *, len(list_filter(regexp_extract_all(text, '{ASSIGN_SQL}', 1), lambda x: length(x) >= 6))::BIGINT AS n_assign,
 len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex FROM v)
 SELECT path, version, 1 AS rules, CASE WHEN text IN (SELECT text FROM v WHERE version = 1) THEN 0 ELSE 1 END AS run, n_assign, n_access, 0::BIGINT AS n_hex FROM n
 UNION ALL SELECT path, version, 2, 0, n_assign, n_access, n_hex FROM n"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS))
QUALITY_RULES_SQL = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^ 	-
]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM t),
 win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 rep AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1) GROUP BY r),
 m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
 len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOP})))::DOUBLE AS n_stop, len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x))::DOUBLE AS n_shout FROM w LEFT JOIN rep USING (r)),
 q AS (SELECT *, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbol_ratio, coalesce(n_stop / nullif(n_words, 0), 0) AS stop_ratio,
 coalesce(n_shout / nullif(n_words, 0), 0) AS shout_ratio, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words <= 10000000 AND mean_word BETWEEN 2 AND 14 AND symbol_ratio <= 0.2 AND stop_ratio >= 0.02
 AND dup_line_ratio <= 0.3 AND shout_ratio <= 0.4 AS kept, mean_word, symbol_ratio, stop_ratio, shout_ratio, dup_line_ratio FROM q"""


_VECTORS = "SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
TOP_K_SQL = f"""WITH v AS ({_VECTORS}),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

HARD_NEGATIVES_SQL = f"""WITH u AS ({_VECTORS}),
 v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM u WHERE label IS NOT NULL),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


def oracle_sql() -> dict[str, str]:
    """What DuckDB can express; the other operators are held against brute force in the tests."""
    return {"secret_history": SECRET_HISTORY_SQL, "op10_quality_rules": QUALITY_RULES_SQL, "op11_top_k_search": TOP_K_SQL, "op13_hard_negatives": HARD_NEGATIVES_SQL}
