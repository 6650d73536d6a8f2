"""Corpus and matching queries: parts stand for components, orders for sub-blobs, vectors for records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsight.functions import cpe, families, text, vectors
from blobsight.operators import cells, corpus, embedding, matching, prefilter, similarity
from blobsight.plans.registry import Tables, query
from blobsight.scratch import dealt, spread
from blobsight.sources.nvd import CVE

# Families of the driver's parts (the second word of a part's name is its product).
PART_FAMILIES = (
    ("fasteners", ("brand#1", "brand#2"), ("bolt", "rod")),
    ("rotary", ("brand#3",), ("gear", "ring")),
    ("sheet", ("brand#4", "brand#5"), ("plate",)),
)
# Thresholds of some families of vectors.
LABEL_THRESHOLDS = ((0, 0.95, 0.8, 0.6), (1, 0.87, 0.67, 0.47), (2, 0.9, 0.5, 0.1))

COUNTS = embedding.HashingEmbedder(unit=False)

COMP = """comp AS (SELECT p_partkey, p_brand, lower(p_brand) AS vendor, split_part(p_name, ' ', 2) AS product,
 p_size || '.' || (p_partkey % 10) AS version, CASE WHEN split_part(p_name, ' ', 2) IN ('bolt', 'rod') THEN 'fasteners'
 WHEN split_part(p_name, ' ', 2) IN ('gear', 'ring') THEN 'rotary' WHEN split_part(p_name, ' ', 2) = 'plate' THEN 'sheet' END AS family, p_name FROM part)"""
DIM = """dim AS (SELECT * FROM (VALUES ('fasteners','brand#1','bolt'),('fasteners','brand#1','rod'),('fasteners','brand#2','bolt'),('fasteners','brand#2','rod'),
 ('rotary','brand#3','gear'),('rotary','brand#3','ring'),('sheet','brand#4','plate'),('sheet','brand#5','plate')) t(family, v, p))"""
CANDIDATES = f"""{COMP}, {DIM}, cand AS (SELECT p_partkey, 'cpe:2.3:a:' || vendor || ':' || product || ':' || version || ':*:*:*:*:*:*:*' AS cpe_string FROM comp
 UNION SELECT p_partkey, 'cpe:2.3:a:' || v || ':' || p || ':' || version || ':*:*:*:*:*:*:*' FROM comp JOIN dim USING (family))"""
RECORDS = """rec AS (SELECT DISTINCT 'CVE-' || p_partkey // 4 AS cve_id, 'cpe:2.3:a:' || vendor || ':' || product || ':' || v || ':*:*:*:*:*:*:*' AS cpe_string, family, p_name, vendor || ' ' || product || ' ' || v || ': ' || p_name AS text
 FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN version ELSE '9' || version END AS v FROM comp) WHERE family IS NOT NULL)"""
TIERED = """means AS (SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),
 scored AS (SELECT vec_id, label, least(1.0::DOUBLE, 4 * greatest(0.0::DOUBLE, list_cosine_similarity(embedding::DOUBLE[], mean))) AS s FROM embeddings JOIN means USING (label)),
 tiered AS (SELECT vec_id, label, s, CASE WHEN s >= 0.9 THEN 'HIGH_CONFIDENCE' WHEN s >= 0.7 THEN 'POSSIBLE' WHEN s >= 0.5 THEN 'LOW_CONFIDENCE' ELSE 'NO_MATCH' END AS tier FROM scored)"""
RANK = "CASE tier WHEN 'CONFIRMED' THEN 4 WHEN 'HIGH_CONFIDENCE' THEN 3 WHEN 'POSSIBLE' THEN 2 WHEN 'LOW_CONFIDENCE' THEN 1 WHEN 'NO_MATCH' THEN 0 END"


def components(t: Tables) -> DataFrame:
    """(p_partkey, c: normalised component, p_name) of all parts, dealt out: they are few bytes, but much work each."""
    product = F.split("p_name", " ")[1]
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    return spread(t.part.select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey").select("p_partkey", "p_name", cpe.normalise(F.col("p_brand"), product, version, PART_FAMILIES).alias("c"))


def feed(t: Tables, rows: DataFrame) -> DataFrame:
    """Parts as records of a vulnerability feed, by way of its JSON; two thirds of them are listed with another version, so that
    their components have no exact hit."""
    version = F.when(F.col("p_partkey") % 3 == 0, F.col("c.version")).otherwise(F.concat(F.lit("9"), F.col("c.version")))
    name = cpe.build(F.col("c.vendor"), F.col("c.product"), version)
    cve = F.struct(
        F.concat(F.lit("CVE-"), F.floor(F.col("p_partkey") / 4).cast("string")).alias("id"),
        F.array(F.struct(F.lit("fr").alias("lang"), F.lit("x").alias("value")), F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value"))).alias("descriptions"),
        F.array(F.struct(F.array(F.struct(F.lit("OR").alias("operator"), F.array(F.struct(F.lit(True).alias("vulnerable"), name.alias("criteria"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
    )
    return rows.select(F.from_json(F.to_json(cve), CVE).alias("x")).select("x.*")


def part_records(t: Tables) -> DataFrame:
    return corpus.records(feed(t, components(t)), PART_FAMILIES)


def scored(t: Tables) -> DataFrame:
    """(vec_id, label, s, tier): each vector by four times its cosine to the mean of its label's, as vectors lie far apart here."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m")))["m"].alias("mean"))  # a vector's width each
    s = F.least(F.lit(1.0), 4 * vectors.cosine(F.col("embedding"), F.col("mean")))
    return t.embeddings.join(means, "label").select("vec_id", "label", s.alias("s")).withColumn("tier", families.tier(F.col("s")))


@query(f"WITH {COMP}, {RECORDS} SELECT cve_id, cpe_string, family, p_name AS description FROM rec")
def nvd_flatten(t: Tables) -> DataFrame:
    return part_records(t).select("cve_id", "cpe_string", "family", "description").distinct()


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def corpus_upsert_latest(t: Tables) -> DataFrame:
    return corpus.latest(t.events, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id AS k, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS v FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def upsert_replaces(t: Tables) -> DataFrame:
    """Views and clicks, with clicks and purchases in their place."""
    side = lambda v, *kinds: t.events.where(F.col("event_type").isin(*kinds)).select(F.col("event_id").alias("k"), F.lit(v).alias("v"))
    return corpus.upsert(side(0, "view", "click"), side(1, "click", "purchase"), ("k",))


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def incremental_window(t: Tables) -> DataFrame:
    return corpus.changed_between(t.events, "ts", F.expr("timestamp_ntz'2024-01-10 00:00:00'"), F.expr("timestamp_ntz'2024-01-12 12:00:00'")).select("event_id", "ts")


@query(f"WITH {COMP}, {RECORDS} SELECT family, count(*) AS records, count(DISTINCT cve_id) AS cves FROM rec GROUP BY family")
def etl_family_metrics(t: Tables) -> DataFrame:
    return corpus.metrics(part_records(t).distinct())


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'a' END AS part, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE lower(p_brand) END AS vendor,
 CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE split_part(p_name, ' ', 2) END AS product, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '*' END AS version FROM part""")
def parse_cpe_fields(t: Tables) -> DataFrame:
    product = F.split("p_name", " ")[1]
    new = cpe.build(F.col("p_brand"), product, F.col("p_size").cast("string"))
    old = F.concat(F.lit("cpe:/a:"), F.lower("p_brand"), F.lit(":"), product)
    kind = F.col("p_partkey") % 3
    parts = cpe.parse(F.when(kind == 0, new).when(kind == 1, old).otherwise(F.col("p_name")))
    return t.part.select("p_partkey", parts.alias("c")).select("p_partkey", "c.part", "c.vendor", "c.product", "c.version")


@query(f"WITH {COMP} SELECT p_partkey, 'cpe:2.3:a:' || vendor || ':' || product || ':' || version || ':*:*:*:*:*:*:*' AS cpe_string FROM comp")
def build_cpe_key(t: Tables) -> DataFrame:
    return components(t).select("p_partkey", cpe.build(F.col("c.vendor"), F.col("c.product"), F.col("c.version")).alias("cpe_string"))


@query(f"WITH {COMP} SELECT p_partkey, family, family IS NOT NULL AS in_scope FROM comp")
def family_scope(t: Tables) -> DataFrame:
    return components(t).select("p_partkey", "c.family", families.in_scope(F.col("c.product"), PART_FAMILIES).alias("in_scope"))


@query(f"WITH {CANDIDATES} SELECT p_partkey, cpe_string FROM cand")
def candidate_cpe_cross(t: Tables) -> DataFrame:
    return components(t).select("p_partkey", F.explode(cpe.candidates(F.col("c"), PART_FAMILIES)).alias("cpe_string"))


@query(r"SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '\d+(?:\.\d+){1,3}[a-z]?'), '') AS version FROM documents")
def extract_version(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", cpe.extract_version(F.col("text"), F.lit(None).cast("string")).alias("version"))


def lines(t: Tables) -> DataFrame:
    """(sub_blob_id, seq): a component counts once a sub-blob. Dealt by component, as what follows joins by it."""
    return dealt(t.lineitem.select(F.col("l_orderkey").alias("sub_blob_id"), F.col("l_partkey").alias("seq")), t.lineitem.count(), "seq").distinct()


def candidates(t: Tables) -> DataFrame:
    """(sub_blob_id, seq, cpes, family, text) of each component, whatever sub-blobs hold it."""
    return components(t).select(F.lit("").alias("sub_blob_id"), F.col("p_partkey").alias("seq"), cpe.candidates(F.col("c"), PART_FAMILIES).alias("cpes"), F.col("c.family").alias("family"), F.col("c.raw_text").alias("text"))


@query(f"WITH {CANDIDATES}, {RECORDS}, lines AS (SELECT DISTINCT l_orderkey AS sub_blob_id, l_partkey AS p_partkey FROM lineitem) SELECT sub_blob_id, p_partkey AS seq, cve_id FROM (SELECT DISTINCT p_partkey, cve_id FROM cand JOIN rec USING (cpe_string)) JOIN lines USING (p_partkey)")
def exact_cpe_join(t: Tables) -> DataFrame:
    return matching.exact_lines(lines(t), candidates(t), part_records(t))


@query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000) ON l_orderkey = o_orderkey")
def prefiltered_join(t: Tables) -> DataFrame:
    """Lines of costly urgent orders: a filter of these orders' keys drops other lines before the shuffle."""
    chosen = t.orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    left, right = prefilter.prefiltered(t.lineitem.select("l_orderkey", "l_linenumber"), chosen, "l_orderkey")
    return left.join(right, "l_orderkey").select("l_orderkey", "l_linenumber", "o_totalprice")


@query(f"WITH {CANDIDATES}, {RECORDS} SELECT DISTINCT l_orderkey AS sub_blob_id, l_partkey AS seq FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey NOT IN (SELECT p_partkey FROM cand JOIN rec USING (cpe_string))")
def fallback_anti(t: Tables) -> DataFrame:
    return matching.lines_without_hit(lines(t), candidates(t), part_records(t))


def _knn_sql(scoped: bool) -> str:
    on = "q.label = c.label" if scoped else "true"
    return f"""SELECT qid, id, score, rank FROM (SELECT q.vec_id AS qid, c.vec_id AS id, round(greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q JOIN embeddings c ON {on}) WHERE rank <= 5"""


def _knn(t: Tables, *scope) -> DataFrame:
    queries = t.embeddings.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"), *scope)
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), *scope)
    return similarity.top_k(queries, rows, 5).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_knn_sql(False))
def knn_topk(t: Tables) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    return _knn(t)


@query(_knn_sql(False))
def cells_topk(t: Tables) -> DataFrame:
    """The same by an index of cells, exact by its bounds."""
    index = cells.build(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    queries = t.embeddings.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return index.exact(queries, 5).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def cells_probed(t: Tables) -> DataFrame:
    """The same approximately: as many cells as an earlier measurement takes to find 95 of 100 true neighbours."""
    index = cells.build(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    queries = t.embeddings.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return index.search(queries, 5, index.probes_for(5)).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(_knn_sql(True))
def knn_job_scoped(t: Tables) -> DataFrame:
    return _knn(t, F.col("label").alias("scope"))


@query(f"WITH {TIERED} SELECT vec_id, tier, {RANK} AS tier_rank FROM tiered WHERE tier <> 'NO_MATCH'")
def tier_scores(t: Tables) -> DataFrame:
    return scored(t).where("tier <> 'NO_MATCH'").select("vec_id", "tier", families.tier_rank(F.col("tier")).alias("tier_rank"))


@query(f"""WITH {TIERED}, th AS (SELECT * FROM (VALUES (0, 0.95, 0.8, 0.6), (1, 0.87, 0.67, 0.47), (2, 0.9, 0.5, 0.1)) v(label, high, possible, low)) SELECT vec_id,
 CASE WHEN s >= coalesce(high, 0.9)::DOUBLE THEN 'HIGH_CONFIDENCE' WHEN s >= coalesce(possible, 0.7)::DOUBLE THEN 'POSSIBLE' WHEN s >= coalesce(low, 0.5)::DOUBLE THEN 'LOW_CONFIDENCE' ELSE 'NO_MATCH' END AS tier FROM tiered LEFT JOIN th USING (label)""")
def tier_family_threshold(t: Tables) -> DataFrame:
    th = t.spark.createDataFrame(LABEL_THRESHOLDS, "family int, high double, possible double, low double")
    rows = matching.with_thresholds(scored(t).select("vec_id", "s", F.col("label").alias("family")), th)
    return rows.select("vec_id", families.tier(F.col("s"), F.col("high"), F.col("possible"), F.col("low")).alias("tier"))


def _found(t: Tables) -> DataFrame:
    return scored(t).where("tier <> 'NO_MATCH'").select(F.col("label").alias("sub_blob_id"), (F.col("vec_id") % 12).alias("cve_id"), F.col("tier").alias("confidence_tier"), F.col("s").alias("similarity_score"), F.col("vec_id").alias("seq"))


BEST = f"best AS (SELECT label AS sub_blob_id, vec_id % 12 AS cve_id, tier AS confidence_tier, vec_id AS seq FROM tiered WHERE tier <> 'NO_MATCH' QUALIFY row_number() OVER (PARTITION BY label, vec_id % 12 ORDER BY {RANK} DESC, s DESC, vec_id) = 1)"


@query(f"WITH {TIERED}, {BEST} SELECT * FROM best")
def best_per_cve(t: Tables) -> DataFrame:
    return matching.best_per_cve(_found(t)).select("sub_blob_id", "cve_id", "confidence_tier", "seq")


@query(f"WITH {TIERED}, {BEST} SELECT sub_blob_id, cve_id, row_number() OVER (PARTITION BY sub_blob_id ORDER BY {RANK.replace('CASE tier', 'CASE confidence_tier')} DESC, cve_id) AS place FROM best")
def match_order(t: Tables) -> DataFrame:
    return matching.ordered(matching.best_per_cve(_found(t))).select("sub_blob_id", "cve_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {TIERED}, m AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'CONFIRMED' ELSE tier END AS tier, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE s END AS s, CASE WHEN vec_id % 2 = 0 THEN 'exact_cpe' ELSE 'embedding_similarity' END AS via,
 CASE WHEN vec_id % 3 = 0 THEN 'because' END AS why FROM tiered) SELECT vec_id, ((via = 'exact_cpe' AND s IS NULL AND tier = 'CONFIRMED') OR (via = 'embedding_similarity' AND s IS NOT NULL AND tier <> 'CONFIRMED'))
 AND (why IS NULL OR tier IN ('POSSIBLE', 'LOW_CONFIDENCE')) AND tier <> 'NO_MATCH' AS valid, tier IN ('POSSIBLE', 'LOW_CONFIDENCE') AS needs_rationale FROM m""")
def match_invariants(t: Tables) -> DataFrame:
    exact = F.col("vec_id") % 5 == 0
    tier, score = F.when(exact, "CONFIRMED").otherwise(F.col("tier")), F.when(~exact, F.col("s"))
    via, why = F.when(F.col("vec_id") % 2 == 0, "exact_cpe").otherwise("embedding_similarity"), F.when(F.col("vec_id") % 3 == 0, "because")
    return scored(t).select("vec_id", families.valid_match(tier, via, score, why).alias("valid"), families.needs_rationale(tier).alias("needs_rationale"))


def _buckets(name: str, keys: str, text: str, source: str) -> str:
    """Counts of hashed words, and their length, of a text in SQL."""
    return rf"""{name} AS (SELECT {keys}, (('0x' || sha256(w)[1:8])::UBIGINT % 384)::INT AS bucket, count(*) AS n FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}._-]+')) AS w FROM {source}) GROUP BY ALL),
 {name}_n AS (SELECT {keys}, sqrt(sum(n::DOUBLE * n)) AS len FROM {name} GROUP BY ALL)"""


NEAREST = f"""{_buckets("cb", "p_partkey", "p_brand || ' ' || product || ' ' || version", "comp")}, {_buckets("rb", "cve_id, cpe_string", "text", "rec")},
 near AS (SELECT p_partkey, cve_id, cpe_string, d / (cb_n.len * rb_n.len) AS s FROM (SELECT p_partkey, cve_id, cpe_string, sum(cb.n::DOUBLE * rb.n) AS d FROM cb JOIN rb USING (bucket) WHERE p_partkey NOT IN (SELECT seq FROM hits) GROUP BY ALL) JOIN cb_n USING (p_partkey) JOIN rb_n USING (cve_id, cpe_string)
 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY least(1, s) DESC, cve_id, cpe_string) <= 5),
 fz AS (SELECT p_partkey AS seq, cve_id, CASE WHEN s >= 0.9 THEN 'HIGH_CONFIDENCE' WHEN s >= 0.7 THEN 'POSSIBLE' ELSE 'LOW_CONFIDENCE' END AS tier, round(least(1, s), 4) AS s FROM near WHERE s >= 0.5)"""


@query(f"""WITH {CANDIDATES}, {RECORDS}, lines AS (SELECT DISTINCT l_orderkey AS sub_blob_id, l_partkey AS seq FROM lineitem), hits AS (SELECT DISTINCT p_partkey AS seq, cve_id FROM cand JOIN rec USING (cpe_string)), {NEAREST},
 found AS (SELECT seq, cve_id, 'CONFIRMED' AS tier, NULL::DOUBLE AS s FROM hits UNION ALL SELECT * FROM fz)
 SELECT sub_blob_id, cve_id, tier AS confidence_tier, s AS similarity_score FROM lines JOIN found USING (seq) QUALIFY row_number() OVER (PARTITION BY sub_blob_id, cve_id ORDER BY {RANK} DESC, coalesce(s, 0) DESC, seq) = 1""")
def match_end_to_end(t: Tables) -> DataFrame:
    """The flagship: exact hits of each component; for those without one the five nearest records by their texts' hashed words; the
    best of each CVE in each sub-blob."""
    records = corpus.with_embeddings(part_records(t), COUNTS)  # counts, not vectors of length 1, make cosines exact: equal ones are equal in SQL too
    found = matching.match_lines(lines(t), candidates(t).drop("sub_blob_id"), records, embedder=COUNTS)
    return found.select("sub_blob_id", "cve_id", "confidence_tier", "similarity_score")


@query(f"WITH {_buckets('b', 'p_partkey', 'p_name', 'part')} SELECT p_partkey, bucket, round((n / len)::FLOAT::DOUBLE, 6) AS value FROM b JOIN b_n USING (p_partkey)")
def hash_embedding(t: Tables) -> DataFrame:
    """Dense vectors of length 1, by their numbers above zero."""
    v = t.part.select("p_partkey", F.posexplode(embedding.embedded(F.col("p_name"))).alias("bucket", "x"))
    return v.where("x > 0").select("p_partkey", "bucket", F.round(F.col("x").cast("double"), 6).alias("value"))


@query("SELECT DISTINCT l_orderkey AS source_sub_blob_id, p_brand AS vendor, split_part(p_name, ' ', 2) AS product, p_size::VARCHAR AS version FROM lineitem JOIN part ON l_partkey = p_partkey")
def sbom_components(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return matching.sbom(rows.select(F.col("l_orderkey").alias("source_sub_blob_id"), F.col("p_brand").alias("vendor"), F.split("p_name", " ")[1].alias("product"), F.col("p_size").cast("string").alias("version")))


@query("""SELECT p_partkey, CASE WHEN x = '' THEN 'CVE-' || p_partkey ELSE x END AS corpus_text FROM (SELECT p_partkey, trim(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand || ' ' || split_part(p_name, ' ', 2) || ' ' || p_size END || ': ' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END, ': ') AS x FROM part)""")
def corpus_text(t: Tables) -> DataFrame:
    known = F.col("p_partkey") % 7 != 0
    own = lambda c: F.when(known, c).otherwise("")
    made = text.corpus_text(own(F.col("p_brand")), own(F.split("p_name", " ")[1]), own(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type")), F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")))
    return t.part.select("p_partkey", made.alias("corpus_text"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(1, 65), lambda x: x::DOUBLE)), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], list_transform(range(1, 65), lambda x: x::DOUBLE)) > 0")
def cosine_columns(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", vectors.cosine(vectors.normalised(F.col("embedding")), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))).alias("score"))
    return rows.where("score > 0").select("vec_id", F.round("score", 6).alias("score"))
