"""Jobs, events, feedback and retrieval queries: users stand for jobs, event types for topics."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blobsight.functions import families
from blobsight.operators import corpus, embedding, feedback, rag, report
from blobsight.plans.registry import Tables, query
from blobsight.scratch import materialise, new_path
from blobsight.sources import events as contracts
from blobsight.sources import stores
from blobsight.sources.indexes import BucketIndexes
from blobsight.sources.tables import MergeTable, replacing
from blobsight.streaming import failures
from blobsight.streaming import jobs as streams

#: Topics in place of the driver's event types.
TOPIC = {"signup": "extracted", "view": "analyzed", "click": "matched", "purchase": "extraction_complete", "error": "error"}
TOPIC_SQL = "CASE event_type WHEN 'signup' THEN 'extracted' WHEN 'view' THEN 'analyzed' WHEN 'click' THEN 'matched' WHEN 'purchase' THEN 'extraction_complete' ELSE 'error' END"
CONTRACT_SQL = "CASE event_type WHEN 'signup' THEN 'firmware.uploaded' WHEN 'view' THEN 'firmware.extracted' WHEN 'click' THEN 'firmware.matched' WHEN 'purchase' THEN 'firmware.analyzed' ELSE 'firmware.dlq' END"


def hashed_sql(name: str, key: str, source: str) -> str:
    """Counts of hashed words of ``text``, and their length, in SQL; a text without words is one word of itself."""
    return rf"""{name} AS (SELECT {key}, (('0x' || sha256(w)[1:8])::UBIGINT % 384)::INT AS bucket, count(*) AS n FROM (SELECT {key}, unnest(CASE WHEN len(ws) > 0 THEN ws ELSE [coalesce(nullif(text, ''), 'empty')] END) AS w
 FROM (SELECT {key}, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}._-]+') AS ws FROM {source})) GROUP BY ALL), {name}_n AS (SELECT {key}, sqrt(sum(n::DOUBLE * n)) AS len FROM {name} GROUP BY ALL)"""


def topic():
    pairs = [F.lit(x) for p in TOPIC.items() for x in p]
    return F.create_map(*pairs)[F.col("event_type")]


def contract():
    return F.when(F.col("event_type") == "signup", "firmware.uploaded").when(F.col("event_type") == "view", "firmware.extracted").when(F.col("event_type") == "click", "firmware.matched").when(F.col("event_type") == "purchase", "firmware.analyzed").otherwise("firmware.dlq")


def job_events(t: Tables) -> DataFrame:
    """Events by job (user and day), their sub-blob by the number in their properties."""
    job = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.dayofmonth("ts").cast("string"))
    return t.events.select(job.alias("job_id"), topic().alias("topic"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("sub_blob_id"))


@query(f"""SELECT job_id, total, matched, marker, marker AND total > 0 AND matched >= total AS ready FROM (SELECT user_id || '/' || day(ts) AS job_id, count(DISTINCT CASE WHEN {TOPIC_SQL} = 'extracted' THEN json_extract(props, '$.k')::BIGINT % 3 END) AS total,
 count(DISTINCT CASE WHEN {TOPIC_SQL} = 'matched' THEN json_extract(props, '$.k')::BIGINT % 3 END) AS matched, bool_or({TOPIC_SQL} = 'extraction_complete') AS marker FROM events GROUP BY 1)""")
def completion_gate(t: Tables) -> DataFrame:
    return report.gate(job_events(t))


@query("""WITH RECURSIVE nxt AS (SELECT a.event_id, arg_min(b.event_id, b.ts) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts + INTERVAL 24 HOURS GROUP BY 1),
 let_in AS (SELECT arg_min(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type UNION ALL SELECT nxt.n FROM let_in JOIN nxt USING (event_id)) SELECT event_id FROM let_in""")
def idempotent_claim(t: Tables) -> DataFrame:
    return streams.first_claims(t.events, ["user_id", "event_type"], "ts").select("event_id")


@query(f"""SELECT user_id AS job_id, count(*) FILTER ({TOPIC_SQL} = 'extracted') AS extracted, count(*) FILTER ({TOPIC_SQL} = 'matched') AS matched, arg_max({TOPIC_SQL}, ts) AS latest,
 count(*) FILTER ({TOPIC_SQL} = 'matched') || '/' || count(*) FILTER ({TOPIC_SQL} = 'extracted') AS progress, CASE WHEN count(*) FILTER ({TOPIC_SQL} = 'extracted') > 0 THEN floor(1000.0::DOUBLE * count(*) FILTER ({TOPIC_SQL} = 'matched') / count(*) FILTER ({TOPIC_SQL} = 'extracted') + 0.5) / 10 ELSE 0.0 END AS percent FROM events GROUP BY user_id""")
def progress_snapshot(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("job_id"), topic().alias("stage"), "ts")
    return report.progress(rows, ("extracted", "matched"), "extracted", "matched")


@query("SELECT user_id AS job_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, count(*) - 1 AS dropped FROM events GROUP BY user_id")
def latest_wins(t: Tables) -> DataFrame:
    last = F.max_by(F.struct("event_id", "value"), "ts").alias("last")
    return t.events.groupBy(F.col("user_id").alias("job_id")).agg(last, (F.count("*") - 1).alias("dropped")).select("job_id", "last.event_id", "last.value", "dropped")


@query("""WITH j AS (SELECT conv_id, timestamp '2024-01-01 00:00:00' + to_minutes((conv_id % 600)::INT) AS created, turn, text FROM conversations)
 SELECT conv_id::VARCHAR AS job_id, count(DISTINCT turn || ':' || coalesce(text, '')) AS chunks FROM j WHERE timestamp '2024-01-01 05:30:00' - created <= INTERVAL 1 HOUR GROUP BY 1""")
def index_sweep(t: Tables) -> DataFrame:
    """Indexes of conversations, built through ten hours by turns; what a sweep after five and a half leaves of them."""
    kept, now = BucketIndexes(t.spark, new_path(t.spark, "indexes")), datetime(2024, 1, 1, 5, 30, tzinfo=UTC)
    began = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("job_id").cast("long"), F.lit(600)) * 60)
    body = F.concat_ws(":", F.col("turn").cast("string"), F.coalesce("text", F.lit("")))
    chunks = t.conversations.select(F.col("conv_id").cast("string").alias("job_id"), body.alias("text")).distinct()
    kept.build(chunks.select("job_id", F.sha2("text", 256).alias("id"), "text", F.array().cast("array<float>").alias("embedding")), began)
    kept.sweep(now)
    rows = t.spark.read.schema(kept.SCHEMA).option("basePath", kept.path).parquet(kept.path)  # files that are left, alive or not
    return rows.groupBy("job_id").agg(F.count("*").alias("chunks"))


@query("""SELECT 'raw-uploads/' || doc_id || '/original.bin' AS key, octet_length(b)::BIGINT AS size_bytes, sha256(substr(hex(b), 1, 2000)) AS head FROM (SELECT doc_id, encode(coalesce(CASE WHEN doc_id % 3 = 0 THEN text || ' put again' ELSE text END, '')) AS b FROM documents)""")
def blob_store(t: Tables) -> DataFrame:
    """Documents put as blobs, a third of them again with another content, and read back, a thousand bytes of each."""
    kept, named = stores.Blobs(t.spark, new_path(t.spark, "blobs"), 8), stores.key("upload", F.col("doc_id").cast("string")).alias("key")
    body = lambda more: F.encode(F.coalesce(F.concat("text", F.lit(more)), F.lit("")), "UTF-8").alias("content")
    kept.put(t.documents.select(named, body("")))
    for _ in range(2):  # the second time changes nothing
        kept.put(t.documents.where("doc_id % 3 = 0").select(named, body(" put again")), "again", 0)
    return kept.read(most=1000).select("key", "size_bytes", F.sha2(F.hex("content"), 256).alias("head"))


@query("SELECT o_custkey::VARCHAR AS job_id, count(*) AS findings, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def report_store(t: Tables) -> DataFrame:
    """Reports of customers' orders put as JSON, put again, and read back."""
    path = new_path(t.spark, "reports")
    rows = t.orders.groupBy(F.col("o_custkey").cast("string").alias("job_id")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))).alias("findings"))
    stores.put_json(rows.where("job_id < '5'").withColumn("findings", F.slice("findings", 1, 1)), path)
    stores.put_json(rows, path)
    found = stores.get_json(t.spark, path, "findings array<struct<id: long, price: double>>, job_id string")
    return found.select("job_id", F.size("findings").cast("long").alias("findings"), F.round(F.aggregate("findings", F.lit(0.0), lambda a, f: a + f["price"]), 2).alias("total"))


@query("""WITH v AS (SELECT event_id, CASE (event_id + user_id) % 7 WHEN 0 THEN 'oops ' || props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '{' || job || s || r || ', "more": 1}' WHEN 3 THEN '{' || job || r || '}' WHEN 4 THEN '{' || job || ', "status": "' || event_type || '"' || r || '}' WHEN 5 THEN props ELSE '{' || job || s || r || '}' END AS value
 FROM (SELECT *, '"job_id": "' || user_id || '"' AS job, ', "status": "COMPLETE"' AS s, ', "report_s3_key": "r", "sbom_s3_key": "s"' AS r FROM events)),
 k AS (SELECT *, CASE WHEN json_valid(value) THEN json_keys(value) ELSE [] END AS keys FROM v)
 SELECT event_id, CASE WHEN NOT json_valid(value) THEN 'not a JSON object' WHEN json_type(value) <> 'OBJECT' THEN 'not a JSON object' WHEN len(list_filter(keys, lambda k: k NOT IN ('job_id', 'status', 'report_s3_key', 'sbom_s3_key'))) > 0 THEN 'unknown field'
 WHEN len(list_filter(['job_id', 'status', 'report_s3_key', 'sbom_s3_key'], lambda k: NOT list_contains(keys, k))) > 0 THEN 'missing field' WHEN json_extract_string(value, '$.status') <> 'COMPLETE' THEN 'status' END AS error FROM k""")
def dlq_split(t: Tables) -> DataFrame:
    """Messages of one topic, most of them bad in one way each."""
    kind, job = F.pmod(F.col("event_id") + F.col("user_id"), F.lit(7)), F.concat(F.lit('"job_id": "'), F.col("user_id").cast("string"), F.lit('"'))
    body = lambda *x: F.concat(F.lit("{"), job, *[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("}"))
    rest = ', "report_s3_key": "r", "sbom_s3_key": "s"'
    value = F.when(kind == 0, F.concat(F.lit("oops "), "props")).when(kind == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(kind == 2, body(', "status": "COMPLETE"', rest, ', "more": 1')).when(kind == 3, body(rest))
    value = value.when(kind == 4, body(', "status": "', F.col("event_type"), '"', rest)).when(kind == 5, F.col("props")).otherwise(body(', "status": "COMPLETE"', rest))
    return contracts.validated(t.events.select("event_id", value.alias("value")), "firmware.completed").select("event_id", "error")


@query("""WITH l AS (SELECT event_id, ts, coalesce(CASE WHEN user_id % 3 <> 0 THEN user_id::VARCHAR END, 'unknown') AS job, event_type = 'error' AS own FROM events),
 h AS (SELECT user_id::VARCHAR AS job, max(ts) AS until FROM events WHERE event_type = 'signup' GROUP BY 1)
 SELECT event_id, l.job AS job_id, CASE WHEN own THEN 'SKIPPED' WHEN until > ts THEN 'BLOCKED' ELSE 'RETRIED' END AS action FROM l LEFT JOIN h USING (job)""")
def dlq_replay_status(t: Tables) -> DataFrame:
    """What becomes of dead letters at the time of their events, where a user's last signup is the end of a lease on the user's letters."""
    payload = F.to_json(F.struct(F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).alias("job_id")))
    letters = t.events.select("event_id", "ts", F.when(F.col("event_type") == "error", "firmware.dlq").otherwise("firmware.matched").alias("original_topic"), payload.alias("payload"))
    held = t.events.where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("until"))
    return failures.replay_plan(letters, held, F.col("ts")).select("event_id", "job_id", "action")


@query("SELECT event_id, CASE WHEN event_id % 7 > 1 THEN 0.5 * (2 ** (event_id % 7 - 1) - 1) ELSE 0.0 END AS waited FROM events")
def backoff(t: Tables) -> DataFrame:
    waited = F.aggregate(failures.pauses((F.col("event_id") % 7).cast("int")), F.lit(0.0), lambda a, x: a + x)
    return t.events.select("event_id", waited.alias("waited"))


@query("""WITH m AS (SELECT max(value) AS v FROM events) SELECT event_id, CASE WHEN value = v THEN 'letter' ELSE 'result' END AS became, CASE WHEN value < v THEN round(1 / (v - value), 6) END AS result FROM events, m""")
def stage_failures(t: Tables) -> DataFrame:
    """A stage that divides by what an event lacks to the greatest value, and so fails with the greatest: these alone become letters."""
    most = t.events.agg(F.max("value")).first()[0]
    rows, done = t.events.select("event_id", "value"), []

    def stage(some: DataFrame) -> None:
        gap = F.lit(most) - F.col("value")
        checked = F.when(gap > 0, 1 / gap).otherwise(F.raise_error(F.lit("no gap")).cast("double"))
        done.append(materialise(some.select("event_id", F.lit("result").alias("became"), F.round(checked, 6).alias("result")), "stage"))

    failed = failures.isolated(rows, stage)
    return reduce(DataFrame.unionAll, done).unionAll(failed.select("event_id", F.lit("letter"), F.lit(None).cast("double")))


@query("""WITH e AS (SELECT user_id, event_type, event_id, value, ts, (event_id * 4) // (SELECT max(event_id) + 1 FROM events) AS part FROM events)
 SELECT user_id, event_type, event_id, value FROM e WHERE part < 3 OR event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def merged_table(t: Tables) -> DataFrame:
    """The last event of each user and kind, from four batches merged into a table; the last batch comes without its views, and the second one twice."""
    table = MergeTable(t.spark, new_path(t.spark, "merged"), "user_id long, event_type string, event_id long, value double, last struct<ts: timestamp, event_id: long>", ["user_id", "event_type"], buckets=8)
    rows = t.events.select(F.col("user_id").cast("long"), "event_type", "event_id", "value", F.struct("ts", "event_id").alias("last"))
    most = t.events.agg(F.max("event_id") + 1).first()[0]
    for part in (0, 1, 1, 2, 3):
        some = rows.where(F.floor(F.col("event_id") * 4 / F.lit(most)) == part).where(F.lit(part < 3) | (F.col("event_type") != "view"))
        table.merge(some, replacing(["user_id", "event_type"], "last"), "parts", part)
    return table.read().drop("last")


def verdicts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Labels as verdicts on documents, and languages as families of these."""
    verdict = F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, "confirmed").otherwise("needs_review")
    return t.labels.select(F.col("doc_id").alias("cve_id"), verdict.alias("verdict")), feedback.family_of_cve(t.documents.select(F.col("doc_id").alias("cve_id"), F.col("lang").alias("family")))


TALLY = """tally AS (SELECT family, count(*) FILTER (v = 'confirmed') AS confirmed, count(*) FILTER (v = 'false_positive') AS false_positive FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'confirmed' ELSE 'needs_review' END AS v FROM labels)
 JOIN (SELECT doc_id, min(lang) AS family FROM documents WHERE lang IS NOT NULL GROUP BY 1) USING (doc_id) WHERE v <> 'needs_review' GROUP BY family), rates AS (SELECT *, coalesce(false_positive::DOUBLE / nullif(confirmed + false_positive, 0), 0) AS fp_rate FROM tally)"""
SHIFTED = "shifted AS (SELECT *, CASE WHEN fp_rate >= 0.5 THEN 0.05 WHEN fp_rate <= 0.1 THEN -0.03 ELSE 0.0 END AS d FROM rates)"


@query(f"WITH {TALLY} SELECT family, confirmed, false_positive, fp_rate FROM rates")
def feedback_tally(t: Tables) -> DataFrame:
    return feedback.tally(*verdicts(t))


@query(f"WITH {TALLY}, {SHIFTED} SELECT family, round(0.9::DOUBLE + d, 6) AS high, round(0.7::DOUBLE + d, 6) AS possible, round(0.5::DOUBLE + d, 6) AS low FROM shifted")
def recalibrate(t: Tables) -> DataFrame:
    rows = feedback.recalibrate(feedback.tally(*verdicts(t)))
    return rows.select("family", *[F.round(c, 6).alias(c) for c in ("high", "possible", "low")])


@query(f"WITH {TALLY}, {SHIFTED} SELECT lang AS family, round(0.9::DOUBLE + coalesce(d, 0), 6) AS high, coalesce(d, 0) <> 0 AS moved FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN shifted ON lang = family")
def threshold_snapshot(t: Tables) -> DataFrame:
    new = feedback.changed(feedback.recalibrate(feedback.tally(*verdicts(t))))
    rows = t.documents.select(F.col("lang").alias("family")).distinct().join(new, "family", "left")
    return rows.select("family", F.round(F.coalesce("high", F.lit(families.HIGH)), 6).alias("high"), F.col("high").isNotNull().alias("moved"))


@query("SELECT o_orderkey AS job_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def jobs_latest_500(t: Tables) -> DataFrame:
    return stores.latest_jobs(t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status")))


FINDINGS_SQL = "f AS (SELECT l_orderkey AS job_id, CASE l_returnflag WHEN 'A' THEN 'CONFIRMED' WHEN 'N' THEN 'POSSIBLE' ELSE 'LOW_CONFIDENCE' END AS tier, l_partkey FROM lineitem)"


def line_findings(t: Tables) -> DataFrame:
    tier = F.when(F.col("l_returnflag") == "A", "CONFIRMED").when(F.col("l_returnflag") == "N", "POSSIBLE").otherwise("LOW_CONFIDENCE")
    return t.lineitem.select(F.col("l_orderkey").alias("job_id"), tier.alias("confidence_tier"), F.col("l_partkey").alias("cve_id"))


@query(f"WITH {FINDINGS_SQL} SELECT job_id, sum(n)::BIGINT AS total_findings, string_agg(tier || '=' || n, ',' ORDER BY tier) AS by_tier FROM (SELECT job_id, tier, count(*) AS n FROM f GROUP BY ALL) GROUP BY job_id")
def tier_summary(t: Tables) -> DataFrame:
    entries = F.transform(F.map_entries("by_tier"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return report.tier_summary(line_findings(t)).select("job_id", "total_findings", F.array_join(entries, ",").alias("by_tier"))


@query(f"""WITH {FINDINGS_SQL}, s AS (SELECT job_id, count(*) AS total_findings, string_agg(tier || '/' || l_partkey, ',' ORDER BY tier, l_partkey) AS findings, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS components FROM f GROUP BY 1)
 SELECT o_orderkey AS job_id, o_orderstatus AS status, coalesce(total_findings, 0) AS total_findings, coalesce(findings, '') AS findings, coalesce(components, '') AS components FROM orders LEFT JOIN s ON o_orderkey = job_id""")
def report_assembly(t: Tables) -> DataFrame:
    rows = report.assemble(t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status")), line_findings(t), t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").cast("string").alias("component")))
    f = F.array_join(F.transform("findings", lambda x: F.concat_ws("/", x["confidence_tier"], x["cve_id"].cast("string"))), ",")
    return rows.select("job_id", "status", "total_findings", F.coalesce(f, F.lit("")).alias("findings"), F.coalesce(F.array_join("components.component", ","), F.lit("")).alias("components"))


@query("""WITH c AS (SELECT conv_id AS job_id, string_agg(text, chr(10) ORDER BY turn, text) FILTER (rn <= 20) AS chunks, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations WHERE trim(text) <> '') GROUP BY 1)
 SELECT job_id, md5(chunks) AS chunks_md5, 'CVE-' || (job_id % 3) || ',CVE-' || (job_id % 3 + 5) || ',CORPUS-' || (job_id % 4) AS sources, n > 0 AS grounded FROM c""")
def rag_context(t: Tables) -> DataFrame:
    """A context for each conversation: its turns as chunks, the first twenty; sources of the job before those of the corpus."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    first = t.conversations.where("trim(text) <> ''").withColumn("place", place).where(F.col("place") <= rag.MOST_FINDINGS)  # before turns are brought together
    chunks = first.groupBy(F.col("conv_id").alias("job_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"].alias("chunks"))
    cve = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    job, found = F.array(cve("CVE-", F.col("job_id") % 3 + 5), cve("CVE-", F.col("job_id") % 3)), F.array(cve("CVE-", F.col("job_id") % 3), cve("CORPUS-", F.col("job_id") % 4))
    rows = chunks.select("job_id", rag.context(job, found, F.col("chunks")).alias("c"))
    return rows.select("job_id", F.md5(F.array_join("c.chunks", "\n")).alias("chunks_md5"), F.array_join("c.sources", ",").alias("sources"), "c.grounded")


@query(rf"""WITH q AS (SELECT conv_id, arg_min(text, (turn, text)) AS text FROM conversations GROUP BY 1), {hashed_sql("qb", "conv_id", "q")}, {hashed_sql("ib", "item_id", "benchmark")}
 SELECT conv_id AS job_id, item_id AS id, round(s, 6) AS score, rank FROM (SELECT conv_id, item_id, coalesce(d / (qb_n.len * ib_n.len), 0) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(d / (qb_n.len * ib_n.len), 0) DESC, item_id) AS rank
 FROM qb_n CROSS JOIN ib_n LEFT JOIN (SELECT conv_id, item_id, sum(qb.n::DOUBLE * ib.n) AS d FROM qb JOIN ib USING (bucket) GROUP BY ALL) USING (conv_id, item_id)) WHERE rank <= 5""")
def rag_retrieve(t: Tables) -> DataFrame:
    """The five reference texts nearest to the first turn of each conversation."""
    first = t.conversations.groupBy(F.col("conv_id").alias("job_id")).agg(F.min(F.struct("turn", "text"))["text"].alias("question"))
    counts = embedding.HashingEmbedder(unit=False)
    index = t.benchmark.select(F.col("item_id").alias("id"), "text", embedding.embedded(F.col("text"), counts).alias("embedding"))
    return rag.retrieve(first, index, 5, counts).select("job_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FINDINGS_SQL} SELECT job_id, count(*) AS finding_count, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS cve_ids FROM f GROUP BY 1")
def cve_counts(t: Tables) -> DataFrame:
    rows = line_findings(t).withColumn("cve_id", F.col("cve_id").cast("string"))
    return report.cve_counts(rows).select("job_id", "finding_count", F.array_join("cve_ids", ",").alias("cve_ids"))


@query(f"""SELECT user_id::VARCHAR AS job_id, arg_max({TOPIC_SQL}, (ts, {TOPIC_SQL})) AS stage, 'running' AS status, count(*) FILTER ({TOPIC_SQL} = 'matched') AS matched, count(*) FILTER ({TOPIC_SQL} = 'extracted') AS total, bool_or({TOPIC_SQL} = 'extraction_complete') AS total_final,
 count(*) FILTER ({TOPIC_SQL} = 'matched') || '/' || count(*) FILTER ({TOPIC_SQL} = 'extracted') AS progress, CASE WHEN count(*) FILTER ({TOPIC_SQL} = 'extracted') > 0 THEN round(100.0::DOUBLE * count(*) FILTER ({TOPIC_SQL} = 'matched') / count(*) FILTER ({TOPIC_SQL} = 'extracted'), 1) ELSE 0 END AS percent FROM events GROUP BY 1""")
def progress_fold(t: Tables) -> DataFrame:
    """What the stream of progress adds up to, in batch."""
    rows = t.events.select(F.col("user_id").cast("string").alias("job_id"), topic().alias("topic"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.snapshots(streams.progress_of(rows))


@query("SELECT event_id FROM events WHERE TIMESTAMP '2024-01-20 12:00:00' - ts <= INTERVAL 3600 SECONDS")
def index_ttl_sweep(t: Tables) -> DataFrame:
    return rag.alive(t.events.withColumnRenamed("ts", "created_at"), F.expr("timestamp_ntz'2024-01-20 12:00:00'")).select("event_id")


@query(f"SELECT event_id, CASE WHEN {CONTRACT_SQL} IN ('firmware.extracted', 'firmware.analyzed', 'firmware.matched') THEN 'sub' || event_id % 9 ELSE 'job' || user_id END AS partition_key, CASE WHEN event_id % 2 = 0 THEN 'k' || user_id ELSE sha256(props) END AS message_key FROM events")
def partition_key(t: Tables) -> DataFrame:
    key = contracts.partition_key(contract(), F.concat(F.lit("job"), F.col("user_id").cast("string")), F.concat(F.lit("sub"), (F.col("event_id") % 9).cast("string")))
    own = contracts.message_key(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("k"), F.col("user_id").cast("string"))), F.col("props"))
    return t.events.select("event_id", key.alias("partition_key"), own.alias("message_key"))


@query(f"SELECT topic FROM (VALUES ('firmware.uploaded'), ('firmware.triaged'), ('firmware.extracted'), ('firmware.analyzed'), ('firmware.matched'), ('firmware.completed'), ('firmware.dlq')) v(topic) EXCEPT SELECT DISTINCT {CONTRACT_SQL} FROM events")
def missing_topics(t: Tables) -> DataFrame:
    return contracts.missing_topics(t.events.select(contract().alias("topic")))


@query("""SELECT user_id AS job_id, event_type AS sub_blob_id, max(event_id) AS event_id FROM events WHERE user_id % 10 <> 0 OR ts < TIMESTAMP '2024-01-16 00:00:00'
 OR user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00') GROUP BY ALL""")
def slot_merge(t: Tables) -> DataFrame:
    """Slots written in two parts; a job that was finished after the first, as every tenth is, keeps what it had."""
    rows = t.events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("sub_blob_id"), "event_id", (F.col("user_id") % 10 == 0).alias("finalized"), "ts")
    part = lambda test: corpus.latest(rows.where(test), ["job_id", "sub_blob_id"], F.desc("event_id")).drop("ts")
    early, late = part("ts < timestamp_ntz'2024-01-16 00:00:00'"), part("ts >= timestamp_ntz'2024-01-16 00:00:00'").drop("finalized")
    return stores.merge_slots(early, late, "event_id").select("job_id", "sub_blob_id", "event_id")


@query("SELECT s_suppkey AS page, s_suppkey * 2000 AS start_index FROM supplier")
def page_offsets(t: Tables) -> DataFrame:
    """Start of each page of a paged scan with as many pages as there are suppliers."""
    n = t.supplier.agg(F.count("*").alias("n"))
    return n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("page")).select("page", (F.col("page") * 2000).alias("start_index"))


@query("SELECT c_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_job FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def first_seen(t: Tables) -> DataFrame:
    """First-seen dedup: of each uploader the first job."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("n", F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderdate", "o_orderkey")))
    return rows.where("n = 1").select("c_custkey", F.col("o_orderkey").alias("first_job"))
