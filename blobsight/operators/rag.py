"""Contexts for questions: a job's findings and the corpus, and a per-job index with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsight.operators.embedding import Embedder, embedded
from blobsight.operators.similarity import top_k
from blobsight.scratch import materialise

MOST_FINDINGS = 20
TTL_SECONDS = 3600


def index_chunks(reports: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """(job_id, text) of ``reports`` (job_id, executive_summary, findings, components): a chunk for the summary, each
    finding, each component and each string; blank ones are dropped."""
    said = lambda name, *x: F.concat(F.lit(name), F.nullif(F.trim(F.concat_ws(" ", *[F.nullif(F.col(y), F.lit("")) for y in x])), F.lit(""))).alias("text")
    summary = reports.select("job_id", said("Executive summary: ", "executive_summary"))
    f = reports.select("job_id", F.explode("findings").alias("f")).select("job_id", said("Finding: ", "f.cve_id", "f.confidence_tier", "f.llm_rationale"))
    c = reports.select("job_id", F.explode("components").alias("c")).select("job_id", said("Component: ", "c.vendor", "c.product", "c.version"))
    out = summary.unionByName(f).unionByName(c)
    if strings is not None:
        out = out.unionByName(strings.select("job_id", "text"))
    return out.where("trim(text) <> ''")


def context(job_cves: Column, found_cves: Column, chunks: Column, most: int = MOST_FINDINGS) -> Column:
    """struct<chunks, sources, grounded>: the first chunks; sources once each, the job's own first, by id."""
    return F.struct(F.slice(chunks, 1, most).alias("chunks"), F.array_union(F.sort_array(job_cves), found_cves).alias("sources"), (F.size(chunks) > 0).alias("grounded"))


def retrieve(questions: DataFrame, index: DataFrame, k: int = 5, embedder: Embedder | None = None) -> DataFrame:
    """(job_id, id, text, score, rank): of each question (job_id, question) the nearest rows of ``index`` (id, text, embedding).
    With a column job_id in ``index`` only rows of the question's own job count."""
    scope = ["job_id"] if "job_id" in index.columns else []
    q = questions.select(F.col("job_id").alias("qid"), embedded(F.col("question"), embedder).alias("v"), *[F.col(s).alias("scope") for s in scope])
    c = index.select("id", F.col("embedding").alias("v"), *[F.col(s).alias("scope") for s in scope])
    near = top_k(materialise(q, "questions"), c, k).withColumnRenamed("qid", "job_id")  # embedded once
    return near.join(index.select("id", "text", *scope), ["id", *scope]).select("job_id", "id", "text", "score", "rank")


def grounded(questions: DataFrame, reports: DataFrame, corpus: DataFrame, k: int = 5, embedder: Embedder | None = None) -> DataFrame:
    """(job_id, status, finding_count, chunks, sources) for each of ``questions`` (job_id, question): the job's own summary and
    findings from ``reports`` (job_id, status, executive_summary, findings), then the nearest records of ``corpus`` (cve_id,
    cpe_string, description, embedding); sources once each, the job's own first. A job without a report has the corpus alone."""
    shown = F.array_join(F.transform(F.slice("findings", 1, MOST_FINDINGS), lambda f: F.concat(F.coalesce(f["cve_id"], F.lit("None")), F.lit(" ["), F.coalesce(f["confidence_tier"], F.lit("None")), F.lit("]"))), ", ")
    n = F.coalesce(F.size("findings"), F.lit(0))
    own = F.filter(F.array(F.concat(F.lit("Report summary: "), F.nullif("executive_summary", F.lit(""))), F.concat(F.lit("This job's findings: "), shown)), lambda c: c.isNotNull())
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("findings", lambda f: f["cve_id"]), lambda c: c.isNotNull())))
    none = F.array().cast("array<string>")
    report = reports.select("job_id", "status", n.alias("finding_count"), F.when(n > 0, own).otherwise(none).alias("own"), F.coalesce(ids, none).alias("ids"))
    found = retrieve(questions, corpus.select(F.struct("cve_id", "cpe_string").alias("id"), F.concat(F.col("cve_id"), F.lit(" ("), F.col("cpe_string"), F.lit("): "), F.col("description")).alias("text"), "embedding"), k, embedder)
    near = found.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text", F.col("id.cve_id").alias("cve_id")))).alias("near"))  # ``k`` at most
    rows = questions.select("job_id").join(report, "job_id", "left").join(near, "job_id", "left")
    chunks = F.concat(F.coalesce("own", none), F.coalesce(F.col("near.text"), none))
    return rows.select("job_id", "status", F.coalesce("finding_count", F.lit(0)).alias("finding_count"), chunks.alias("chunks"), F.array_union(F.coalesce("ids", none), F.coalesce(F.col("near.cve_id"), none)).alias("sources"))


def alive(index: DataFrame, now: Column, ttl: int = TTL_SECONDS, created: str = "created_at") -> DataFrame:
    """Rows of jobs created at most ``ttl`` seconds before ``now``."""
    return index.where(now - F.col(created) <= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl)))
