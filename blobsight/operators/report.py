"""Jobs put together: the completion gate, statistics, findings, reports, progress."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsight.functions import families

#: Findings that a summary is made of.
MOST_CHUNKS = 20
MOST_LINES = 50


def completion_ready(total: Column, matched: Column, marker: Column) -> Column:
    """All children are known to be out, there is one at least, and all have been matched."""
    return F.coalesce(marker & (total > 0) & (matched >= total), F.lit(False))


def gate(events: DataFrame) -> DataFrame:
    """(job_id, total, matched, marker, ready) from ``events`` (job_id, topic, sub_blob_id): sets of ids, so that events that come again
    count once."""
    ids = lambda topic: F.count_distinct(F.when(F.col("topic") == topic, F.col("sub_blob_id")))
    rows = events.groupBy("job_id").agg(ids("extracted").alias("total"), ids("matched").alias("matched"), F.bool_or(F.col("topic") == "extraction_complete").alias("marker"))
    return rows.withColumn("ready", completion_ready(F.col("total"), F.col("matched"), F.col("marker")))


def tier_summary(findings: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, total_findings, by_tier: map) in two steps, so that a job's findings never meet in one place."""
    counts = findings.groupBy(key, "confidence_tier").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.sum("n").alias("total_findings"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("confidence_tier", "n")))).alias("by_tier"))


def cve_counts(findings: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, finding_count, cve_ids): findings, and different CVEs in order, of each job."""
    once = findings.groupBy(key, "cve_id").agg(F.count("*").alias("n"))
    return once.groupBy(key).agg(F.sum("n").alias("finding_count"), F.sort_array(F.collect_list("cve_id")).alias("cve_ids"))


class Narrator(Protocol):
    """A language model's texts on findings. What it raises, or does not know, is null: a report does without."""

    def triage_rationale(self, component: str, cve_id: str, description: str, tier: str, score: float) -> str | None: ...

    def executive_summary(self, job_id: str, findings: list[str]) -> str | None: ...

    def rag_answer(self, question: str, chunks: list[str]) -> str | None: ...


def with_rationales(findings: DataFrame, narrator: Narrator | None = None) -> DataFrame:
    """``findings`` (component, cve_id, description, confidence_tier, similarity_score) with llm_rationale where the tier is an
    uncertain one; null without a narrator."""

    def run(component: pd.Series, cve: pd.Series, description: pd.Series, tier: pd.Series, score: pd.Series) -> pd.Series:
        return pd.Series([_told(narrator.triage_rationale, *x) for x in zip(component, cve, description, tier, score, strict=True)], dtype="object")

    told = F.pandas_udf(run, "string")("component", "cve_id", "description", "confidence_tier", "similarity_score") if narrator else F.lit(None).cast("string")
    return findings.withColumn("llm_rationale", F.when(families.needs_rationale(F.col("confidence_tier")), told))


def with_summaries(reports: DataFrame, narrator: Narrator | None = None) -> DataFrame:
    """``reports`` (job_id, findings) with executive_summary, of the first MOST_LINES findings; null without findings."""
    lines = F.transform(F.slice("findings", 1, MOST_LINES), lambda f: F.concat(F.lit("- "), f["cve_id"], F.lit(" ["), f["confidence_tier"], F.lit("]")))

    def run(job: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_told(narrator.executive_summary, j, list(x)) if x is not None and len(x) else None for j, x in zip(job, found, strict=True)], dtype="object")

    return reports.withColumn("executive_summary", F.pandas_udf(run, "string")("job_id", lines) if narrator else F.lit(None).cast("string"))


def with_answers(contexts: DataFrame, narrator: Narrator | None = None) -> DataFrame:
    """``contexts`` (question, chunks), as ``rag.grounded`` makes them beside their questions, with an answer from the first MOST_CHUNKS
    chunks alone; null without chunks, so that nothing is answered out of thin air, and without a narrator."""

    def run(question: pd.Series, chunks: pd.Series) -> pd.Series:
        return pd.Series([_told(narrator.rag_answer, q, list(c)) if c is not None and len(c) else None for q, c in zip(question, chunks, strict=True)], dtype="object")

    told = F.pandas_udf(run, "string")("question", F.slice("chunks", 1, MOST_CHUNKS)) if narrator else F.lit(None).cast("string")
    return contexts.withColumn("answer", told)


def _told(ask, *what) -> str | None:
    try:
        return ask(*what)
    except Exception:  # whatever a model's client raises
        return None


def assemble(jobs: DataFrame, findings: DataFrame, components: DataFrame) -> DataFrame:
    """``jobs`` with findings, components and statistics as columns; empty where a job has none."""
    f = findings.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in findings.columns if c != "job_id"]))).alias("findings"))
    c = components.distinct().groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(*[x for x in components.columns if x != "job_id"]))).alias("components"))
    return jobs.join(f, "job_id", "left").join(c, "job_id", "left").join(tier_summary(findings), "job_id", "left").withColumn("total_findings", F.coalesce("total_findings", F.lit(0)))


def progress(events: DataFrame, stages: tuple[str, ...], total_of: str, done_of: str, order: str = "ts") -> DataFrame:
    """A snapshot of each job of ``events`` (job_id, stage, and the order column)."""
    n = {s: F.count_if(F.col("stage") == s).alias(s) for s in stages}
    rows = events.groupBy("job_id").agg(*n.values(), F.max_by("stage", order).alias("latest"))
    done, total = F.col(done_of), F.col(total_of)
    percent = F.when(total > 0, F.floor(1000.0 * done / total + 0.5) / 10).otherwise(0.0)
    return rows.withColumn("progress", F.concat(done.cast("string"), F.lit("/"), total.cast("string"))).withColumn("percent", percent)
