"""Analysts' verdicts turned into thresholds by family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsight.functions import families

VERDICTS = ("confirmed", "false_positive", "needs_review")


def family_of_cve(corpus: DataFrame) -> DataFrame:
    """(cve_id, family): the first of its families by name."""
    return corpus.where("family is not null").groupBy("cve_id").agg(F.min("family").alias("family"))


def tally(feedback: DataFrame, of: DataFrame) -> DataFrame:
    """(family, confirmed, false_positive, fp_rate) for ``feedback`` (cve_id, verdict); verdicts of unknown CVEs and others
    than the two that decide are left out."""
    rows = feedback.where(F.col("verdict").isin(*VERDICTS[:2])).join(of, "cve_id")
    counts = rows.groupBy("family").agg(F.count_if(F.col("verdict") == VERDICTS[0]).alias("confirmed"), F.count_if(F.col("verdict") == VERDICTS[1]).alias("false_positive"))
    return counts.withColumn("fp_rate", families.fp_rate(F.col("confirmed"), F.col("false_positive")))


def recalibrate(counts: DataFrame, least: int = 1) -> DataFrame:
    """(family, high, possible, low) for families with ``least`` verdicts or more, a pure function of all feedback."""
    h, p, low = families.recalibrated(F.col("fp_rate"))
    enough = counts.where(F.col("confirmed") + F.col("false_positive") >= least)
    return enough.select("family", h.alias("high"), p.alias("possible"), low.alias("low"))


def changed(thresholds: DataFrame) -> DataFrame:
    """Families whose thresholds are not the defaults."""
    return thresholds.where((F.col("high") != families.HIGH) | (F.col("possible") != families.POSSIBLE) | (F.col("low") != families.LOW))
