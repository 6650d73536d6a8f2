"""Component families, confidence tiers and thresholds as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Family, vendors, products.
FAMILIES = (
    ("busybox", ("busybox",), ("busybox",)),
    ("openssl", ("openssl",), ("openssl",)),
    ("libcurl", ("haxx", "curl"), ("curl", "libcurl")),
    ("dropbear", ("dropbear", "dropbear_ssh_project", "matt_johnston"), ("dropbear", "dropbear_ssh")),
    ("uclibc", ("uclibc", "uclibc-ng_project", "erik_andersen"), ("uclibc", "uclibc-ng")),
    ("linux_kernel", ("linux",), ("linux_kernel",)),
    ("zlib", ("zlib", "gnu"), ("zlib",)),
    ("openssh", ("openbsd",), ("openssh",)),
    ("glibc", ("gnu",), ("glibc",)),
    ("wpa_supplicant", ("w1.fi",), ("wpa_supplicant", "hostapd")),
    ("u-boot", ("denx",), ("u-boot",)),
    ("lighttpd", ("lighttpd",), ("lighttpd",)),
)

# Inclusive lower bounds of the three tiers, and tiers by rank from 0.
HIGH, POSSIBLE, LOW = 0.90, 0.70, 0.50
TIERS = ("NO_MATCH", "LOW_CONFIDENCE", "POSSIBLE", "HIGH_CONFIDENCE", "CONFIRMED")

# Share of false positives from which, or up to which, thresholds move, and by how much.
STRICTER_FROM, STRICTER_BY, LOOSER_TO, LOOSER_BY = 0.5, 0.05, 0.1, -0.03


def family_table(spark: SparkSession, families=FAMILIES) -> DataFrame:
    """(family, vendors, products): a dimension of a few rows."""
    return spark.createDataFrame([(f, list(v), list(p)) for f, v, p in families], "family string, vendors array<string>, products array<string>")


def _lookup(pairs, key: Column) -> Column:
    """The value for ``key`` in a literal map; null where there is none."""
    parts = [F.lit(x) for pair in pairs for x in pair]
    return F.try_element_at(F.create_map(*parts), key) if parts else F.lit(None).cast("string")


def family_for(product: Column, families=FAMILIES) -> Column:
    """The family of a product, by its trimmed lower-case name alone; null out of scope. The first family listed wins."""
    of: dict[str, str] = {}
    for family, _, products in families:
        for p in products:
            of.setdefault(p, family)
    return _lookup(of.items(), F.lower(F.trim(product)))


def in_scope(product: Column, families=FAMILIES) -> Column:
    return family_for(product, families).isNotNull()


def members(family: Column, column: int, families=FAMILIES) -> Column:
    """Vendors (1) or products (2) of a family as an array; null for no family."""
    pairs = [x for row in families for x in (F.lit(row[0]), F.array(*[F.lit(m) for m in row[column]]))]
    return F.try_element_at(F.create_map(*pairs), family)


def tier(score: Column, high: Column | float = HIGH, possible: Column | float = POSSIBLE, low: Column | float = LOW) -> Column:
    """Tier of a similarity, by inclusive lower bounds, the highest first; no score is no match."""
    return F.when(score >= high, TIERS[3]).when(score >= possible, TIERS[2]).when(score >= low, TIERS[1]).otherwise(TIERS[0])


def tier_rank(name: Column) -> Column:
    """0 (NO_MATCH) to 4 (CONFIRMED); null for another name."""
    return reduce(lambda out, i: F.when(name == TIERS[i], F.lit(i)).otherwise(out), range(len(TIERS)), F.lit(None).cast("int"))


def needs_rationale(name: Column) -> Column:
    return name.isin(TIERS[2], TIERS[1])


def valid_match(name: Column, via: Column, score: Column, rationale: Column) -> Column:
    """Whether a match's fields agree: exact means CONFIRMED without a score; similarity means a score in [0, 1] and any other
    tier; a rationale stands only with an uncertain tier; NO_MATCH is never sent."""
    exact = (via == "exact_cpe") & score.isNull() & (name == TIERS[4])
    similar = (via == "embedding_similarity") & score.isNotNull() & score.between(0.0, 1.0) & (name != TIERS[4])
    return F.coalesce((exact | similar) & (rationale.isNull() | needs_rationale(name)) & (name != TIERS[0]), F.lit(False))


def checked_thresholds(rows: DataFrame) -> DataFrame:
    """``rows`` (high, possible, low); an error where they are not in order within [0, 1], rather than tiers that mean nothing."""
    good = F.coalesce((F.col("low") >= 0) & (F.col("low") <= F.col("possible")) & (F.col("possible") <= F.col("high")) & (F.col("high") <= 1), F.lit(False))
    return rows.withColumn("high", F.when(good, F.col("high")).otherwise(F.raise_error(F.lit("thresholds must satisfy 0 <= low <= possible <= high <= 1")).cast("double")))


def fp_rate(confirmed: Column, false_positive: Column) -> Column:
    """Share of false positives among decided verdicts; 0 without any."""
    return F.coalesce(F.try_divide(false_positive.cast("double"), (confirmed + false_positive).cast("double")), F.lit(0.0))


def recalibrated(rate: Column, high: Column | float = HIGH, possible: Column | float = POSSIBLE, low: Column | float = LOW) -> tuple[Column, Column, Column]:
    """Thresholds moved by the share of false positives, held in [0, 1] and in order."""
    shift = F.when(rate >= STRICTER_FROM, STRICTER_BY).when(rate <= LOOSER_TO, LOOSER_BY).otherwise(0.0)
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    h = unit(as_column(high) + shift)
    p = F.least(h, unit(as_column(possible) + shift))
    return h, p, F.least(p, unit(as_column(low) + shift))
