"""Strings, banners, secrets and hashed word vectors of texts and blobs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vendor, product, pattern with the version as its first group.
BANNERS = (
    ("busybox", "busybox", r"(?i)BusyBox\s+v?(\d+\.\d+\.\d+)"),
    ("openssl", "openssl", r"(?i)OpenSSL\s+(\d+\.\d+\.\d+[a-z]?)"),
    ("curl", "libcurl", r"(?i)libcurl/(\d+\.\d+\.\d+)"),
    ("curl", "curl", r"(?i)\bcurl\s+(\d+\.\d+\.\d+)"),
    ("dropbear", "dropbear", r"[Dd]ropbear(?:\s+SSH)?[ _]v?(\d{4}\.\d+|\d+\.\d+)"),
    ("uclibc", "uclibc", r"(?i)uClibc(?:-ng)?[ -]?(\d+\.\d+\.\d+)"),
    ("linux", "linux_kernel", r"Linux version\s+(\d+\.\d+(?:\.\d+)?)"),
)

# Type of a secret and the pattern that shows it in a string.
SECRETS = (
    ("private_key_header", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("hardcoded_credential", r"(?i)(?:password|passwd|pwd|secret|api_?key|token)\s*[:=]\s*\S{4,}"),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("email_address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
)

TOKEN = r"[\p{L}\p{N}._-]+"
BUCKETS = 384
#: Strings that an analysis reports; banners and secrets are looked for in all.
MOST_STRINGS = 5000


def lowered(text: Column) -> Column:
    """In lower case, each letter by itself as in SQL: Java's own rule makes two of the dotted capital I, and another sigma at the end
    of a word."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def tokens(text: Column) -> Column:
    """Runs of letters, digits, ``.``, ``-`` and ``_`` in lower case."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    """The first four bytes of SHA-256, big end first, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def embedding_tokens(text: Column) -> Column:
    """Tokens to be hashed; a text without any is one token of itself, an empty one the word ``empty``."""
    own = tokens(text)
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.coalesce(F.nullif(text, F.lit("")), F.lit("empty"))))


def corpus_text(vendor: Column, product: Column, version: Column, description: Column, cve_id: Column) -> Column:
    """What is embedded for a record: ``vendor product version: description``, or the id if nothing else is known."""
    whole = F.concat(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (vendor, product, version)]), F.lit(": "), F.coalesce(description, F.lit("")))
    return F.coalesce(F.nullif(F.trim(whole, F.lit(": ")), F.lit("")), cve_id)


def ascii_strings(text: Column, least: int = 4) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\x20-\x7e]{%d,}" % least), F.lit(0))


def strings(content: Column, least: int = 4) -> Column:
    """Printable strings of binary content, distinct, in order of their pass: ASCII, then UTF-16 little and big endian."""
    raw = F.decode(content, "ISO-8859-1")
    wide = lambda pattern: F.transform(F.regexp_extract_all(raw, F.lit(pattern % least), F.lit(0)), lambda s: F.replace(s, F.lit("\x00"), F.lit("")))
    return F.array_distinct(F.concat(ascii_strings(raw, least), wide(r"(?:[\x20-\x7e]\x00){%d,}"), wide(r"(?:\x00[\x20-\x7e]){%d,}")))


def banners(found: Column) -> Column:
    """array<struct<vendor, product, version>>: distinct, the first match of each pattern in each string."""

    def of(s: Column) -> Column:
        return F.array(*[F.struct(F.lit(v).alias("vendor"), F.lit(p).alias("product"), F.regexp_extract(s, pattern, 1).alias("version")) for v, p, pattern in BANNERS])

    return F.array_distinct(F.filter(F.flatten(F.transform(found, of)), lambda x: x["version"] != ""))


def secrets(found: Column) -> Column:
    """array<struct<type, context>>: distinct; context is the whole string."""

    def of(s: Column) -> Column:
        return F.array(*[F.when(s.rlike(pattern), F.struct(F.lit(kind).alias("type"), s.alias("context"))) for kind, pattern in SECRETS])

    return F.array_distinct(F.filter(F.flatten(F.transform(found, of)), lambda x: x.isNotNull()))


def redacted(context: Column) -> Column:
    """How a secret is shown: its length alone."""
    return F.when(F.coalesce(F.length(context), F.lit(0)) == 0, F.lit("[redacted]")).otherwise(F.concat(F.lit("[redacted — "), F.length(context).cast("string"), F.lit(" chars]")))


def has_canary(found: Column) -> Column:
    return F.exists(found, lambda s: s.contains("__stack_chk_fail"))
