"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by SHA-256. The ledger is a folder of two tables: which blobs have been
scanned under which version of the rules, with what was found; and which path held which blob in which version. A version
of the rules is a hash of what they say, so findings are never taken for those of other rules. A run scans only the pairs
of blob and rules that the ledger lacks, and joins findings back to all paths that hold the blob, now or in an earlier
version. A ledger that is opened again goes on from what is in its folder. Runs that have nothing new are not written, and
many runs are put together into one, so a ledger that is used for long stays a few folders.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blobsight.llm.common import fresh, slices
from blobsight.scratch import files, new_path

#: Finished runs under one version of the rules that are put together into one.
MOST_RUNS = 16


class Rule(NamedTuple):
    kind: str
    needs: tuple[str, ...]  # one of these must be in the text (lower case) for the rule to be tried
    pattern: str
    group: int  # that must have the least length
    least: int


# Fixed values. Base kinds first; spans of one start are listed in this order.
RULES = (
    Rule("assign", ("passw", "secret", "token", "apikey", "api_key"), r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", ("akia",), r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", (), r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    Rule("private_key", ("private key",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    Rule("jwt", ("eyj",), r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("hub_token", ("gh",), r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat_token", ("xox",), r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("userinfo", ("://",), r"(?<=://)[^\s/:@]+:[^\s/@]{3,}(?=@)", 0, 1),
)
BASE = ("assign", "access", "hex")
#: Bytes that may be in a hex run become "x", so that a run of 24 is found by one substring search.
_HEX = bytes(ord("x") if chr(c) in "0123456789abcdef" else 32 for c in range(256))

SPAN = "struct<kind: string, start: int, end: int>"


def version_of(rules: tuple[Rule, ...]) -> str:
    """The rules' version: a hash of their kinds, patterns, groups and least lengths, in order."""
    said = json.dumps([[r.kind, sorted(r.needs), r.pattern, r.group, r.least] for r in rules])
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed; leftmost and non-overlapping within a kind."""
    low, out = text.lower(), []
    long_hex = b"x" * 24 in text.encode(errors="replace").translate(_HEX)
    for order, rule in enumerate(rules):
        if long_hex if rule.kind == "hex" else not rule.needs or any(x in low for x in rule.needs):
            found = re.compile(rule.pattern).finditer(text)  # compiled once: re keeps it
            out += [(m.start(), order, rule.kind, m.end()) for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _scanned(rules: tuple[Rule, ...]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(x, rules)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, kind)], ["blob", "spans"])

    return run


def body(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def address(text: str = "text") -> Column:
    """The content address: SHA-256 of the UTF-8 bytes; null text is the empty blob."""
    return F.unhex(F.sha2(body(text), 256))


class Ledger:
    """A ledger kept as Parquet under ``path``: rules=<version>/run=<n> has the blobs scanned by a run, versions/run=<n> the
    paths that a run saw. A run whose folder has a number ``upto`` stands for all runs up to it. Only runs that were finished are
    read; what is left of one that failed is written over. One driver writes at a time. Without ``path`` the ledger lasts as
    long as the application."""

    SCANNED = f"blob binary, spans array<{SPAN}>, run int"
    SEEN = "path string, version long, blob binary, run int"

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES, most_runs: int = MOST_RUNS):
        self.spark, self.rules, self.version, self.most_runs = spark, rules, version_of(rules), most_runs
        self.path = path or new_path(spark, "ledger")

    def runs(self, part: str | None = None) -> list[tuple[int, str]]:
        """(number, folder) of the finished runs under these rules (or of ``part``), in order; those put together are one."""
        folder = f"{self.path}/{part or f'rules={self.version}'}"
        fs, at = files(self.spark, folder)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if n.startswith(("run=", "upto=")) and fs.exists(files(self.spark, f"{folder}/{n}/_SUCCESS")[1])]
        upto = max((int(n[5:]) for n in done if n.startswith("upto=")), default=-1)
        kept = [(int(n[4:]), n) for n in done if n.startswith("run=") and int(n[4:]) > upto]
        return [(n, f"{folder}/{name}") for n, name in sorted(kept + ([(upto, f"upto={upto}")] if upto >= 0 else []))]

    def _read(self, schema: str, part: str | None = None) -> DataFrame:
        folders = [at for _, at in self.runs(part)]
        rows = self.spark.read.schema(schema)
        return rows.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, schema: str, part: str | None = None) -> None:
        """A run with these rows, unless there are none; then all runs together, where they have become many."""
        done = self.runs(part)
        folder, number = f"{self.path}/{part or f'rules={self.version}'}", done[-1][0] + 1 if done else 0
        rows = rows.withColumn("run", F.lit(number))
        rows.select(self.spark.createDataFrame([], schema).columns).write.mode("overwrite").parquet(f"{folder}/run={number}")
        fs, _ = files(self.spark, folder)
        if self.spark.read.schema(schema).parquet(f"{folder}/run={number}").isEmpty() and done:
            fs.delete(files(self.spark, f"{folder}/run={number}")[1], True)
        elif len(done) + 1 > self.most_runs:
            whole = self._read(schema, part)
            whole.repartitionByRange(*(["path"] if part else ["blob"])).write.mode("overwrite").parquet(f"{folder}/upto={number}")
            for n in [x.getPath() for x in fs.listStatus(files(self.spark, folder)[1])]:
                if n.getName() != f"upto={number}":
                    fs.delete(n, True)

    def table(self) -> DataFrame:
        """(blob, spans, run) of every blob scanned under these rules; ``run`` is the one that scanned it."""
        return self._read(self.SCANNED)

    def update(self, texts: DataFrame) -> None:
        """Scan the blobs of ``texts`` (text) that the ledger lacks under these rules. Copies meet before the shuffle: a task
        sends a blob once, however often it holds it, so a blob that is a third of all rows is no hot key."""
        blobs = texts.select(address().alias("blob"), body().alias("text"))
        if self.runs():
            blobs = blobs.join(self.table().select("blob"), "blob", "left_anti")
        found = blobs.groupBy("blob").agg(F.first("text").alias("text")).mapInArrow(_scanned(self.rules), f"blob binary, spans array<{SPAN}>")
        self._write(found, self.SCANNED)

    def record(self, paths: DataFrame) -> str:
        """Take up versions of paths: ``paths`` (path string, version long, text). New blobs are scanned; a version that is
        recorded again counts once."""
        self.update(paths)
        rows = paths.select(F.col("path").cast("string"), F.col("version").cast("long"), address().alias("blob")).distinct()
        rows = rows.join(self.history(), ["path", "version", "blob"], "left_anti")
        self._write(rows, self.SEEN, "versions")
        return self.path

    def history(self) -> DataFrame:
        """(path, version, blob) of all versions that were recorded, whatever the rules."""
        return self._read(self.SEEN, "versions").drop("run")

    def findings(self, paths: DataFrame) -> DataFrame:
        """``paths`` (blob and any other columns but spans) with the spans of each path's blob. Only blobs with findings are
        joined; every other path has an empty array."""
        hits = self.table().where(F.size("spans") > 0).select("blob", "spans")
        empty = F.array().cast(f"array<{SPAN}>")
        return paths.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def scan(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """(doc_id, blob, spans) for every row of ``docs`` (doc_id, text; other columns are left out).

    Null and empty texts have no spans; repeated rows each have theirs; an empty table gives an empty table. With a
    ``ledger``, what it has scanned before is not scanned again.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(docs.select("text"))
    return ledger.findings(docs.select("doc_id", address().alias("blob")))


def joined(chosen: Column) -> Column:
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: Ledger | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's span replaced by ``mask``; n_chars follows where that column is there.

    Every row stays, repeated ones too: a document is not worse for the secret that is cut out of it. Overlapping spans are
    cut as one; null and empty texts stay as they are, texts of any length are read whole, an empty table gives an empty one.
    Other columns keep their names and values, whatever they are called.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(docs.select("text"))
    blob, hit = fresh(docs.columns, "blob"), fresh(docs.columns, "spans")
    hits = ledger.table().where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(hit))
    rows = docs.join(hits, address() == F.col(blob), "left")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        upto = F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        done = F.when(new, F.concat(acc["done"], upto, F.lit(mask))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate(hit, start, cut, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    rows = rows.withColumn("text", F.when(F.col(hit).isNotNull(), whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(hit).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[f"`{c}`" for c in docs.columns])
