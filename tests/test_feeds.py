"""The feed as a stream of changes, and indexes that end."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta
from pathlib import Path

from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from blobsight.plans import catalogue
from blobsight.sources import indexes, nvd
from blobsight.sources.tables import MergeTable
from blobsight.streaming import jobs

CORPUS = "cve_id string, cpe_string string, description string, family string, text string"
PRODUCTS = ("openssl", "zlib", "busybox", "curl")


def record(i: int, hours: float, said: str) -> dict:
    at = (datetime(2026, 1, 1) + timedelta(hours=hours)).isoformat()
    cpe = f"cpe:2.3:a:{PRODUCTS[i % 4]}:{PRODUCTS[i % 4]}:1.{i}:*:*:*:*:*:*:*"
    return {"id": f"CVE-{i}", "lastModified": at, "descriptions": [{"lang": "en", "value": said}], "configurations": [{"nodes": [{"operator": "OR", "cpeMatch": [{"vulnerable": True, "criteria": cpe}]}]}]}


class Feed:
    """A feed in a file, beside a log of what was asked for."""

    def __init__(self, folder: Path):
        self.file, self.log = folder / "feed.json", folder / "log"

    def put(self, now: float, records: list[dict]) -> None:
        self.file.write_text(json.dumps({"timestamp": (datetime(2026, 1, 1) + timedelta(hours=now)).isoformat(), "cves": records}))

    def fetch(self):
        """A function of its own, as workers can't import the tests."""
        file, log = str(self.file), str(self.log)

        def fetch(params: dict) -> dict:
            import json

            with open(file) as f:
                feed = json.load(f)
            low, high = params.get("lastModStartDate", ""), params.get("lastModEndDate", "~")
            some = [c for c in feed["cves"] if low <= c["lastModified"] <= high]
            page = some[params["startIndex"] : params["startIndex"] + params["resultsPerPage"]]
            with open(log, "a") as f:
                f.write(json.dumps(params | {"given": [c["id"] for c in page]}) + "\n")
            return {"totalResults": len(some), "timestamp": feed["timestamp"], "vulnerabilities": [{"cve": c} for c in page]}

        return fetch

    def pages(self) -> list[str]:
        """Ids of the pages that tasks have read since the last call."""
        lines = [json.loads(x) for x in self.log.read_text().splitlines()] if self.log.exists() else []
        self.log.write_text("")
        return [i for x in lines if x["resultsPerPage"] > 1 for i in x["given"]]


def test_a_restart_reads_only_what_is_new(spark, tmp_path):
    feed = Feed(tmp_path)
    nvd.register_paged(spark, feed.fetch(), "changes_for_tests")
    corpus = MergeTable(spark, str(tmp_path / "corpus"), CORPUS, ["cve_id", "cpe_string"], buckets=4)

    def run() -> list[str]:
        changes = nvd.read_paged(spark, "changes_for_tests", streaming=True, resultsPerPage="7")
        query = jobs.refreshed(changes, corpus, str(tmp_path / "cp"))
        assert query.awaitTermination(120) and query.exception() is None
        return feed.pages()

    said = lambda: {r.cve_id: r.description for r in corpus.read().collect()}
    known = [record(i, i / 10, "first") for i in range(30)]
    feed.put(100, known)
    assert sorted(run()) == sorted(f"CVE-{i}" for i in range(30)) and len(said()) == 30  # five pages
    changed = [*known[:5], record(5, 150, "second"), *known[6:], record(30, 151, "new")]
    feed.put(160, changed)
    assert sorted(run()) == ["CVE-30", "CVE-5"]  # the others changed longer ago than the overlap
    assert said()["CVE-5"] == "second" and said()["CVE-30"] == "new" and said()["CVE-4"] == "first" and len(said()) == 31
    feed.put(161, changed)
    assert sorted(run()) in ([], ["CVE-30", "CVE-5"])  # within the 26 hours read again at most
    assert said()["CVE-5"] == "second" and len(said()) == 31


def test_windows_overlap_and_are_cut():
    reader = nvd.ChangesReader({"overlapHours": "26"}, lambda p: {})
    assert reader.windows("", "2026-01-01T00:00:00") == [{}]
    found = reader.windows("2026-01-02T02:00:00", "2026-09-01T00:00:00")
    assert found[0]["lastModStartDate"] == "2026-01-01T00:00:00" and found[-1]["lastModEndDate"] == "2026-09-01T00:00:00" and len(found) == 3
    assert all(a["lastModEndDate"] == b["lastModStartDate"] for a, b in zip(found, found[1:], strict=False))


def test_indexes_end_and_leave_others_alone(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=minutes)
    kept = indexes.JobIndexes(spark, str(tmp_path / "i"))
    chunk = lambda *jobs_: spark.createDataFrame([(j, f"{j}{n}", f"text {n}", [1.0]) for j in jobs_ for n in range(3)], "job_id string, id string, text string, embedding array<double>")
    put = lambda minutes, *jobs_: kept.build(chunk(*jobs_), F.lit(at(minutes)))
    jobs_at = lambda minutes: {r.job_id for r in kept.read(at(minutes)).select("job_id").distinct().collect()}
    files = lambda: sorted(p.parent.name.partition("=")[2] for p in (tmp_path / "i").rglob("*.parquet"))
    assert kept.read(at(0)).count() == 0 and kept.sweep(at(0)) == [] and not kept.teardown("a")
    put(0, "a", "b")
    put(5, "c")
    put(50, "d", "e")
    put(90, "b")  # built again: lives longer, and once
    assert jobs_at(59) == {"a", "b", "c", "d", "e"} and jobs_at(62) == {"b", "c", "d", "e"} and files().count("b") == 1
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    assert kept.sweep(at(62)) == ["a"] and set(files()) == {"b", "c", "d", "e"}
    assert kept.sweep(at(62)) == []
    assert kept.sweep(at(121)) == ["c", "d", "e"] and set(files()) == {"b"}  # an hour that is over is dropped whole
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    assert left.items() <= before.items() and jobs_at(121) == {"b"}
    assert kept.teardown("b") and not kept.teardown("b") and files() == []


def test_sweep_as_sql_has_it(spark, sf):
    assert spark_rows(catalogue.queries()["index_sweep"](spark, sf)) == duck_rows(catalogue.oracle_sql()["index_sweep"], sf)


def test_indexes_of_many_jobs_take_no_folder_a_job(spark, tmp_path):
    """What folders by job give, with as many files as hours and buckets."""
    at = lambda minutes: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=minutes)
    kept = indexes.BucketIndexes(spark, str(tmp_path / "i"), buckets=4)
    put = lambda minutes, a, b: kept.build(spark.range(a, b).selectExpr("cast(id as string) as job_id", "explode(array('x', 'y')) as id", "'text' as text", "array(1.0) as embedding").unionAll(spark.sql("select null, 'x', 'text', array(1.0)")), F.lit(at(minutes)))
    alive = lambda minutes: {int(r.job_id): r.n for r in kept.read(at(minutes)).groupBy("job_id").agg(F.count("*").alias("n")).collect()}
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    jobs_of = lambda df: sorted(int(r.job_id) for r in df.collect())
    assert alive(0) == {} and jobs_of(kept.sweep(at(0))) == [] and not kept.teardown("1")
    put(0, 0, 300)
    put(5, 300, 400)
    put(90, 0, 100)  # built again: lives longer, and once
    assert len(files()) <= 8 and alive(59) == dict.fromkeys(range(400), 2) and alive(62) == dict.fromkeys([*range(100), *range(300, 400)], 2)
    assert jobs_of(kept.sweep(at(62))) == [*range(100, 300)] and jobs_of(kept.sweep(at(62))) == [] and alive(59) == dict.fromkeys([*range(100), *range(300, 400)], 2)
    before = files()
    assert jobs_of(kept.sweep(at(121))) == [*range(300, 400)]  # an hour that is over is dropped whole
    assert files().items() <= before.items() and alive(121) == dict.fromkeys(range(100), 2)
    assert kept.read(at(121), "7").count() == 2 and kept.teardown("7") and not kept.teardown("7") and kept.read(at(121), "7").count() == 0
    put(90, 0, 100)
    put(200, 0, 100)  # all jobs of an hour move on: its folders go
    assert alive(121) == dict.fromkeys(range(100), 2) and {p.parts[-3] for p in files()} == {f"expires={(1_704_067_200 + 260 * 60) // 3600}"}
