"""The query catalogue: every query with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from blobsight.plans import blobs, components, flows  # noqa: F401  (each registers its queries)
from blobsight.plans.registry import QUERIES


def queries() -> dict:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
