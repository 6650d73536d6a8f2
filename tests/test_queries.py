"""Every query beside its SQL in DuckDB, on the small tables."""

from __future__ import annotations

import pytest
from compare import TABLES, duck_rows, spark_rows

from blobsight.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert spark_rows(catalogue.queries()[name](spark, sf)) == duck_rows(SQL[name], sf)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The small tables, with texts that have no words, no id, or letters whose lower case hangs on their place."""
    folder = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        (folder / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    texts = [None, "", "   ", "?! ###", "ΟΔΟΣ ΣΣ. aΣ", "İSTANBUL Iı", "ß ẞ É", "... -_-", "empty", "one two TWO"]
    rows = [*zip([*range(len(texts)), 9, None, None], [*texts, "two", "no id", "$$$"])]
    items = [(0, None), (1, "empty"), (2, "one two"), (3, "istanbul οδοσ σσ"), (None, "no id")]
    for t, own, schema in (("documents", rows, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        (folder / f"{t}.parquet").unlink()
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(folder / t))
        (folder / f"{t}.parquet").symlink_to(next((folder / t).glob("*.parquet")))
    return str(folder)


@pytest.mark.parametrize("name", ["hash_buckets", "sparse_cosine", "tokenize"])
def test_same_words_as_sql_in_odd_texts(spark, odd, name):
    assert spark_rows(catalogue.queries()[name](spark, odd)) == duck_rows(SQL[name], odd)
