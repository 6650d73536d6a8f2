"""Raw documents to training tokens: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blobsight.llm import ledger, mixing, pieces, quality, queries, simhash
from blobsight.scratch import remove, written
from blobsight.session import ship_package


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the data set's rated documents."""
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    return ledger.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text, with the columns that say where it came from."""
    return pieces.encode(docs, queries.vocabulary("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", near_copies),
    ("secret scans", secrets),
    ("mixing sources", mixture),
    ("SentencePiece encoding", tokens),
]

#: Fingerprints, trained models and files are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next, after which they go."""
    ship_package(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = written(docs, "stage")
            if before:
                remove(spark, before)
            before = path
    return docs
