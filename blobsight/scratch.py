"""Tables that cut lineage: written once to the shared checkpoint folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh folder only in local mode, where driver and tasks share one machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="blobsight-")
        sc.setCheckpointDir(folder)
    return folder


def files(spark: SparkSession, path: str):
    """The Hadoop file system that ``path`` is on, and the path in its form."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table that lasts as long as the application: its folder is removed when the driver ends."""
    root = f"{shared_folder(spark).rstrip('/')}/blobsight/{spark.sparkContext.applicationId}"
    fs, at = files(spark, root)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """The same as ``materialise``, with the table's path, for those who ``remove`` it before the application ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = files(spark, path)
    fs.delete(at, True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    Lost executors cost nothing but a reread: what follows depends on files that every executor sees.
    """
    return written(df, name)[0]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out to as many tasks as the session asks for, however few bytes they are: for rows that are much work each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 1 << 18) -> DataFrame:
    """Deal ``rows`` rows out by ``keys`` so that a task gets about ``most`` of them, whatever the session asks for: what a task holds
    does not grow with the table, unless rows share a key."""
    return df.repartition(max(1, -(-rows // most)), *keys)
