"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: How folders of written tables are named.
WRITTEN = re.compile(r"/[a-z-]+-[0-9a-f]{32}$")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is set only where a local session has none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="oppsift-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: lineage ends there, and any executor can be lost. The shuffle
    files of the write go with its end, not when the driver happens to collect its garbage. ``by``: a column whose values get
    folders of their own."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """The same, and aggregates of the rows that the write itself finds, without a job of their own."""
    seen = Observation()
    out = written(df.observe(seen, *(v.alias(k) for k, v in measures.items())), name)
    return out, seen.get


def removed(*dfs: DataFrame, part: str = "") -> None:
    """Deletes what ``written`` made for each of dfs, once nothing reads it any more; of tables written ``by`` a column, only the
    folder ``part`` if that is given. Tables that it did not write stay."""
    for df in dfs:
        spark, files = df.sparkSession, df.inputFiles()
        if not files:
            continue
        path = files[0].rpartition("/")[0]
        while "=" in path.rpartition("/")[2]:
            path = path.rpartition("/")[0]
        if WRITTEN.search(path):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
