"""The folder that driver and executors share, and tables that cut a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; a local session without that setting gets a folder of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", there)
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Has Spark delete a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, cleanup: bool = False) -> DataFrame:
    """df as a table in the shared folder: what follows reads that instead of working it out again.

    With cleanup the shuffle files of the writing are deleted as soon as it is done.
    """
    spark = df.sparkSession
    path, was = folder(spark, name), spark.conf.get(CLEANUP, None)
    if cleanup:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if cleanup:
            spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
