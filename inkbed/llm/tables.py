"""Intermediate tables in the cluster's shared folder, to cut lineage where a result is read more than once."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset (local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/inkbed-checkpoints"
    return f"{folder.rstrip('/')}/inkbed-{spark.sparkContext.applicationId}"


def kept(rows: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again: any executor may be lost afterwards."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.kept_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that kept() made and nothing reads any more."""
    for t in tables:
        if t is not None:
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.kept_path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a batch that is sent to a Python worker, in operators on whole texts.
BATCH_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """Where the session has Spark's default of 10,000 rows for Arrow batches, sets one that fits whole texts (some MB)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
