"""Session settings: a local session for tests and benches, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in one JVM.  On a cluster the launcher makes the session and this isn't called."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkbed")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "/tmp/inkbed-checkpoints")
        .getOrCreate()
    )


def ensure_checkpoints(spark: SparkSession) -> None:
    """Names a folder for checkpoint() if there is none: the one in spark.checkpoint.dir, or a local one in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{tempfile.gettempdir()}/inkbed-checkpoints"
        context.setCheckpointDir(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, not there yet, in the folder that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/inkbed-checkpoints"
    return f"{folder.rstrip('/')}/inkbed-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str = "table") -> DataFrame:
    """The same rows from a table in the shared folder.

    Unlike checkpoint() it also forgets what the optimizer knew of the rows: in loops, constraints that rounds hand on grow without end.
    """
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rows of a batch that is sent to a Python worker, where rows hold whole texts.
TEXT_ROWS = 256


def short_batches(spark: SparkSession) -> None:
    """Where the session has Spark's default of 10,000 rows for Arrow batches, sets one that fits whole texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
