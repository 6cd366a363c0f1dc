"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows of an Arrow batch: whole texts travel in them, so the default of 10,000 is too many.
BATCH_ROWS = 2000
#: Bytes of an Arrow batch: whole matrices travel in some.
BATCH_BYTES = 64 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and keep Arrow batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def local(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairn")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; where that is unset, a temporary one, but in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/cairn/{spark.sparkContext.applicationId}"


def settle(df: DataFrame, what: str, file_rows: int = 0) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    file_rows bounds the rows of a file (0: no bound), as readers hold thousands of rows at a time, however long.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing will read any more."""
    _delete(df.sparkSession, df.settled_at)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has settled; for when its results have been read or written elsewhere."""
    if spark.conf.get("spark.checkpoint.dir", None):
        _delete(spark, shared_dir(spark))
