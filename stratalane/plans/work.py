"""Tables written once to the shared work folder: read again, they are the same rows in the same partitions of files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a fresh local one only in a local session that has none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(sc, "_stratalane_work"):
        sc._stratalane_work = "file://" + tempfile.mkdtemp(prefix="stratalane-")
    return sc._stratalane_work


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the work folder, read back. A task that is run again leaves the rows of one attempt only."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch of rows between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def batched(df: DataFrame) -> DataFrame:
    """df, with batches to Python workers bounded by bytes: a frame is a large row, and ten thousand of them make a default batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df
