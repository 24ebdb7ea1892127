"""Encoding of a stream: each micro-batch is numbered after the rows before it and appended as frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators import frames
from ..plans import blocks


def append_batch(batch: DataFrame, batch_id: int, order: Sequence[str], columns: Sequence[str], path: str, cfg: Config) -> None:
    """Frames of a batch under path/batch=<id>, numbered from where the batch before ended; written again as a whole if
    the batch is run again. Row counts are kept under path/_rows, one small file a batch: frames aren't read again."""
    spark = batch.sparkSession
    counts = f"{path}/_rows"
    before = 0
    if batch_id:
        done = spark.read.schema("batch long, rows long").parquet(counts).where(F.col("batch") < batch_id)
        before = done.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    numbered = blocks.number(batch, order)
    got = frames.encode(numbered, columns, cfg)
    got = got.withColumn("first", F.col("first") + F.lit(before)).withColumn("block", F.col("block") + F.lit(before))
    got.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    numbered.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")


def encode_stream(stream: DataFrame, order: Sequence[str], columns: Sequence[str], path: str, checkpoint: str, cfg: Config = Config("fast"), **trigger) -> StreamingQuery:
    """Starts a query that encodes a stream; each batch is in the order of its key, batches in that of their arrival."""
    work = lambda batch, k: append_batch(batch, k, order, columns, path, cfg)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
