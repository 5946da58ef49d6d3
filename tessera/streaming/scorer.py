"""Scoring of arriving documents: the stateless transformations of the batch plans on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_documents(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """Parquet files arriving in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def score_stream(docs: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a batch scorer to each micro-batch and append its rows to ``out``; exactly once by file and epoch."""

    def write(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
