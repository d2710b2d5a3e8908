"""Incremental ingest: pages that arrive as files are parsed and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str = "page_id") -> StreamingQuery:
    """Stream Parquet files below ``source`` through ``transform`` into ``target``, all that is there, then stop.

    A batch is written to a folder of its number, overwritten if it runs again, so that a batch is never there twice.
    Within a batch the rows of a key are dropped after the first.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
