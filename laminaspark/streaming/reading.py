"""Streams that read no faster than they are worked off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def files(spark: SparkSession, path: str, schema, most_files: int = 8, most_bytes: int | None = None) -> DataFrame:
    """The Parquet files that lie or will lie at a path (a glob), as a stream. A micro-batch takes `most_files` files, or files of
    about `most_bytes` together if given, and the next one waits until it is done: a burst of files stays on storage
    instead of in memory or state."""
    limit = {"maxBytesPerTrigger": most_bytes} if most_bytes else {"maxFilesPerTrigger": most_files}
    return spark.readStream.schema(schema).options(**limit).parquet(path)
