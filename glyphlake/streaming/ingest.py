"""Metafiles as a stream of arriving files.

Framing and decoding look at one file at a time, so the batch expressions run in
each micro-batch as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphlake.sources.files import elements

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_metafiles(spark: SparkSession, folder: str, pattern: str = "*.cgm", max_files: int = 1000) -> DataFrame:
    """``doc_id, content`` of files as they arrive, up to max_files in a micro-batch."""
    files = spark.readStream.schema(_SCHEMA).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)
    return files.select(F.col("path").alias("doc_id"), "content")


def stream_elements(spark: SparkSession, folder: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, **options) -> StreamingQuery:  # noqa: ANN003
    """Write the elements of arriving files, or what ``transform`` makes of them, as Parquet; each file is read once.

    A batch that is repeated after a failure replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = elements(batch, mode="PERMISSIVE")
        (transform(rows) if transform else rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_metafiles(spark, folder, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
