"""Tables that a long query writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A folder in ``spark.checkpoint.dir``, which all executors share; only a local master may do without the setting."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/glyphlake-work"
        sc.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/glyphlake"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: computed once, though it is read several times, and a leaf of the plans that follow."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df in as many partitions as the session shuffles to, for small rows of which each makes much work: their bytes alone would give few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
