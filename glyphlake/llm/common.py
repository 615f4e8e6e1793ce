"""What the operators of this subpackage share: tables, work folders, word columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in all operators that count words.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a local master gets a temporary folder (one
    machine, as in tests); a cluster must name one.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/glyphlake-work"
        sc.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/glyphlake"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file systems; one that is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder within one file system; one that is not there is no error."""
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            raise OSError(f"{source} can't be moved to {target}")


class Scratch:
    """Tables and folders that only the steps before a result need: gone when the block ends.

    What leaves the block must have been written elsewhere, as by ``stash``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def folder(self, name: str) -> str:
        self.paths.append(f"{work_dir(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        """As ``stash``, until the block ends."""
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by keys to the session's number of tasks, or to ``tasks`` where the data ask for more."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks > usual else df.repartition(*keys)


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null and blank texts."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "x")
    return F.length(F.regexp_replace(runs, f"[{SPACE}]+", "")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fs_path(uri: str):
    """(pyarrow filesystem, path) of a shared folder; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
