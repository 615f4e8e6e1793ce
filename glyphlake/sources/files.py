"""Collections of metafiles as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.sources import cleartext, framing
from glyphlake.sources.sniff import is_clear_text


def read_metafiles(spark: SparkSession, path: str | list[str], pattern: str = "*.cgm") -> DataFrame:
    """``doc_id, content``: one row per file, its path as id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def sample_files(files: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """A sample of files that is the same in each run."""
    return files.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def elements(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Elements of the files (``doc_id, content``): ``doc_id, seq, class_id, element_id, parameters, offset``.

    Each file is read as clear text or as binary, as its head tells. ``mode`` is
    that of binary files that are cut: FAILFAST fails the query, PERMISSIVE keeps
    what stands before and reports in ``parse_errors``. ``seq`` orders the elements
    of a file; it may have gaps.
    """
    return _all(files, mode).where("error is null").drop("error")


def parse_errors(files: DataFrame) -> DataFrame:
    """``doc_id, error`` of the files that are cut."""
    return _all(files, "PERMISSIVE").where("error is not null").select("doc_id", "error")


def _all(files: DataFrame, mode: str) -> DataFrame:
    marked = files.select("doc_id", "content", is_clear_text(F.col("content")).alias("is_text"))
    return framing.frame_files(marked.where("not is_text"), mode).unionByName(cleartext.elements(marked.where("is_text")))
