"""Corpus pipeline: from raw documents to stored token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents. What a stage returns is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.llm import decontaminate, mixture, simhash, string_kernel, token_store
from glyphlake.llm.common import crc_mod, table, work_dir
from glyphlake.llm.queries import quality_weights, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that are null or without letters go.

    Rows are told apart by id and text; rows of one id and text share the answer.
    """
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = string_kernel.train(docs, ~held_out)
    return string_kernel.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Of rows that share this id, the one of the smallest text hash stays. Rows
    without an id belong to no group and all stay. Texts are shuffled once.
    """
    kept = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns)
    one = named.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return one.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["doc_id"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents without words are not taken."""
    return mixture.apply_mix(docs, mixture.mix(docs, quality_weights(spark, sf_dir)))


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a content-addressed store, and what is read back from it."""
    return token_store.read_index(spark, token_store.write_store(docs, tokenizer_path()))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", store_tokens),
]

#: Kernel scores, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
