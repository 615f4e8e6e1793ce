"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import bloom_lm, decontaminate, licences, line_chunks, mixture, simhash, string_kernel, token_store, voronoi_topk, warc
from glyphlake.llm.common import crc_mod, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_passages(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return voronoi_topk.topk(vectors, vectors.where("vec_id % 100 = 0"), 10)


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of good quality weigh 2, of bad quality 1/2; the others count 1."""
    return table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixture.mix(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_store.read_index(spark, store)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = string_kernel.train(docs, ~held_out)
    return string_kernel.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_exact_topk, op4_mixture, op5_token_store, op6_warc, op7_simhash, op8_licences, op9_bloom_lm, op10_string_kernel)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": _TOPK, "op6_warc": _WARC}


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

# base32 of the 20 bytes of a SHA-1: 32 groups of five bits
_WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS best FROM p
), b AS (
  SELECT *, array_to_string(list_transform(string_split_regex(digest, ''), lambda c: right(bin(instr('0123456789abcdef', c) - 1 + 16), 4)), '') AS bits FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         16 * CAST(substr(bits, CAST(5*i+1 AS BIGINT), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5*i+2 AS BIGINT), 1) AS INTEGER) + 4 * CAST(substr(bits, CAST(5*i+3 AS BIGINT), 1) AS INTEGER)
         + 2 * CAST(substr(bits, CAST(5*i+4 AS BIGINT), 1) AS INTEGER) + CAST(substr(bits, CAST(5*i+5 AS BIGINT), 1) AS INTEGER) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b
"""
