"""Diagnostics of binary payloads: how their bytes are spread and what text they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import decoders as D
from glyphlake.functions.bytes import latin, size, u16

TOP = 8
RUNS = 8
RUN_BYTES = 4
PREVIEW = 48
HEAD_BYTES = 64
#: A payload of less printable text and more entropy than this is called binary.
TEXT_SHARE = 0.45
ENTROPY_BITS = 6.5


def byte_counts(rows: DataFrame, key: list[str], payload: str = "payload") -> DataFrame:
    """Key columns with ``byte, count, first`` of each byte value that occurs, its number and first place."""
    pairs = F.regexp_extract_all(F.hex(payload), F.lit("[0-9A-F]{2}"), F.lit(0))
    each = rows.select(*key, F.posexplode(pairs).alias("at", "h"))
    return each.groupBy(*key, F.conv("h", 16, 10).cast("int").alias("byte")).agg(F.count("*").alias("count"), F.min("at").alias("first"))


def ascii_runs(payload: Column) -> Column:
    """``array<struct<offset, length, preview>>``: the first runs of at least four printable bytes."""
    text = latin(payload)
    tokens = F.regexp_extract_all(text, F.lit("[\\x20-\\x7E]++|[^\\x20-\\x7E]++"), F.lit(0))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<offset:bigint,length:bigint,preview:string>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        n = F.length(t).cast("long")
        run = F.array(F.struct(acc["at"].alias("offset"), n.alias("length"), F.left(t, F.lit(PREVIEW)).alias("preview")))
        wanted = (n >= RUN_BYTES) & t.rlike("^[\\x20-\\x7E]") & (F.size(acc["out"]) < RUNS)
        return F.struct((acc["at"] + n).alias("at"), F.when(wanted, F.concat(acc["out"], run)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, empty, step, lambda acc: acc["out"])


def head_words(payload: Column) -> Column:
    """Up to 32 numbers of two bytes at the head; a last odd byte is none."""
    n = F.least(F.lit(HEAD_BYTES), size(payload) - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / 2).cast("int") - 1), lambda i: u16(payload, i * 2).cast("int"))).otherwise(F.array().cast("array<int>"))


def leading_run(payload: Column, digits: str = "FF") -> Column:
    """How often a byte value stands at the beginning."""
    return (F.length(F.regexp_extract(F.hex(payload), f"^(?:{digits})*+", 0)) / 2).cast("int")


def rounded4(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.0000")).cast("double")


def analyze(rows: DataFrame, key: list[str], payload: str = "payload") -> DataFrame:
    """Key columns with ``length, ascii_ratio, entropy_bits_per_byte, top_bytes, leading_ff_run, ascii_runs, head_u16, restricted_text_detected, likely_binary_payload``.

    Empty payloads have ratio and entropy 0. Ratio and entropy are rounded to four
    decimals after the judgement.
    """
    counts = byte_counts(rows, key, payload)
    total = F.sum("count").over(Window.partitionBy(*key))
    shares = counts.withColumn("share", F.col("count") / total)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("count"), "first")))
    entry = F.when(F.col("rank") <= TOP, F.struct("rank", F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(F.col("byte").cast("long")), 2, "0"))).alias("byte"), "count"))
    spread = ranked.groupBy(*key).agg(
        F.sum(F.when(F.col("byte").between(32, 126), F.col("share")).otherwise(0.0)).alias("ascii_share"),
        F.sum(F.when(F.col("byte").between(32, 126), F.col("count")).otherwise(0)).alias("printable"),
        (-F.sum(F.col("share") * F.log2("share"))).alias("entropy"),
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["byte"].alias("byte"), x["count"].alias("count"))).alias("top_bytes"),
    )
    b = F.col(payload)
    ratio = F.when(size(b) > 0, F.col("printable") / size(b)).otherwise(0.0)
    entropy = F.abs(F.coalesce("entropy", F.lit(0.0)))
    return rows.join(spread, key, "left").select(
        *key,
        size(b).alias("length"),
        rounded4(ratio).alias("ascii_ratio"),
        rounded4(entropy).alias("entropy_bits_per_byte"),
        F.coalesce("top_bytes", F.array().cast("array<struct<byte:string,count:bigint>>")).alias("top_bytes"),
        leading_run(b).alias("leading_ff_run"),
        ascii_runs(b).alias("ascii_runs"),
        head_words(b).alias("head_u16"),
        D.restricted_text(b).isNotNull().alias("restricted_text_detected"),
        ((ratio < TEXT_SHARE) & (entropy > ENTROPY_BITS)).alias("likely_binary_payload"),
    )


def prefix_census(elements: DataFrame) -> DataFrame:
    """``compression, row_padding, bit_order, orientation, count`` over the raster elements (4/29 without text) of all documents."""
    rows = elements.where("class_id = 4 and element_id = 29").where(D.restricted_text(F.col("parameters")).isNull())
    t = rows.withColumn("t", D.raster_prefix(F.col("parameters"))).where("t is not null")
    return t.groupBy("t.compression", "t.row_padding", "t.bit_order", "t.orientation").agg(F.count("*").alias("count"))


def consensus(rows: DataFrame, value: list[str], key: str = "doc_id", min_count: int = 1, min_fraction: float = 0.0) -> DataFrame:
    """``key`` and the most frequent combination of the columns ``value``; none where it is too rare. Rows with nulls do not vote; ties go to the smallest."""
    votes = rows.dropna(subset=value).groupBy(key, *value).agg(F.count("*").alias("n"))
    best = votes.groupBy(key).agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("less"), *value)).alias("v"))
    n = -F.col("v.less")
    return best.where((n >= max(1, min_count)) & (n / F.col("all") >= min_fraction)).select(key, *[F.col(f"v.{x}").alias(x) for x in value])
