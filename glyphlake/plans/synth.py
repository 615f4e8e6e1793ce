"""Metafiles made from tables, so that queries over tables can exercise the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.bytes import hex_unsigned

PART = 0x7FFF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(rows: DataFrame, doc: Column, order: Column, statement: Column) -> DataFrame:
    """``doc_id, content``: the statements of each document in order, with semicolons behind them."""
    said = rows.select(doc.cast("string").alias("doc_id"), F.struct(order.alias("o"), statement.alias("s")).alias("x")).where("x.s is not null")
    listed = said.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("all"))
    return listed.select("doc_id", F.concat(F.array_join(F.transform("all", lambda x: x["s"]), "; "), F.lit(";")).cast("binary").alias("content"))


def element_hex(class_id: Column, element_id: Column, parameters: Column) -> Column:
    """An element of a binary metafile in hexadecimal; parameters (also hexadecimal) of up to 32767 bytes."""
    n = F.length(parameters) / 2
    short = n < 31
    head = hex_unsigned(class_id * 4096 + element_id * 32 + F.when(short, n).otherwise(31), 2)
    pad = F.when(n % 2 == 1, "00").otherwise("")
    return F.concat(head, F.when(short, "").otherwise(hex_unsigned(n, 2)), parameters, pad)


def binary_files(rows: DataFrame, doc: Column, order: Column, class_id: Column, element_id: Column, parameters: Column) -> DataFrame:
    """``doc_id, content``: the elements of each document in order."""
    made = rows.select(doc.cast("string").alias("doc_id"), F.struct(order.alias("o"), element_hex(class_id, element_id, parameters).alias("h")).alias("x"))
    listed = made.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("all"))
    return listed.select("doc_id", F.unhex(F.array_join(F.transform("all", lambda x: x["h"]), "")).alias("content"))
