"""Everything that is known of a document as one JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.bytes import size
from glyphlake.operators.diagnostics import analyze
from glyphlake.operators.hotspots import hotspots
from glyphlake.operators.images import raw_images
from glyphlake.operators.svg import drawings
from glyphlake.sources.work import materialize


def element_histogram(elements: DataFrame) -> DataFrame:
    """``doc_id, class_id, element_id, count, first`` (the place of its first element)."""
    return elements.groupBy("doc_id", "class_id", "element_id").agg(F.count("*").alias("count"), F.min("seq").alias("first"))


def _list(rows: DataFrame, name: str, order: list[Column], *fields: Column) -> DataFrame:
    entry = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("item"))
    return rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["item"]).alias(name))


def snapshots(files: DataFrame, elements: DataFrame) -> DataFrame:
    """``doc_id, snapshot``: a struct of sizes, histogram, elements, diagnostics, raw images, hotspots and the drawing."""
    elements = materialize(elements, "elements")
    p, low = F.col("parameters"), lambda c: F.lower(F.hex(c))
    kinds = _list(element_histogram(elements), "element_histogram", [-F.col("count"), F.col("first")], F.col("class_id"), F.col("element_id"), F.col("count"))
    listed = _list(elements, "elements", [F.col("seq")], F.col("offset"), F.col("class_id"), F.col("element_id"), size(p).alias("parameter_length"), low(p).alias("parameters_hex"))
    payloads = elements.where("class_id = 4 and element_id = 29").select("doc_id", "seq", "offset", p.alias("payload"))
    studied = analyze(payloads, ["doc_id", "seq"]).join(payloads.select("doc_id", "seq", "offset"), ["doc_id", "seq"])
    fields = [c for c in studied.columns if c not in ("doc_id", "seq", "offset")]
    studies = _list(studied, "element29_analysis", [F.col("seq")], F.col("offset"), *[F.col(c) for c in fields], F.array().cast("array<string>").alias("decode_candidates"), F.lit(False).alias("has_plausible_decode"))
    images = _list(raw_images(elements), "raw_images", [F.col("index")], F.col("index"), F.col("element_offset"), F.col("width"), F.col("height"), F.col("local_color_precision"), F.col("cell_representation_mode"), size(F.col("payload")).alias("payload_size"), low(F.col("payload")).alias("payload_hex"))
    spots = materialize(hotspots(elements), "hotspots")
    areas = _list(spots, "hotspots", [F.col("index")], *[F.col(c) for c in spots.columns if c != "doc_id"])
    out = files.select(F.col("doc_id").cast("string").alias("doc_id"), size(F.col("content")).alias("byte_length"))
    parts = (kinds, listed, studies, images, areas)
    for part in (*parts, materialize(drawings(files, elements), "drawings").withColumnRenamed("svg", "vector_svg")):
        out = out.join(part, "doc_id", "left")
    whole = F.struct(
        "byte_length",
        F.when(F.col("elements").isNull(), 0).otherwise(F.size("elements")).alias("element_count"),
        *[F.coalesce(n, F.from_json(F.lit("[]"), dict(x.dtypes)[n])).alias(n) for n, x in zip(("element_histogram", "elements", "element29_analysis", "raw_images", "hotspots"), parts, strict=True)],
        "vector_svg",
    )
    return out.select("doc_id", whole.alias("snapshot"))


def snapshot_json(files: DataFrame, elements: DataFrame) -> DataFrame:
    """``doc_id, json``: snapshots as indented text; unknown values are null, not left out."""
    return snapshots(files, elements).select("doc_id", F.to_json("snapshot", {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))
