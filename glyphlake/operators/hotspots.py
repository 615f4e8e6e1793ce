"""Hotspots: named rectangles of application structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import decoders as D
from glyphlake.functions.bytes import POINTS, f32, latin, points
from glyphlake.functions.text import rounded
from glyphlake.operators.scopes import owners


def geometry_points(elements: DataFrame) -> DataFrame:
    """Elements with ``points``, those that count for a scope's box; always read as singles."""
    p, e = F.col("parameters"), F.col("element_id")
    text = F.struct(f32(p, 0).alias("x"), f32(p, 4).alias("y"))
    r = F.col("restricted")
    corners = F.array(F.struct(r["x"].alias("x"), r["y"].alias("y")), F.struct((r["x"] + r["box_w"]).alias("x"), (r["y"] + r["box_h"]).alias("y")))
    found = F.when(e.isin(1, 7), points(p, "f32")).when((e == 5) & text["x"].isNotNull() & text["y"].isNotNull(), F.array(text)).when((e == 29) & r.isNotNull(), corners)
    drawn = elements.withColumn("restricted", F.when((F.col("class_id") == 4) & (e == 29), D.restricted_text(p)))
    return drawn.withColumn("points", F.when(F.col("class_id") == 4, found).cast(POINTS)).drop("restricted")


def hotspots(elements: DataFrame) -> DataFrame:
    """``doc_id, index, source_tag, name, x_min, y_min, x_max, y_max, raw_region_hex``.

    A scope opens with 0/21 and closes with 0/22 or 0/23, or at the end. Its box is
    its last valid region or else that of the geometry directly in it; scopes
    without a box of positive size give none. The index counts in the order of
    closing. One exchange by document serves the windows; elements are then
    combined by scope before any other step.
    """
    p, c, e = F.col("parameters"), F.col("class_id"), F.col("element_id")
    begin, end = (c == 0) & (e == 21), (c == 0) & e.isin(22, 23)
    relevant = elements.where(begin | end | ((c == 9) & (e == 1)) | ((c == 4) & e.isin(1, 5, 7, 29)))
    marked = owners(relevant, F.when(begin, 1).when(end, -1).otherwise(0)).where("owner is not null")
    # names end without zero bytes; what is not ASCII is left out
    props = marked.withColumn("prop", F.when((c == 9) & (e == 1), D.application_property(p)))
    value, key = F.col("prop.value"), F.col("prop.key")
    name = F.nullif(F.regexp_replace(F.regexp_replace(latin(value), "[^\\x00-\\x7f]", ""), "\\x00+$", ""), F.lit(""))
    typed = geometry_points(props).withColumns({"region": F.when(key == "region", D.region_box(value)), "tag": F.when(begin, F.struct(D.prefixed_ascii(p).alias("tag"))), "low_high": F.when(F.size("points") > 0, F.struct(*[agg(F.col("points")[axis]).alias(f"{axis}_{side}") for axis in "xy" for side, agg in (("min", F.array_min), ("max", F.array_max))]))})
    scopes = typed.groupBy("doc_id", "owner").agg(
        F.first("tag", ignorenulls=True)["tag"].alias("source_tag"),
        F.max(F.when(key == "name", F.struct("seq", name.alias("name"))))["name"].alias("own_name"),
        F.max(F.when(F.col("region").isNotNull(), F.struct("seq", "region", F.lower(F.hex(value)).alias("hex")))).alias("region"),
        *[F.min(f"low_high.{a}_min").alias(f"{a}_low") for a in "xy"],
        *[F.max(f"low_high.{a}_max").alias(f"{a}_high") for a in "xy"],
        F.min(F.when(end, F.col("seq"))).alias("closed"),
        F.max("depth").alias("depth"),
    )
    sides = {f"{a}_{s}": F.coalesce(F.col(f"region.region.{a}_{s}"), rounded(F.col(f"{a}_{'low' if s == 'min' else 'high'}"))) for s in ("min", "max") for a in "xy"}
    boxed = scopes.withColumns(sides).where("x_min < x_max and y_min < y_max")
    closing = Window.partitionBy("doc_id").orderBy(F.col("closed").asc_nulls_last(), F.col("depth").desc(), F.col("owner").desc())
    return boxed.select("doc_id", (F.row_number().over(closing) - 1).alias("index"), "source_tag", F.coalesce(F.nullif("own_name", F.lit("")), F.nullif("source_tag", F.lit(""))).alias("name"), "x_min", "y_min", "x_max", "y_max", F.coalesce("region.hex", F.lit("")).alias("raw_region_hex"))
