"""What holds for a whole document: descriptors, extents, colours; and the running style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import decoders as D
from glyphlake.functions.bytes import f32, size, u8, u16


def last_value(value: Column, condition: Column | None = None) -> Column:
    """Aggregate: the value of the last element that has one."""
    there = value.isNotNull() if condition is None else condition & value.isNotNull()
    return F.max(F.when(there, F.struct(F.col("seq"), value.alias("v"))))["v"]


def profile(elements: DataFrame) -> DataFrame:
    """``doc_id, vdc_type, vdc_precision, vdc_real_bits``, each the last that is declared in the document, or null."""
    p, e = F.col("parameters"), F.col("element_id")
    head, mantissa = u16(p, 0), u16(p, 4)
    real = F.when(head.isin(32, 64), head).when(mantissa >= 52, 64).when(mantissa >= 23, 32)
    found = elements.where((F.col("class_id") == 1) & e.isin(3, 11, 12))
    return found.groupBy("doc_id").agg(
        last_value(F.coalesce(u16(p, 0), u8(p, 0)), e == 3).cast("int").alias("vdc_type"),
        last_value(u16(p, 0), e == 11).cast("int").alias("vdc_precision"),
        last_value(real, e == 12).cast("int").alias("vdc_real_bits"),
    )


def drawing_state(elements: DataFrame) -> DataFrame:
    """``doc_id, extent, transparent, clip, clipping``: the last of each counts for the whole drawing."""
    p, c, e = F.col("parameters"), F.col("class_id"), F.col("element_id")
    found = elements.where(((c == 2) & (e == 6)) | ((c == 3) & e.isin(4, 5, 6)))
    return found.groupBy("doc_id").agg(
        last_value(D.vdc_extent(p), c == 2).alias("extent"),
        F.coalesce(last_value(D.flag(p), (c == 3) & (e == 4)), F.lit(True)).alias("transparent"),
        last_value(D.vdc_extent(p), (c == 3) & (e == 5)).alias("clip"),
        F.coalesce(last_value(D.flag(p), (c == 3) & (e == 6)), F.lit(False)).alias("clipping"),
    )


def color_table(elements: DataFrame) -> DataFrame:
    """``doc_id, color_index, r, g, b``: entries set last, of each document."""
    entries = elements.where("class_id = 5 and element_id = 34").select("doc_id", "seq", F.explode(D.color_table(F.col("parameters"))).alias("c"))
    last = F.max(F.struct("seq", "c.layout", "c.r", "c.g", "c.b"))
    return entries.groupBy("doc_id", F.col("c.color_index").alias("color_index")).agg(last.alias("last")).select("doc_id", "color_index", *[F.col(f"last.{n}").alias(n) for n in "rgb"])


def color_value_extent(elements: DataFrame) -> DataFrame:
    """``doc_id, color_extent`` (array of six)."""
    found = elements.where("class_id = 1 and element_id = 10")
    return found.groupBy("doc_id").agg(last_value(D.color_value_extent(F.col("parameters"))).alias("color_extent"))


def palette_bytes(elements: DataFrame) -> DataFrame:
    """``doc_id, palette``: 256 colours of three bytes, of documents that set some."""
    table = color_table(elements).where("color_index between 0 and 255")
    own = table.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("color_index").cast("int"), F.struct("r", "g", "b")))).alias("m"))
    color = lambda i: F.coalesce(F.try_element_at("m", i), D.default_color(i))
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.concat(*[byte(color(i)[n]) for n in "rgb"])), "")
    return own.select("doc_id", F.unhex(digits).alias("palette"))


def styled(elements: DataFrame) -> DataFrame:
    """Elements with ``color_at`` (index or null), ``stroke_width``, ``font_size`` as set before them, and the same at the end.

    Settings that are not positive numbers are passed over.
    """
    p, c, e = F.col("parameters"), F.col("class_id"), F.col("element_id")
    w = Window.partitionBy("doc_id").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    set_ = {
        "color_at": F.when((c == 5) & (e == 4) & (size(p) > 0), u8(p, 0)),
        "stroke_width": F.when((c == 5) & (e == 3) & (f32(p, 0) > 0), F.greatest(F.lit(0.25), f32(p, 0))),
        "font_size": F.when((c == 5) & (e == 15) & (f32(p, 0) > 0), F.greatest(F.lit(6.0), f32(p, 0))),
    }
    default = {"color_at": F.lit(None), "stroke_width": F.lit(1.0), "font_size": F.lit(10.0)}
    marked = elements.withColumns({f"_{k}": v for k, v in set_.items()})
    running = {k: F.coalesce(F.last(f"_{k}", ignorenulls=True).over(so_far), default[k]) for k in set_}
    final = {f"last_{k}": F.coalesce(F.last(f"_{k}", ignorenulls=True).over(whole), default[k]) for k in set_}
    return marked.withColumns(running | final).drop(*[f"_{k}" for k in set_])
