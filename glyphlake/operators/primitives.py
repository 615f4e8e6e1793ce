"""Drawing primitives of metafiles as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import decoders as D
from glyphlake.functions.bytes import POINTS, part
from glyphlake.operators import state

#: Kinds in the order they are painted.
KINDS = ("polyline", "gdp", "polygon", "marker", "rectangle", "circle", "ellipse", "text", "restricted")
#: Curves are drawn as lines through their control points.
CURVES = (13, 14, 15, 16, 18, 19, 20, 21, 22, 23, 24, 25, 27)
_ITEM = f"struct<kind:string,points:{POINTS},a:double,b:double,text:string>"


def _item(kind: str, points: Column, a: Column | None = None, b: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), points.alias("points"), (none if a is None else a).alias("a"), (none if b is None else b).alias("b"), (none if text is None else text).alias("text")).cast(_ITEM)


def decoded(elements: DataFrame) -> DataFrame:
    """Drawing elements with their running style, their document's descriptors and ``points`` (of ids that are lists of points)."""
    styled = state.styled(elements.where("class_id in (4, 5)")).where("class_id = 4")
    joined = styled.join(state.profile(elements), "doc_id", "left")
    kind = F.col("vdc_type")
    payload = F.when(F.col("element_id").isin(10, 26), D.gdp_payload(F.col("parameters"), kind)).otherwise(F.col("parameters"))
    lists = F.col("element_id").isin(1, 2, 3, 7, 8, 10, 11, 17, 26, *CURVES)
    return joined.withColumn("points", F.when(lists, D.profile_points(payload, kind, F.col("vdc_precision"), F.col("vdc_real_bits"))).otherwise(F.array().cast(POINTS)))


def primitives(elements: DataFrame) -> DataFrame:
    """``doc_id, seq, sub, kind, points, a, b, text, color_at, stroke_width, font_size``.

    ``points`` are the vertices, or the corner, centre or anchor; ``a`` and ``b``
    the sizes (width and height, radii). A text holds what later elements append
    to it. Without a declared type of coordinates only restricted text is drawn.
    GDP primitives come after all other lines, in the style that holds at the end.
    """
    p, e, pts = F.col("parameters"), F.col("element_id"), F.col("points")
    args = (p, F.col("vdc_type"), F.col("vdc_precision"), F.col("vdc_real_bits"))
    rows = decoded(elements).withColumns({"xy": F.when(e == 5, D.xy(*args)), "circle": F.when(e == 12, D.circle(*args)), "ellipse": F.when(e == 17, D.ellipse(pts)), "own": F.when(e == 5, F.coalesce(D.cgm_text(part(p, 8)), D.cgm_text(part(p, 4)))).when(e.isin(4, 6), D.cgm_text(p)), "restricted": F.when(e == 29, D.restricted_text(p))})
    is_text = (e == 5) & F.col("xy").isNotNull() & F.col("own").isNotNull()
    so_far = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("text_no", F.sum(F.when(is_text, 1).otherwise(0)).over(so_far))
    spoken = rows.where((is_text | e.isin(4, 6)) & (F.col("text_no") > 0) & F.col("own").isNotNull())
    texts = spoken.groupBy("doc_id", "text_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "own"))), lambda x: x["own"]), "").alias("whole"))
    rows = rows.join(texts, ["doc_id", "text_no"], "left")

    one = lambda x, y: F.array(F.struct(x.alias("x"), y.alias("y")))
    first, second = F.get(pts, F.lit(0)), F.get(pts, F.lit(1))
    c, l, r = F.col("circle"), F.col("ellipse"), F.col("restricted")  # noqa: E741
    items = (
        F.when(e.isin(1, *CURVES) & (F.size(pts) >= 2), F.array(_item("polyline", pts)))
        .when(e == 2, F.transform(D.segments(pts), lambda s: _item("polyline", s)))
        .when(e.isin(10, 26) & (F.size(pts) >= 2), F.array(_item("gdp", pts)))
        .when(e.isin(7, 8) & (F.size(pts) >= 3), F.array(_item("polygon", pts)))
        .when(e == 3, F.transform(pts, lambda q: _item("marker", F.array(q))))
        .when((e == 11) & (F.size(pts) >= 2), F.array(_item("rectangle", one(F.least(first["x"], second["x"]), F.least(first["y"], second["y"])), F.abs(second["x"] - first["x"]), F.abs(second["y"] - first["y"]))))
        .when((e == 12) & c.isNotNull(), F.array(_item("circle", one(c["cx"], c["cy"]), c["r"], c["r"])))
        .when((e == 17) & l.isNotNull(), F.array(_item("ellipse", one(l["cx"], l["cy"]), l["rx"], l["ry"])))
        .when(is_text, F.array(_item("text", one(F.col("xy.x"), F.col("xy.y")), text=F.col("whole"))))
        .when((e == 29) & r.isNotNull(), F.array(_item("restricted", one(r["x"], r["y"]), r["box_w"], r["box_h"], r["text"])))
    )
    late = e.isin(10, 26)
    style = {n: F.when(late, F.col(f"last_{n}")).otherwise(F.col(n)).alias(n) for n in ("color_at", "stroke_width", "font_size")}
    return rows.select("doc_id", "seq", F.posexplode(items).alias("sub", "i"), *style.values()).select("doc_id", "seq", "sub", "i.*", *style)


def extreme_points(kind: Column, points: Column, a: Column, b: Column) -> Column:
    """The points of a primitive that bound the drawing."""
    p = F.get(points, F.lit(0))
    at = lambda dx, dy: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))
    return F.when(kind.isin("rectangle", "restricted"), F.array(p, at(a, b))).when(kind.isin("circle", "ellipse"), F.array(at(-a, -b), at(a, b))).otherwise(points)


def bounds(prims: DataFrame, extents: DataFrame) -> DataFrame:
    """``doc_id, x_min, y_min, x_max, y_max`` over all primitives.

    With a declared extent, points further from it than a quarter of its longer
    side are left out, unless that leaves none.
    """
    rows = prims.select("doc_id", F.explode(extreme_points(F.col("kind"), F.col("points"), F.col("a"), F.col("b"))).alias("p")).select("doc_id", "p.x", "p.y")
    joined = rows.join(extents.select("doc_id", "extent"), "doc_id", "left")
    x = F.col("extent")
    margin = F.greatest(F.lit(1.0), x["x_max"] - x["x_min"], x["y_max"] - x["y_min"]) * 0.25
    near = F.coalesce(F.col("x").between(x["x_min"] - margin, x["x_max"] + margin) & F.col("y").between(x["y_min"] - margin, x["y_max"] + margin), F.lit(False))
    aggs = {f"{axis}_{side}": F.coalesce(f(F.when(near, F.col(axis))), f(axis)) for axis in "xy" for side, f in (("min", F.min), ("max", F.max))}
    return joined.groupBy("doc_id").agg(*[v.alias(k) for k, v in aggs.items()])


def colors(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with ``color``: that of the document's final colour table or the default palette; black where none is set."""
    entry = table.select("doc_id", F.col("color_index").alias("color_at"), F.struct("r", "g", "b").alias("rgb"))
    hexed = D.color_hex(F.coalesce("rgb", D.default_color(F.col("color_at"))))
    return rows.join(entry, ["doc_id", "color_at"], "left").withColumn("color", F.when(F.col("color_at").isNull(), "#000000").otherwise(hexed)).drop("rgb")
