"""SVG drawings of metafiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.bytes import bind
from glyphlake.functions.text import escaped, fixed3, round3
from glyphlake.operators import primitives as P
from glyphlake.operators import state
from glyphlake.operators.raster import rasters
from glyphlake.sources.work import materialize

MARKER_SIZE = 2.0
CLIP_ID = "cgmClip0"


def view_boxes(docs: DataFrame, prims: DataFrame, states: DataFrame, images: DataFrame) -> DataFrame:
    """``doc_id, x0, y0, x1, y1, width, height`` of every document.

    The extent where there is a raster; else the bounds of the primitives, the
    extent, the raster's size, or 0 to 100. All have three decimals; sides are at least 1.
    """
    points = P.bounds(prims, states)
    joined = docs.select("doc_id").join(states.select("doc_id", "extent"), "doc_id", "left").join(points, "doc_id", "left").join(images.select("doc_id", "total_width", "total_height"), "doc_id", "left")
    raster, extent = F.col("total_width").isNotNull(), F.col("extent")
    sides = {}
    for k, own, size in (("x0", "x_min", F.lit(0.0)), ("y0", "y_min", F.lit(0.0)), ("x1", "x_max", F.coalesce("total_width", F.lit(100))), ("y1", "y_max", F.coalesce("total_height", F.lit(100)))):
        sides[k] = round3(F.when(raster & extent.isNotNull(), extent[own]).otherwise(F.coalesce(F.col(own), extent[own], size.cast("double"))))
    boxed = joined.withColumns(sides)
    return boxed.select("doc_id", *sides, F.greatest(F.lit(1.0), round3(F.col("x1") - F.col("x0"))).alias("width"), F.greatest(F.lit(1.0), round3(F.col("y1") - F.col("y0"))).alias("height"))


def _flip(y: Column) -> Column:
    return F.col("y1") - (y - F.col("y0"))


def _attr(**values: Column) -> list[Column]:
    return [x for k, v in values.items() for x in (F.lit(f' {k.replace("_", "-")}="'), v, F.lit('"'))]


def fragments(prims: DataFrame) -> DataFrame:
    """Primitives with ``color, y0, y1, clip_attr`` to ``doc_id, rank, seq, sub, fragment``, their line of the drawing."""
    kind, a, b = F.col("kind"), F.col("a"), F.col("b")
    p = F.get("points", F.lit(0))
    x, y = p["x"], p["y"]
    stroke = _attr(stroke=F.col("color"), stroke_width=fixed3(F.col("stroke_width")))
    listed = F.array_join(F.transform("points", lambda q: F.concat(fixed3(q["x"]), F.lit(","), fixed3(F.col("y1") - (q["y"] - F.col("y0"))))), " ")
    line = F.concat(F.lit("    <polyline"), *_attr(points=listed), *stroke, F.lit(" />"))
    polygon = F.concat(F.lit("    <polygon"), *_attr(points=listed), *stroke, F.lit(' fill="none" />'))
    centre = _attr(cx=fixed3(x), cy=fixed3(_flip(y)))
    marker = F.concat(F.lit("    <circle"), *centre, F.lit(f' r="{MARKER_SIZE:.3f}"'), *_attr(fill=F.col("color")), F.lit(' stroke="none" />'))
    rectangle = F.concat(F.lit("    <rect"), *_attr(x=fixed3(x), y=fixed3(_flip(y + b)), width=fixed3(a), height=fixed3(b)), *stroke, F.lit(' fill="none" />'))
    circle = F.concat(F.lit("    <circle"), *centre, *_attr(r=fixed3(a)), *stroke, F.lit(' fill="none" />'))
    ellipse = F.concat(F.lit("    <ellipse"), *centre, *_attr(rx=fixed3(a), ry=fixed3(b)), *stroke, F.lit(' fill="none" />'))
    at = _attr(x=fixed3(x), y=fixed3(_flip(y)), fill=F.col("color"))
    text = F.concat(F.lit("  <text"), *at, *_attr(font_size=fixed3(F.col("font_size"))), F.lit(' font-family="sans-serif"'), F.col("clip_attr"), F.lit(">"), escaped(F.col("text")), F.lit("</text>"))
    font = F.greatest(F.lit(4.0), F.least(F.col("font_size"), F.abs(b)))
    boxed = F.concat(F.lit("  <text"), *at, *_attr(font_size=fixed3(font)), F.lit(' font-family="sans-serif"'), *_attr(textLength=fixed3(F.greatest(F.lit(1.0), F.abs(a)))), F.lit(' lengthAdjust="spacingAndGlyphs"'), F.col("clip_attr"), F.lit(">"), escaped(F.col("text")), F.lit("</text>"))
    lines = {"polyline": line, "gdp": line, "polygon": polygon, "marker": marker, "rectangle": rectangle, "circle": circle, "ellipse": ellipse, "text": text, "restricted": boxed}
    fragment, rank = F.lit(None), F.lit(None)
    for i, (k, v) in enumerate(lines.items()):
        fragment, rank = F.when(kind == k, v).otherwise(fragment), F.when(kind == k, i).otherwise(rank)
    return prims.select("doc_id", rank.cast("int").alias("rank"), "seq", "sub", fragment.alias("fragment"))


def _images() -> Column:
    """Lines of the raster: overlays scaled into the view box, or a background that fills it."""
    sx, sy = F.col("width") / F.greatest(F.lit(1.0), F.col("total_width").cast("double")), F.col("height") / F.greatest(F.lit(1.0), F.col("total_height").cast("double"))

    def image(x: Column, y: Column, w: Column, h: Column, fit: str, href: Column) -> Column:
        return F.concat(F.lit("  <image"), *_attr(x=fixed3(x), y=fixed3(y), width=fixed3(w), height=fixed3(h)), F.lit(f' preserveAspectRatio="{fit}" image-rendering="optimizeQuality"'), *_attr(href=href), F.col("clip_attr"), F.lit(" />"))

    shown = F.filter("overlays", lambda o: (o["w"] > 0) & (o["h"] > 0))
    many = F.transform(shown, lambda o: image(F.col("x0") + o["x"] * sx, F.col("y0") + o["y"] * sy, o["w"] * sx, o["h"] * sy, "none", o["href"]))
    one = F.array(image(F.col("x0"), F.col("y0"), F.col("width"), F.col("height"), "xMidYMid meet", F.col("href")))
    return F.when(F.col("overlays").isNotNull(), many).when(F.col("href").isNotNull(), one).otherwise(F.array().cast("array<string>"))


def _clip_lines() -> Column:
    c = F.col("clip")
    rect = F.concat(F.lit("      <rect"), *_attr(x=fixed3(c["x_min"]), y=fixed3(_flip(c["y_max"])), width=fixed3(c["x_max"] - c["x_min"]), height=fixed3(c["y_max"] - c["y_min"])), F.lit(" />"))
    return F.when(F.col("clip_attr") != "", F.array(F.lit("  <defs>"), F.lit(f'    <clipPath id="{CLIP_ID}">'), rect, F.lit("    </clipPath>"), F.lit("  </defs>"))).otherwise(F.array().cast("array<string>"))


def vector_svg(files: DataFrame, elements: DataFrame) -> DataFrame:
    """``doc_id, svg`` of every file (``doc_id, content``): rasters below, then lines, areas and texts by kind.

    Elements, primitives and rasters are each read several times, so each is
    written once as a table in the session's shared folder.
    """
    return drawings(files, materialize(elements, "elements"))


def drawings(files: DataFrame, elements: DataFrame) -> DataFrame:
    """The same of elements that are a table already."""
    images = materialize(rasters(files, elements), "rasters")
    states = materialize(state.drawing_state(elements), "states")
    return compose(files, materialize(P.primitives(elements), "primitives"), states, state.color_table(elements), images)


def compose(docs: DataFrame, prims: DataFrame, states: DataFrame, table: DataFrame, images: DataFrame) -> DataFrame:
    c = F.col("clip")
    clip_on = F.coalesce(F.col("clipping") & (c["x_max"] > c["x_min"]) & (c["y_max"] > c["y_min"]), F.lit(False))
    frame = view_boxes(docs, prims, states, images).join(states.drop("extent"), "doc_id", "left").withColumn("clip_attr", F.when(clip_on, f' clip-path="url(#{CLIP_ID})"').otherwise(""))
    lines = fragments(P.colors(prims, table).join(frame.select("doc_id", "y0", "y1", "clip_attr"), "doc_id"))
    text_rank = P.KINDS.index("text")
    part = lambda keep: F.transform(F.filter("all", keep), lambda f: f["fragment"])
    drawn = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "seq", "sub", "fragment"))).alias("all")).select("doc_id", part(lambda f: f["rank"] < text_rank).alias("shapes"), part(lambda f: f["rank"] >= text_rank).alias("texts"))
    whole = frame.join(images, "doc_id", "left").join(drawn, "doc_id", "left")
    none = F.array().cast("array<string>")
    box = [fixed3(F.col(k)) for k in ("x0", "y0", "width", "height")]
    head = F.array(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), F.concat_ws(" ", *box), F.lit('">')))
    paper = F.concat(F.lit("  <rect"), *_attr(x=box[0], y=box[1], width=box[2], height=box[3]), F.lit(' fill="#ffffff" stroke="none" />'))
    background = F.when(F.coalesce("transparent", F.lit(True)), none).otherwise(F.array(paper))
    group = F.array(F.concat(F.lit('  <g fill="none" stroke-linecap="round" stroke-linejoin="round"'), F.col("clip_attr"), F.lit(">")))
    all_lines = F.concat(head, background, _clip_lines(), _images(), group, F.coalesce("shapes", none), F.array(F.lit("  </g>")), F.coalesce("texts", none), F.array(F.lit("</svg>")))
    return whole.select("doc_id", bind(all_lines, lambda x: F.concat(F.array_join(x, "\n"), F.lit("\n"))).alias("svg"))
