"""Raster images of metafiles, decoded in Arrow batches.

Images of one precedence are decoded only for documents that no higher one
serves; each row that reaches a decoder is one image, so a drawing's tiles are
decoded in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import decoders as D
from glyphlake.functions import images as I  # noqa: E741
from glyphlake.operators import state, tiles
from glyphlake.operators.images import raw_images
from glyphlake.sources.work import materialize

MAX_PIXELS = 12_000_000
MAX_SET_PIXELS = 40_000_000
#: Colours of documents that set none.
DEFAULT_PALETTE = bytes(v for i in range(256) for v in D.DEFAULT_COLORS.get(i, (i, i, i)))
OVERLAYS = "array<struct<href:string,x:double,y:double,w:double,h:double>>"


def _decode(rows: DataFrame, render: Callable[[dict], I.Image | None], keep: tuple[str, ...], need: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` with ``href, image_w, image_h``; null where nothing can be decoded."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keep), "href string", "image_w int", "image_h int"])
    columns = list(dict.fromkeys([*keep, *need]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            href, width, height = [], [], []
            for row in batch.to_pylist():
                image = render(row)
                href.append(None if image is None else I.data_uri(image))
                width.append(None if image is None else image.size[0])
                height.append(None if image is None else image.size[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(k)) for k in keep), pa.array(href, pa.string()), pa.array(width, pa.int32()), pa.array(height, pa.int32())], names=[*keep, "href", "image_w", "image_h"])

    # images are few and costly: deal them evenly before they are decoded
    return rows.select(*columns).repartition(F.xxhash64(*keep)).mapInArrow(run, schema)


def _with_colors(rows: DataFrame, elements: DataFrame) -> DataFrame:
    joined = rows.join(state.palette_bytes(elements), "doc_id", "left").join(state.color_value_extent(elements), "doc_id", "left")
    return joined.withColumn("palette", F.coalesce("palette", F.lit(DEFAULT_PALETTE)))


def _tile(r: dict) -> I.Image | None:
    image = I.tile_image(r["payload"], r["tile_width"], r["tile_height"], r["compression"], r["bit_order"], r["row_padding"], r["family"], r["local_color_precision"], r["cell_representation_mode"], r["palette"], r["color_extent"])
    return image if image is None else image.crop(r["paste_w"], r["paste_h"])


def _gathered(rows: DataFrame, order: str, *sizes: str) -> DataFrame:
    entry = F.struct(order, F.struct("href", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]).alias("o"))
    return rows.groupBy("doc_id", *sizes).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["o"]).cast(OVERLAYS).alias("overlays"))


def tile_overlays(tiles_: DataFrame, elements: DataFrame) -> DataFrame:
    """``doc_id, total_width, total_height, overlays`` of each document's first tile array of which a tile can be decoded."""
    rows = _with_colors(tiles.placed(tiles_), elements)
    keep = ("doc_id", "array_index", "tile_index", "x", "y", "paste_w", "paste_h", "total_width", "total_height")
    decoded = _decode(rows, _tile, keep, ("tile_width", "tile_height", "palette", "color_extent", *tiles.TILE)).where("href is not null")
    first = decoded.withColumn("first", F.min("array_index").over(Window.partitionBy("doc_id"))).where("array_index = first")
    return _gathered(first.withColumnsRenamed({"paste_w": "w", "paste_h": "h"}), "tile_index", "total_width", "total_height")


def raster_payloads(elements: DataFrame) -> DataFrame:
    """Payloads of 4/29 elements that are no text: ``doc_id, payload_index, compression, row_padding, bit_order, orientation, payload, width_hint, height_hint, size``.

    Hints are the tile size of an array of one tile around them; ``size`` is the
    document's extent in pixels.
    """
    rows = tiles.binary_scopes(elements).where("class_id = 4 and element_id = 29").where(D.restricted_text(F.col("parameters")).isNull())
    single = (F.col("array.header.cols") == 1) & (F.col("array.header.rows") == 1)
    found = rows.withColumn("t", D.raster_prefix(F.col("parameters"))).where("t is not null")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    hinted = found.select("doc_id", index.alias("payload_index"), "t.*", F.when(single, F.col("array.header.tile_width")).alias("width_hint"), F.when(single, F.col("array.header.tile_height")).alias("height_hint"))
    sizes = state.drawing_state(elements).select("doc_id", D.pixel_size(F.col("extent")).alias("size"))
    return hinted.join(sizes, "doc_id", "left")


def _raster(r: dict) -> I.Image | None:
    return I.raster_image(r["payload"], r["w"], r["h"], r["compression"], r["row_padding"], r["bit_order"], r["orientation"])


_RASTER_NEED = ("payload", "compression", "row_padding", "bit_order", "orientation")


def raster_overlays(payloads: DataFrame) -> DataFrame:
    """``doc_id, total_width, total_height, overlays`` of documents with several payloads, all of which can be decoded.

    They are laid out in a grid of the extent. Sets of more than MAX_SET_PIXELS pixels are left out.
    """
    doc = Window.partitionBy("doc_id")
    rows = payloads.where("size is not null").withColumn("n", F.count("*").over(doc)).where("n > 1")
    rows = rows.withColumn("grid", D.tile_grid(F.col("n"), F.col("size.width"), F.col("size.height")))
    cell = {"cell_w": F.greatest(F.lit(1), F.floor(F.col("size.width") / F.col("grid.cols"))), "cell_h": F.greatest(F.lit(1), F.floor(F.col("size.height") / F.col("grid.rows")))}
    rows = rows.withColumns(cell).withColumn("d", D.capped_size(F.coalesce("width_hint", "cell_w").cast("long"), F.coalesce("height_hint", "cell_h").cast("long"), MAX_PIXELS))
    rows = rows.withColumn("pixels", F.sum(F.col("d.width") * F.col("d.height")).over(doc)).where(F.col("pixels") <= MAX_SET_PIXELS)
    placed = rows.select("doc_id", "payload_index", "n", (F.col("payload_index") % F.col("grid.cols") * F.col("cell_w")).alias("x"), (F.floor(F.col("payload_index") / F.col("grid.cols")) * F.col("cell_h")).alias("y"), "cell_w", "cell_h", F.col("size.width").alias("total_width"), F.col("size.height").alias("total_height"), F.col("d.width").alias("w"), F.col("d.height").alias("h"), *_RASTER_NEED)
    decoded = _decode(placed, _raster, ("doc_id", "payload_index", "n", "x", "y", "cell_w", "cell_h", "total_width", "total_height"), ("w", "h", *_RASTER_NEED))
    whole = decoded.where("href is not null").withColumn("found", F.count("*").over(doc)).where("found = n")
    return _gathered(whole.withColumnsRenamed({"cell_w": "w", "cell_h": "h"}), "payload_index", "total_width", "total_height")


def backgrounds(payloads: DataFrame, raws: DataFrame, elements: DataFrame) -> DataFrame:
    """``doc_id, href, image_w, image_h``: the first payload that can be decoded, or else the first raw image."""
    d = D.capped_size(F.coalesce(F.col("width_hint").cast("long"), "size.width"), F.coalesce(F.col("height_hint").cast("long"), "size.height"), MAX_PIXELS)
    asked = payloads.where("size is not null").withColumn("d", d).select("doc_id", "payload_index", F.col("d.width").alias("w"), F.col("d.height").alias("h"), *_RASTER_NEED)
    first = F.min_by(F.struct("href", "image_w", "image_h"), "at").alias("i")
    by_payload = _decode(asked, _raster, ("doc_id", "payload_index"), ("w", "h", *_RASTER_NEED)).where("href is not null").withColumnRenamed("payload_index", "at").groupBy("doc_id").agg(first)
    left = raws.join(by_payload.select("doc_id"), "doc_id", "left_anti")
    cells = _decode(_with_colors(left, elements), _cell, ("doc_id", "index"), ("payload", "width", "height", "local_color_precision", "cell_representation_mode", "palette", "color_extent"))
    by_cell = cells.where("href is not null").withColumnRenamed("index", "at").groupBy("doc_id").agg(first)
    return by_payload.unionByName(by_cell).select("doc_id", "i.*")


def _cell(r: dict) -> I.Image | None:
    return I.cell_image(r["payload"], r["width"], r["height"], r["local_color_precision"], r["cell_representation_mode"], r["palette"], r["color_extent"])


def rasters(files: DataFrame, elements: DataFrame) -> DataFrame:
    """``doc_id, total_width, total_height, overlays, href``: of each document with a raster, either overlays or one background."""
    first = materialize(tile_overlays(materialize(tiles.tiles(files, elements), "tiles"), elements), "tile-overlays")
    payloads = materialize(raster_payloads(elements).join(first.select("doc_id"), "doc_id", "left_anti"), "payloads")
    second = materialize(raster_overlays(payloads), "raster-overlays")
    done = first.select("doc_id").unionByName(second.select("doc_id"))
    third = backgrounds(payloads.join(second.select("doc_id"), "doc_id", "left_anti"), raw_images(elements).join(done, "doc_id", "left_anti"), elements)
    overlays = first.unionByName(second).select("doc_id", F.col("total_width").cast("long").alias("total_width"), F.col("total_height").cast("long").alias("total_height"), "overlays", F.lit(None).cast("string").alias("href"))
    return overlays.unionByName(third.select("doc_id", F.col("image_w").cast("long").alias("total_width"), F.col("image_h").cast("long").alias("total_height"), F.lit(None).cast(OVERLAYS).alias("overlays"), "href"))
