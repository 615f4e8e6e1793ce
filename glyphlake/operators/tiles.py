"""Tile arrays of clear-text and binary metafiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import decoders as D
from glyphlake.functions import text as T
from glyphlake.functions.bytes import latin
from glyphlake.sources import cleartext as C

HEADER = ("cols", "rows", "tile_width", "tile_height", "total_width", "total_height", "cell_path")
TILE = ("payload", "compression", "bit_order", "orientation", "family", "local_color_precision", "cell_representation_mode", "row_padding")


def _so_far() -> Window:
    return Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _numbered(rows: DataFrame) -> DataFrame:
    """Tiles with ``array_index`` over the arrays that hold some, and ``tile_index`` in their array."""
    arrays = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("opened")) - 1
    tiles = F.row_number().over(Window.partitionBy("doc_id", "opened").orderBy("seq")) - 1
    return rows.withColumn("array_index", arrays).withColumn("tile_index", tiles).select("doc_id", "array_index", "tile_index", *HEADER, *TILE)


def text_tiles(files: DataFrame) -> DataFrame:
    """Tiles of clear text in files (``doc_id, content``) of any kind, with their array's header.

    Statements are split without setting stray quotes right first, as binary
    files are read the same way.
    """
    named = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    said = T.statements(named, "doc_id", latin(F.col("content")), offsets=False)
    command = F.upper(F.get(T.words(F.col("statement")), F.lit(0)))
    rows = said.withColumn("command", command).where(F.col("command").isin("BEGTILEARRAY", "ENDTILEARRAY", *C.TILES)).withColumn("numbers", T.numbers(F.col("statement")))
    n = F.size("numbers")
    at = lambda i: F.bround(F.get("numbers", F.lit(i) if isinstance(i, int) else i)).cast("int")
    places = {"cols": 4, "rows": 5, "tile_width": 6, "tile_height": 7, "total_width": n - 2, "total_height": n - 1}
    header = F.struct(*[F.when(n >= 14, F.greatest(F.lit(1), at(i))).otherwise(1).alias(k) for k, i in places.items()], F.when(n >= 14, at(3)).otherwise(0).cast("long").alias("cell_path"))
    opened = F.when(F.col("command") == "BEGTILEARRAY", F.struct(F.col("seq").alias("opened"), header.alias("header"))).when(F.col("command") == "ENDTILEARRAY", F.struct(F.lit(None).cast("long").alias("opened"), F.lit(None).cast("struct<cols:int,rows:int,tile_width:int,tile_height:int,total_width:int,total_height:int,cell_path:bigint>").alias("header")))
    head = F.col("head")
    meta = lambda i: F.bround(F.get(head, F.lit(i))).cast("int")
    bitonal = F.col("command").isin(*C.BITONAL_TILES)
    tiles = rows.withColumn("array", F.last(opened, ignorenulls=True).over(_so_far())).where(F.col("command").isin(*C.TILES) & F.col("array.opened").isNotNull())
    tiles = tiles.withColumn("hex", T.hex_payload(F.col("statement"))).where("hex <> ''").withColumn("head", T.numbers(T.before_payload(F.col("statement"))))
    columns = {
        "payload": F.unhex("hex"),
        "compression": meta(0),
        "bit_order": meta(2),
        "orientation": meta(3),
        "family": F.when(F.col("command").isin(*C.INDEX_TILES), "indexed"),
        "local_color_precision": F.when(~bitonal, meta(1)),
        "cell_representation_mode": meta(4),
        "row_padding": F.when(bitonal, meta(1)),
    }
    return _numbered(tiles.select("doc_id", "seq", F.col("array.opened").alias("opened"), "array.header.*", *[v.alias(k) for k, v in columns.items()]))


def binary_scopes(elements: DataFrame) -> DataFrame:
    """Elements with ``array``: when the tile array around them was opened, and its header; null outside and after a damaged header."""
    p, c, e = F.col("parameters"), F.col("class_id"), F.col("element_id")
    header = D.tile_array_header(p)
    none = F.lit(None).cast("struct<cols:int,rows:int,tile_width:int,tile_height:int,total_width:int,total_height:int,cell_path:bigint>")
    closed = F.struct(F.lit(None).cast("long").alias("opened"), none.alias("header"))
    opened = F.when((c == 0) & (e == 19), F.when(header.isNotNull(), F.struct(F.col("seq").alias("opened"), header.alias("header"))).otherwise(closed)).when((c == 0) & (e == 20), closed)
    kept = elements.where(((c == 0) & e.isin(19, 20)) | ((c == 4) & e.isin(28, 29)))
    return kept.withColumn("array", F.last(opened, ignorenulls=True).over(_so_far()))


def binary_tiles(elements: DataFrame) -> DataFrame:
    """Tiles of binary tile arrays, with their array's header."""
    inside = binary_scopes(elements).where("class_id = 4 and element_id = 28 and array.opened is not null").withColumn("t", D.raster_prefix(F.col("parameters"))).where("t is not null")
    none = F.lit(None)
    return _numbered(inside.select("doc_id", "seq", F.col("array.opened").alias("opened"), "array.header.*", "t.payload", "t.compression", "t.bit_order", "t.orientation", none.cast("string").alias("family"), none.cast("int").alias("local_color_precision"), none.cast("int").alias("cell_representation_mode"), "t.row_padding"))


def tiles(files: DataFrame, elements: DataFrame) -> DataFrame:
    """Tiles of all files: those written as clear text, or else, where a file has none of these, the binary ones."""
    text = text_tiles(files)
    return text.unionByName(binary_tiles(elements).join(text.select("doc_id").distinct(), "doc_id", "left_anti"))


def tile_arrays(tiles_: DataFrame) -> DataFrame:
    """``doc_id, array_index``, the header and ``tiles`` in their order."""
    entry = F.struct("tile_index", F.struct(*TILE).alias("tile"))
    return tiles_.groupBy("doc_id", "array_index", *HEADER).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["tile"]).alias("tiles"))


def placed(tiles_: DataFrame) -> DataFrame:
    """Tiles of the grid with their place: ``x, y, paste_w, paste_h``; those outside of the canvas or beyond the grid are left out."""
    row, col = F.floor(F.col("tile_index") / F.col("cols")), F.col("tile_index") % F.col("cols")
    at = tiles_.where("tile_index < rows * cols").withColumns({"x": (col * F.col("tile_width")).cast("int"), "y": (row * F.col("tile_height")).cast("int")}).where("x < total_width and y < total_height")
    fit: dict[str, Column] = {"paste_w": F.least("tile_width", F.col("total_width") - F.col("x")), "paste_h": F.least("tile_height", F.col("total_height") - F.col("y"))}
    return at.withColumns(fit)
