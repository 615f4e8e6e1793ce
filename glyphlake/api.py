"""What the library offers: from files to elements, images, hotspots, drawings and snapshots.

Inputs are DataFrames of ``doc_id, content``; all results are DataFrames, one
for all documents. ``elements`` can be computed once, cached and passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphlake.operators import diagnostics, sinks
from glyphlake.operators import hotspots as _hotspots
from glyphlake.operators import images as _images
from glyphlake.operators import snapshot as _snapshot
from glyphlake.operators import state as _state
from glyphlake.operators import svg as _svg
from glyphlake.operators import tiles as _tiles
from glyphlake.sources.files import elements, parse_errors, read_metafiles

__all__ = ["color_table", "color_value_extent", "data_json", "element29_analysis", "elements", "final_images_and_hotspots", "hotspots", "parse_errors", "raw_images", "read_metafiles", "tile_arrays", "vector_svg", "write_data_json", "write_hotspots", "write_raw_images", "write_rendered", "write_vector_svg"]


def _parsed(files: DataFrame, parsed: DataFrame | None) -> DataFrame:
    return elements(files) if parsed is None else parsed


def raw_images(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    return _images.raw_images(_parsed(files, parsed))


def hotspots(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    return _hotspots.hotspots(_parsed(files, parsed))


def vector_svg(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    return _svg.vector_svg(files, _parsed(files, parsed))


def data_json(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    return _snapshot.snapshot_json(files, _parsed(files, parsed))


def color_table(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    return _state.color_table(_parsed(files, parsed))


def color_value_extent(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    return _state.color_value_extent(_parsed(files, parsed))


def tile_arrays(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    return _tiles.tile_arrays(_tiles.tiles(files, _parsed(files, parsed)))


def element29_analysis(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    rows = _parsed(files, parsed).where("class_id = 4 and element_id = 29").selectExpr("doc_id", "seq", "parameters as payload")
    return diagnostics.analyze(rows, ["doc_id", "seq"])


def final_images_and_hotspots(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """``doc_id, image, hotspots`` (a list)."""
    from pyspark.sql import functions as F

    both = _parsed(files, parsed)
    spots = _hotspots.hotspots(both)
    listed = spots.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in spots.columns if c != "doc_id"]))).alias("hotspots"))
    return _svg.vector_svg(files, both).withColumnRenamed("svg", "image").join(listed, "doc_id", "left").withColumn("hotspots", F.coalesce("hotspots", F.from_json(F.lit("[]"), dict(listed.dtypes)["hotspots"])))


def write_raw_images(files: DataFrame, folder: str, parsed: DataFrame | None = None) -> DataFrame:
    return sinks.write_files(sinks.raw_files(raw_images(files, parsed)), folder)


def write_vector_svg(files: DataFrame, folder: str, parsed: DataFrame | None = None) -> DataFrame:
    return sinks.write_files(sinks.svg_files(vector_svg(files, parsed)), folder)


def write_rendered(files: DataFrame, folder: str, parsed: DataFrame | None = None, debug_report: bool = False) -> DataFrame:
    """Drawings and, if asked for, a report of each document's rasters."""
    both = _parsed(files, parsed)
    out = sinks.svg_files(vector_svg(files, both))
    if debug_report:
        out = out.unionByName(sinks.report_files(files, tile_arrays(files, both), raw_images(files, both)))
    return sinks.write_files(out, folder)


def write_hotspots(files: DataFrame, folder: str, parsed: DataFrame | None = None) -> DataFrame:
    return sinks.write_files(sinks.hotspot_files(files, hotspots(files, parsed)), folder)


def write_data_json(files: DataFrame, folder: str, parsed: DataFrame | None = None) -> DataFrame:
    return sinks.write_files(sinks.json_files(data_json(files, parsed)), folder)


def session(name: str = "glyphlake") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
