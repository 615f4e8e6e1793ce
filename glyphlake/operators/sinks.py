"""Files written for each document, by the executors."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stem(doc_id: str) -> str:
    return posixpath.splitext(posixpath.basename(doc_id.rstrip("/")))[0] or "image"


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``name, content`` into a folder that all executors see; returns ``path``.

    A file is written under another name and moved when it is whole, so a task
    that runs twice leaves one file. Two rows of one name are an error: neither
    may replace the other. The rows are written when the result is read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(content)
                files.move(part, f"{base}/{name}")
                paths.append(f"{folder.rstrip('/')}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    counted = rows.select("name", F.col("content").cast("binary").alias("content"), F.count("*").over(Window.partitionBy("name")).alias("n"))
    clash = F.raise_error(F.concat(F.lit("several documents would be written as "), F.col("name")))
    return counted.select("name", F.when(F.col("n") > 1, clash.cast("binary")).otherwise(F.col("content")).alias("content")).mapInArrow(write, "path string")


def read_files(paths: DataFrame) -> DataFrame:
    """``path, content`` of the files at ``path``, each read whole by the task that holds its row.

    For many small files: the driver lists none of them, and a task reads more
    than the few that Spark's file sources put into one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.binary()), strict=True)], names=["path", "content"])
        known: dict[str, tuple[fs.FileSystem, str]] = {}
        for batch in batches:
            out: list[tuple[str, bytes]] = []
            size = 0
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                if folder not in known:
                    known[folder] = _filesystem(folder)
                files, base = known[folder]
                with files.open_input_stream(f"{base}/{name}") as data:
                    out.append((path, data.read()))
                size += len(out[-1][1])
                if size > 8 << 20:
                    yield pack(out)
                    out, size = [], 0
            if out:
                yield pack(out)

    return paths.select("path").mapInArrow(read, "path string, content binary")


def _stem(doc_id: str = "doc_id"):  # noqa: ANN202
    name = F.regexp_replace(F.substring_index(F.rtrim(F.col(doc_id)), "/", -1), "(?<=.)\\.[^.]*$", "")
    return F.when(name == "", "image").otherwise(name)


def raw_files(images: DataFrame) -> DataFrame:
    """``name, content`` of payloads: ``<stem>_0000.bin`` and so on."""
    return images.select(F.concat(_stem(), F.lit("_"), F.lpad(F.col("index").cast("string"), 4, "0"), F.lit(".bin")).alias("name"), F.col("payload").alias("content"))


def svg_files(svgs: DataFrame) -> DataFrame:
    return svgs.select(F.concat(_stem(), F.lit("_0000.svg")).alias("name"), F.col("svg").alias("content"))


def json_files(texts: DataFrame) -> DataFrame:
    return texts.select(F.concat(_stem(), F.lit("_0000.json")).alias("name"), F.concat("json", F.lit("\n")).alias("content"))


def hotspot_files(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """``<stem>_0000.hotspots.json`` of every document: a list, empty where there is none."""
    fields = [c for c in spots.columns if c != "doc_id"]
    listed = spots.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields))), {"ignoreNullFields": "false"}).alias("list"))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id")).join(listed, "doc_id", "left")
    return _indented(rows.select(F.concat(_stem(), F.lit("_0000.hotspots.json")).alias("name"), F.coalesce("list", F.lit("[]")).alias("json")))


def report_files(docs: DataFrame, arrays: DataFrame, images: DataFrame) -> DataFrame:
    """``<stem>_decode_report.json``: the tile arrays of each document and how many raw images it has."""
    fields = ["array_index", "cols", "rows", "tile_width", "tile_height", "total_width", "total_height"]
    entry = F.struct(*fields, F.size("tiles").alias("tile_count"))
    of_arrays = arrays.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("arrays"))
    of_images = images.groupBy("doc_id").agg(F.count("*").alias("raw_image_count"))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id")).join(of_arrays, "doc_id", "left").join(of_images, "doc_id", "left")
    none = F.from_json(F.lit("[]"), dict(of_arrays.dtypes)["arrays"])
    report = F.struct(F.col("doc_id").alias("source"), F.coalesce("arrays", none).alias("arrays"), F.coalesce("raw_image_count", F.lit(0)).alias("raw_image_count"))
    return _indented(rows.select(F.concat(_stem(), F.lit("_decode_report.json")).alias("name"), F.to_json(report).alias("json")))


def _indented(rows: DataFrame) -> DataFrame:
    """JSON texts with an indent of two and a newline at the end."""

    def indent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [json.dumps(json.loads(x), indent=2) + "\n" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["name", "content"])

    return rows.mapInArrow(indent, "name string, content string")
