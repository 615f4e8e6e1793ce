"""WARC archives compressed with a Zstandard dictionary.

A dictionary is built from a bounded sample of the records. Each archive begins
with a skippable frame that holds it; then each record is a frame of its own, so
any record can be read alone with the dictionary. Records whose payload another
record has are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import fs_path, stash, work_dir

# Magic number of the skippable frame that holds a dictionary, and the format's version.
SKIPPABLE = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records that the dictionary is built from (none longer than SAMPLE_RECORD_BYTES, all up to SAMPLE_BYTES), and its size.
SAMPLE_RECORDS = 1000
SAMPLE_RECORD_BYTES = 1 << 20
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """Of the copy of that number among the rows of one page, address and payload: no two records share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{copy}:{digest}:{url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, original: tuple[int, str | None] | None = None, copy: int = 1) -> bytes:
    """One record as bytes. With an ``original`` (page and address of the response) it is a revisit: no body, but the length and digest of its payload."""
    digest, body = payload_digest(payload), b"" if original else payload
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest, copy)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    if original:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(*original, digest, 1)}", f"X-Refers-To-Page-ID: {original[0]}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, body) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    if version != VERSION or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:n]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, of which one is held at a time."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dictionary = stream.read(n)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        frame = decompressor.decompressobj()
        out = []
        while not frame.eof:
            block = rest or stream.read(1 << 20)
            if not block:
                if out or rest:
                    raise ValueError("truncated archive")
                return
            out.append(frame.decompress(block))
            rest = frame.unused_data if frame.eof else b""
        yield parse(b"".join(out))


def build_dictionary(pages: DataFrame, page_id: str, url: str, html: str) -> bytes:
    """A dictionary from up to SAMPLE_RECORDS records with the smallest hashes; empty if they are too few.

    Of rows that share page and address one is taken. The records are gathered in
    one executor, which stops at SAMPLE_BYTES.
    """
    rows = pages.select(F.xxhash64(F.col(page_id), F.col(url)).alias("h"), F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("binary").alias("html"))
    chosen = rows.select("h").distinct().orderBy("h").limit(SAMPLE_RECORDS)
    few = rows.where(F.coalesce(F.octet_length("html"), F.lit(0)) <= SAMPLE_RECORD_BYTES).join(F.broadcast(chosen), "h", "left_semi")
    sample = few.groupBy("h").agg(F.min(F.struct("page_id", "url", "html")).alias("r")).select("h", "r.*")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            for i, u, payload in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if size < SAMPLE_BYTES:
                    records.append(record(i, u, payload or b""))
                    size += len(records[-1])
        try:
            data = zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes() if len(records) >= 8 else b""
        except zstandard.ZstdError:  # too little to learn from
            data = b""
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["dictionary"])

    found = sample.repartition(1).sortWithinPartitions("h").mapInArrow(train, "dictionary binary").first()
    return bytes(found[0]) if found else b""


def write_archives(pages: DataFrame, path: str | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages; returns ``file, records, bytes`` of the archives written.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes that with the
    largest page_id is the response and the others revisit it; smaller ones are
    all responses. A null payload is empty. Rows that share the largest id of a payload are all
    responses; so are all pages of a payload whose ids are all null, and pages
    with a null id otherwise revisit. An empty table writes no archive. Other columns
    are ignored.

    Digests are grouped first, without payloads; payloads are then shuffled once, by
    digest, page and address, to meet the response of their digest. Pages that
    share a payload are thus spread over tasks; only rows that are alike in all
    three columns meet, and get a number. Each task writes one archive under a name of its own and the table of
    archives names those of tasks that ended, so a task may be run again.
    """
    spark = pages.sparkSession
    path = path or f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    dictionary = spark.sparkContext.broadcast(build_dictionary(pages, page_id, url, html))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("row_key", F.xxhash64("page_id", "url"))
    slim = rows.groupBy("digest", "row_key").agg(F.max("page_id").alias("page"), F.max(F.struct("page_id", "url")).alias("as_response"))
    # null ids: below all others, so that a page with an id is preferred
    best = slim.groupBy("digest").agg(F.max("page").alias("best"), F.max("as_response").alias("original"))
    known = slim.select("digest", "row_key").join(best, "digest")
    revisit = (F.octet_length("payload") >= min_revisit_bytes) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    alike = Window.partitionBy("digest", "row_key").orderBy(F.lit(0))
    met = rows.join(known, ["digest", "row_key"]).withColumn("copy", F.row_number().over(alike))
    marked = met.select("page_id", "url", "payload", F.when(revisit, F.col("original")["page_id"]).alias("refers_to"), F.when(revisit, F.col("original")["url"]).alias("refers_url"), "copy")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = fs_path(path)
        data = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        name, stream, n, size = f"{uuid.uuid4().hex}.warc.zst", None, 0, 0
        for batch in batches:
            for i, u, payload, target, target_url, copy in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if stream is None:
                    fs.create_dir(folder, recursive=True)
                    stream = fs.open_output_stream(f"{folder}/{name}")
                    size += stream.write(dictionary_frame(dictionary.value)) or 0
                stream.write(frame := compressor.compress(record(i, u, payload, None if target is None else (target, target_url), copy)))
                n, size = n + 1, size + len(frame)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return stash(marked.mapInArrow(write, "file string, records long, bytes long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, body, record_id, refers_to_record`` of the records of archives (column ``file``).

    One row per record, and per row of ``files``; the body of a revisit is empty.
    Bodies are checked against their lengths and digests. No files give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body", "record_id", "refers_to_record"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, at = fs_path(file)
                rows, size = [], 0
                with fs.open_input_stream(at) as stream:
                    for headers, body in read_archive(stream):
                        digest, n = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
                        kind = headers["warc-type"]
                        if kind == "response" and (len(body) != n or payload_digest(body) != digest):
                            raise ValueError(f"a record of {file} is damaged")
                        target = headers.get("x-refers-to-page-id", "")
                        rows.append((int(headers["x-page-id"]) if headers["x-page-id"] else None, headers["warc-target-uri"], n, digest, kind, int(target) if target else None, body, headers["warc-record-id"], headers.get("warc-refers-to")))
                        size += len(body)
                        if size > 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary, record_id string, refers_to_record string"
    return files.select("file").repartition(max(1, min(files.count(), 10_000))).mapInArrow(read, schema)
