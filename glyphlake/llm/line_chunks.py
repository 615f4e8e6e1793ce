"""Line dedup: repeated passages, or content-defined chunks of lines.

``dedup_passages`` removes every passage of two or more lines, and every long
line, that an earlier place holds: each line that is not blank is looked up
together with the next such line, so a passage is found wherever it begins.

``dedup_lines`` looks up chunks only, and finds less. The lines of a text are
hashed; where a rolling hash over the last line hashes meets a condition, a chunk
ends. Boundaries thus follow the content, and lines added or removed before a
repeated passage leave its chunks as they are; but a passage loses only the
chunks that lie in it whole.

Both remove what occurs elsewhere, all but the first occurrence, after the bytes
have been compared by grouping on the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import stash

#: Lines that the rolling hash sees; a chunk ends after a line on average each
#: DIVISOR lines, and after MAX_LINES at the latest.
ROLL = 1
DIVISOR = 3
MAX_LINES = 64
#: Words from which a single line counts as a passage.
LONG_WORDS = 50
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def cut(lines: list[bytes], roll: int = ROLL, divisor: int = DIVISOR, max_lines: int = MAX_LINES) -> list[tuple[int, int]]:
    """Chunks as half-open ranges of lines, which cover all lines in order."""
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    out, begin, rolling, oldest = [], 0, 0, pow(_BASE, roll, 1 << 64)
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h - (hashes[i - roll] * oldest if i >= roll else 0)) & _MASK
        if (rolling >> 32) % divisor == 0 or i + 1 - begin >= max_lines:
            out.append((begin, i + 1))
            begin = i + 1
    if begin < len(lines):
        out.append((begin, len(lines)))
    return out


def _offsets(text: bytes, **cutting: int) -> Iterator[tuple[int, int, int]]:
    """(first byte, end, lines) of the chunks of several lines that hold more than white space."""
    lines = text.split(b"\n")
    at, ends = 0, []
    for x in lines:
        at += len(x) + 1
        ends.append(at)
    for a, b in cut(lines, **cutting):
        first, end = ends[a - 1] if a else 0, min(ends[b - 1], len(text))
        if b - a > 1 and text[first:end].strip():
            yield first, end, b - a


def _chunks(cutting: dict, text: bytes) -> set[bytes]:
    return {text[a:b].removesuffix(b"\n") for a, b, _ in _offsets(text, **cutting)}


def _filled(text: bytes) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Where each line begins, one place more for the end, and (line, first byte, end) of the lines that are not blank."""
    starts, filled, at = [], [], 0
    for i, x in enumerate(text.split(b"\n")):
        starts.append(at)
        if x and not x.isspace():
            filled.append((i, at, at + len(x)))
        at += len(x) + 1
    return [*starts, len(text)], filled


def _looked_up(text: bytes, filled: list[tuple[int, int, int]], long_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first, last, bytes) of the stretches that are looked up, numbered by the lines that are not blank."""
    for k, (_, a, b) in enumerate(filled):
        if k:
            yield k - 1, k, text[filled[k - 1][1] : b]
        # a word takes two bytes with the space behind it
        if b - a >= 2 * long_words - 1 and len(text[a:b].split(None, long_words - 1)) >= long_words:
            yield k, k, text[a:b]


def _windows(long_words: int, text: bytes) -> set[bytes]:
    return {x for _, _, x in _looked_up(text, _filled(text)[1], long_words)}


def _key(chunk: bytes, bits: int) -> bytes:
    """Digest of a chunk, with or without the newline that ends it."""
    digest = xxhash.xxh3_128_digest(chunk.removesuffix(b"\n"))
    return digest if bits == 128 else (int.from_bytes(digest, "big") >> (128 - bits)).to_bytes(16, "big")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", roll: int = ROLL, divisor: int = DIVISOR, max_lines: int = MAX_LINES, digest_bits: int = 128) -> DataFrame:
    """Every document without the multi-line chunks that an earlier place holds.

    Returns ``doc_id, text, n_lines, removed_lines, removed_chunks``. The first
    place of a chunk is the document of the smallest id, and in it the first
    occurrence. Lines end with ``\\n``; what is kept keeps its order and bytes.
    Chunks of one line are never removed, nor chunks of white space alone.

    Null texts stay null, with 0 lines; an empty text has one empty line. Rows
    with a null id are returned as they are and take no part. Rows that share an
    id are one document to the choice of the first place: repeated rows keep or
    lose the same chunks. An empty table gives no rows; other columns are ignored.
    The digest only says where to look: chunks are grouped by their bytes, and a
    digest that different chunks share (none is expected at 128 bits) removes none.

    Three shuffles carry text: the documents that meet the digests they share with
    others, the chunks of those digests, combined on the map side, and the documents
    when they meet the digests they lose. A chunk that a large part of the documents
    share is one key of a join that Spark splits.
    """
    cutting = {"roll": roll, "divisor": divisor, "max_lines": max_lines}
    return _dedup(docs, partial(_chunks, cutting), partial(_without, cutting=cutting, bits=digest_bits), digest_bits, doc_id, text)


def dedup_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", long_words: int = LONG_WORDS, digest_bits: int = 128) -> DataFrame:
    """Every document without the passages that an earlier place holds.

    Returns ``doc_id, text, n_lines, removed_lines, removed_chunks``. Two lines that
    are not blank and have at most blank lines between them are looked up by their
    bytes; a line of ``long_words`` words or more is looked up by itself. What the
    document of the smallest id holds stays, and in it the first occurrence; other
    places lose the lines and the blank ones between them. A passage of any number
    of lines thus goes whole, and the first place of each line always stays. Single
    lines of fewer words stay. ``removed_chunks`` counts the stretches removed.

    Nulls, empty texts, repeated ids and digests count as in ``dedup_lines``, and
    the same shuffles carry text.
    """
    return _dedup(docs, partial(_windows, long_words), partial(_without_passages, long_words=long_words, bits=digest_bits), digest_bits, doc_id, text)


def _dedup(docs: DataFrame, units: Callable[[bytes], set[bytes]], without: Callable[[bytes, set[bytes]], tuple[bytes, int, int]], digest_bits: int, doc_id: str, text: str) -> DataFrame:
    """``units`` are the distinct stretches of a text that are looked up; ``without`` takes the text and the keys it loses."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    several = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, _ in _distinct(batch, units, digest_bits):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, chunks in _distinct(batch, units, digest_bits, asked=True):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(chunks, pa.binary())], names=["doc_id", "key", "chunk"])

    places = (F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    keys = several.mapInArrow(keys_only, "doc_id long, key binary")
    # the last document tells a chunk of several documents from that of one
    shared = stash(keys.groupBy("key").agg(*places).where("last_doc > first_doc").select("key"), "line-keys")
    # only the bytes of keys that several documents hold are sent
    held = stash(keys.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "line-chunks")
    by_bytes = several.join(held, "doc_id").mapInArrow(with_bytes, "doc_id long, key binary, chunk binary").groupBy("key", "chunk").agg(*places)
    repeated = stash(by_bytes.groupBy("key").agg(F.count("*").alias("chunks"), F.min("first_doc").alias("first_doc")).where("chunks = 1").select("key", "first_doc"), "line-repeated")
    lost = held.select("doc_id", F.explode("keys").alias("key")).join(repeated, "key").where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
    return rows.join(lost, "doc_id", "left").mapInArrow(_rebuilder(without), "doc_id long, text string, n_lines long, removed_lines long, removed_chunks long")


def _distinct(batch: pa.RecordBatch, units: Callable[[bytes], set[bytes]], bits: int, asked: bool = False, budget: int = 16 << 20):
    """The distinct units of each document, or of those only the ones of its third column's keys, in blocks of bounded size."""
    ids, keys, chunks, size = [], [], [], 0
    wanted = map(set, batch.column(2).to_pylist()) if asked else [None] * batch.num_rows
    for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), wanted, strict=True):
        for chunk in units(text):
            key = _key(chunk, bits)
            if own is None or key in own:
                ids.append(i)
                keys.append(key)
                chunks.append(chunk)
                size += len(chunk)
        if size > budget:
            yield ids, keys, chunks
            ids, keys, chunks, size = [], [], [], 0
    yield ids, keys, chunks


def _without(text: bytes, lost: set[bytes], cutting: dict, bits: int) -> tuple[bytes, int, int]:
    kept, at, seen, lines, chunks = [], 0, set(), 0, 0
    for a, b, n in _offsets(text, **cutting):
        chunk = text[a:b].removesuffix(b"\n")
        if chunk in seen or _key(chunk, bits) in lost:
            kept.append(text[at:a])
            at, lines, chunks = b, lines + n, chunks + 1
        seen.add(chunk)
    rest = b"".join([*kept, text[at:]])
    # a text that ended without a newline still does when its end was removed
    return (rest.removesuffix(b"\n") if chunks and at == len(text) and not text.endswith(b"\n") else rest), lines, chunks


def _without_passages(text: bytes, lost: set[bytes], long_words: int, bits: int) -> tuple[bytes, int, int]:
    starts, filled = _filled(text)
    first, gone = {}, set()
    for a, b, x in _looked_up(text, filled, long_words):
        # an occurrence that overlaps the first one is a part of it
        if first.setdefault(x, b) < a or (lost and _key(x, bits) in lost):
            gone.update(range(filled[a][0], filled[b][0] + 1))
    if not gone:
        return text, 0, 0
    n = len(starts) - 1
    rest = b"".join(text[starts[i] : starts[i + 1]] for i in range(n) if i not in gone)
    # a text that ended without a newline still does when its end was removed
    return (rest.removesuffix(b"\n") if n - 1 in gone else rest), len(gone), sum(i - 1 not in gone for i in gone)


def _rebuilder(without: Callable[[bytes, set[bytes]], tuple[bytes, int, int]]):
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, all_lost = (batch.column(i).to_pylist() for i in range(3))
            out, counts = [], []
            for i, text, lost in zip(ids, texts, all_lost, strict=True):
                rest, lines, chunks = (text, 0, 0) if text is None or i is None else without(text, set(lost or ()))
                out.append(rest)
                counts.append((0 if text is None else text.count(b"\n") + 1, lines, chunks))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))],
                names=["doc_id", "text", "n_lines", "removed_lines", "removed_chunks"],
            )

    return rebuild
