"""SimHash near-duplicates with multi-index hashing.

A 64-bit fingerprint is split into two segments of 32 bits. Fingerprints that
differ in at most three bits differ in at most one bit of one of the segments,
so looking up the Hamming ball of radius 1 around each segment in the table of
that segment finds all links; what is found is verified over all 64 bits. Two
values that differ in one bit have different parities, hence only even ones look
around themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import stash
from glyphlake.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints of one table entry that are paired by a join; larger entries are solved in blocks.
SMALL = 32
BLOCK = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    n = len(words) - shingle + 1
    if n < 2:
        return digest(b" ".join(words))
    hashes = np.fromiter(map(digest, map(b" ".join, zip(*(words[i:] for i in range(shingle))))), np.uint64, n)  # noqa: B905
    votes = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        votes += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long), one row per row of docs."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(digest, "doc_id long, fp long")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``), enough to connect what is connected.

    All pairs within a table entry of up to ``SMALL`` fingerprints are verified by
    a join. Larger entries are dealt into blocks of ``BLOCK`` on average; each pair
    of blocks is compared in one group, which returns a spanning forest of its
    links and thus no more rows than it has fingerprints.
    """
    segments = F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("val")), F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("val")))
    home = fps.select("fp", F.explode(segments).alias("s")).select("s.seg", "s.val", "fp")
    entries = home.groupBy("seg", "val").agg(F.count("*").alias("own"))
    ball = F.array(*[F.col("val").bitwiseXOR(F.lit(1 << i)) for i in range(32)])
    around = home.where(F.bit_count("val") % 2 == 0).select("seg", F.explode(ball).alias("val"), "fp")
    guests = around.join(entries, ["seg", "val"], "left_semi")
    met = stash(home.withColumn("own", F.lit(True)).unionByName(guests.withColumn("own", F.lit(False))), "simhash-met")
    busy = stash(met.groupBy("seg", "val").agg(F.count("*").alias("n")).where("n > 1"), "simhash-busy")
    sized = met.join(busy, ["seg", "val"])
    small = sized.where(F.col("n") <= SMALL)
    a = small.where("own").select("seg", "val", F.col("fp").alias("a"))
    b = small.select("seg", "val", F.col("fp").alias("b"), "own")
    paired = a.join(b, ["seg", "val"]).where(_near(F.col("a"), F.col("b")) & ((F.col("a") < F.col("b")) | (~F.col("own") & (F.col("a") != F.col("b"))))).select("a", "b")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = sized.where(F.col("n") > SMALL).select("seg", "val", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own_block"))
    tasks = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("seg", "val", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"), "fp")
    forest = tasks.groupBy("seg", "val", "i", "j").applyInPandas(_forest, "a long, b long")
    return paired.unionByName(forest)


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links of a group: each fingerprint reached is compared with those not yet reached."""
    left = np.unique(group["fp"].to_numpy())
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= DISTANCE
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
    return pd.DataFrame({"a": np.concatenate(a) if a else np.array([], np.int64), "b": np.concatenate(b) if b else np.array([], np.int64)})


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of docs.

    ``fingerprint``: 16 hex digits. ``component_id``: the smallest id among the
    documents that links of at most three differing bits reach, itself included.

    Null, empty and blank texts have fingerprint 0 and are linked like any other.
    Copies share a fingerprint and are one node of the links. Rows with a null id
    carry their fingerprint's component and are no part of it, so a component of
    such rows alone is null. Rows that share an id are one document, whose texts'
    links all count. An empty table gives no rows; other columns are ignored.
    """
    fps = stash(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "simhash-docs")
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "simhash-nodes")
    found = links(nodes.where("rep is not null").select("fp"))
    rep = lambda side: nodes.select(F.col("fp").alias(side), F.col("rep").alias(f"{side}_rep"))
    by_text = found.join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    # an id with several texts ties their fingerprints together
    several = fps.where("doc_id is not null").join(nodes, "fp").where("doc_id <> rep").select("doc_id", "rep").distinct()
    ids = nodes.where("rep is not null").select(F.col("rep").alias("doc_id")).unionByName(several.select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    by_id = several.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(by_text.unionByName(by_id))
    label = nodes.join(joined, nodes["rep"] == joined["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
