"""Language-model scoring from a log-frequency Bloom filter.

Counts of word pairs are quantised to levels: 1, 2, 3, 4, 6, 8, 12 and so on, two
for each power of two. A filter holds, for a pair of level q, the keys (pair, 1)
to (pair, q); probing them in turn until one is missing gives the level back,
never too low. The filter is dealt by the pairs' hashes into segments whose
number follows the size of the corpus, so it is too large to be broadcast:
the pairs that texts ask for travel to their segment, and levels travel back.

Probability of a word w after v: the count that the level of (v w) stands for,
which no pair of that level is below, over c(v), mixed with the base probability
(c(w) + 1) / (N + V + 1) by the weight c(v) / (c(v) + K). The counts that levels
stand for add up to c(v) at most over all w, so the probabilities of what may
follow v add up to 1 at most, up to the filter's false answers.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import Scratch, dealt, fs_path, stash

#: Probes of a key, and bits of the filter for each key: 0.24 % of absent keys read as present.
PROBES = 4
BITS_PER_KEY = 16
LEVELS = 96
#: Weight of the base probability, in pairs.
SMOOTHING = 5.0
#: Bytes of text for each bucket of hashes, and the fewest buckets.
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 16
#: Tokens of a block: documents that one task counts together, and scores together.
BLOCK_TOKENS = 3_000_000
#: The token that ends each document and stands before its first word.
END = np.uint64(0x6A09E667F3BCC909)

_digest = partial(xxhash.xxh64_intdigest, seed=1729)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, A-Z lower-cased, then the end token."""
    words = text.lower().split() if text else []
    out = np.fromiter(map(_digest, words), np.uint64, len(words))
    return np.append(out, END)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


def pairs(stream: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; END stands before the first."""
    before = np.append(END, stream[:-1])
    return _mix(before * _C2 + (stream ^ (stream >> np.uint64(32))) * _C1)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """From the upper half of the hash; filters use the lower."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def level(counts: np.ndarray) -> np.ndarray:
    """1 for 1, 2 for 2, 3 for 3, 4 for 4 and 5, 5 for 6 and 7, 6 for 8 to 11 and so on."""
    fraction, power = np.frexp(counts.astype(np.float64))
    return np.minimum(LEVELS, np.where(counts > 0, np.maximum(1, 2 * (power - 1) + (fraction >= 0.75)), 0))


#: What a level stands for: the smallest of its counts.
COUNT_OF_LEVEL = np.array([0.0, 1.0, *((1.5 if q % 2 else 1.0) * 2.0 ** (q // 2) for q in range(2, LEVELS + 1))])


def _places(hashes: np.ndarray, q: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """PROBES places of the key (hash, q) in filters of so many bits each."""
    step = _mix(hashes + np.uint64(q * int(_C1) & 0xFFFFFFFFFFFFFFFF))
    a, b = step & np.uint64(0xFFFFFFFF), (step >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((a + np.uint64(k) * b) & np.uint64(0xFFFFFFFF)) * bits >> np.uint64(32)


def build_segment(hashes: np.ndarray, counts: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> np.ndarray:
    """The filter of some pairs as bytes; its size follows the number of keys."""
    levels = level(counts)
    bits = np.uint64(max(64, int(levels.sum()) * bits_per_key + 63 & ~63))
    out = np.zeros(int(bits), bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for at in _places(hashes[levels >= q], q, bits):
            out[at] = True
    return np.packbits(out, bitorder="little")


class Filter:
    """Segments of the filter in one array."""

    def __init__(self, segments: dict[int, bytes], buckets: int) -> None:
        self.buckets = buckets
        self.starts, self.bits = np.zeros(buckets, np.uint64), np.zeros(buckets, np.uint64)
        at = 0
        for b in sorted(segments):
            self.starts[b], self.bits[b] = at * 8, len(segments[b]) * 8
            at += len(segments[b])
        self.data = np.frombuffer(b"".join(segments[b] for b in sorted(segments)), np.uint8)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each hash; 0 where the first key is missing."""
        out = np.zeros(len(hashes), np.int64)
        left = np.arange(len(hashes))
        for q in range(1, LEVELS + 1):
            bucket = _bucket(hashes[left], self.buckets).astype(np.int64)
            start, bits = self.starts[bucket], self.bits[bucket]
            there = np.ones(len(left), bool)
            for at in _places(hashes[left], q, bits):
                at = at + start
                there &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            left = left[there]
            if not len(left):
                break
            out[left] = q
        return out


# --- what travels: rows of a kind, a bucket and a block

TOKENS, PAIRS = 0, 1
_ASKED = "kind int, bucket int, block string, hashes binary, counts binary"
_ANSWERED = "kind int, bucket int, block string, answer binary, distinct long, total long"
#: Bytes of a pair's hash that are sent: what its bucket does not tell.
_PAIR_BYTES = 5


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _cut(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray((hashes >> np.uint64(1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PAIR_BYTES]).tobytes()


def _uncut(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _PAIR_BYTES, 8), np.uint8)
    out[:, :_PAIR_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _PAIR_BYTES)
    return out.view("<u8").ravel().astype(np.uint64)


def _distinct_pairs(stream: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct pairs, in order, with their counts where ``learn`` holds; the lowest bit is not used."""
    h = np.sort(pairs(stream) & ~np.uint64(1) | learn.astype(np.uint64))
    first = np.flatnonzero(np.append(True, h[1:] >> np.uint64(1) != h[:-1] >> np.uint64(1)))
    return h[first] & ~np.uint64(1), np.add.reduceat((h & np.uint64(1)).astype(np.int64), first)


def _by_bucket(kind: int, block: str, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a bucket; the hashes are in order, and so are their buckets."""
    bucket = _bucket(hashes, buckets).astype(np.int64)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = [*at[1:].tolist(), len(bucket)]
    pack = _cut if kind == PAIRS else np.ndarray.tobytes
    spans = list(zip(at.tolist(), ends, strict=True))
    cols = [pa.array([kind] * len(at), pa.int32()), pa.array(bucket[at], pa.int32()), pa.array([block] * len(at)), pa.array([pack(hashes[i:j]) for i, j in spans], pa.binary()), pa.array([_narrow(counts[i:j]) for i, j in spans], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "bucket", "block", "hashes", "counts"])


# --- blocks of documents, kept in the shared folder until they are scored


def _pack_block(ids: list, learn: np.ndarray, sizes: np.ndarray, places: np.ndarray, tokens_: np.ndarray) -> bytes:
    """Ids and sizes of documents, their tokens as places in a table of distinct tokens, commonest first."""
    buffer = io.BytesIO()
    none = np.array([i is None for i in ids], bool)
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    np.savez(buffer, ids=np.array([0 if i is None else i for i in ids], np.int64), none=none, learn=learn, sizes=sizes, planes=planes, tokens=tokens_)
    return zstandard.ZstdCompressor(level=1).compress(buffer.getvalue())


def _unpack_block(data: bytes):
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as x:
        places = np.ascontiguousarray(x["planes"].T).view("<u4").ravel()
        return x["ids"], x["none"], x["learn"], x["sizes"], places, x["tokens"]


def _keep_block(folder: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then move: a task that is run again writes the same file."""
    fs, path = fs_path(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{path}/{name}")


def _asker(folder: str, buckets: int, block_tokens: int):
    """Blocks of documents: each is kept in the folder, and asks for the counts of its distinct tokens and pairs."""

    def flush(name: str, ids: list, learn: list, streams: list) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in streams])
        stream = np.concatenate(streams)
        learnt = np.repeat(np.array(learn, bool), sizes)
        known, place, times = np.unique(stream, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        data = _pack_block(ids, np.array(learn, bool), sizes, rank[place], known[order])
        # what is read again after a loss is the same block only if it holds the same
        name = f"{name}-{xxhash.xxh3_128_hexdigest(data)}"
        _keep_block(folder, name, data)
        yield _by_bucket(TOKENS, name, known, np.bincount(place, learnt, len(known)).astype(np.int64), buckets)
        del place, rank, data
        yield _by_bucket(PAIRS, name, *_distinct_pairs(stream, learnt), buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size = TaskContext.get().partitionId(), 0, 0
        ids, learn, streams = [], [], []
        for batch in batches:
            for i, learns, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                learn.append(learns)
                streams.append(tokens(text))
                size += len(streams[-1])
                if size >= block_tokens:
                    yield from flush(f"{task}-{number}", ids, learn, streams)
                    number, size, ids, learn, streams = number + 1, 0, [], [], []
        if ids:
            yield from flush(f"{task}-{number}", ids, learn, streams)

    return ask


def _one_a_task(asked: DataFrame, buckets: int) -> DataFrame:
    """Each kind and bucket in a slot of its own; by hashes of them several would meet in one task and others in none."""
    usual = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = asked.withColumn("slot", F.col("kind") * buckets + F.col("bucket"))
    return slots.repartitionById(max(usual, 2 * buckets), "slot")


def _answerer(bits_per_key: int):
    def answer(group: pd.DataFrame) -> pd.DataFrame:
        """All that blocks ask of a bucket: exact counts of tokens, levels of pairs by the bucket's filter segment."""
        kind, bucket = int(group["kind"].iloc[0]), int(group["bucket"].iloc[0])
        parts = [_uncut(x) if kind == PAIRS else np.frombuffer(x, np.uint64) for x in group["hashes"]]
        h, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(inverse, np.concatenate([_wide(x) for x in group["counts"]]), len(h)).astype(np.int64)
        if kind == PAIRS:
            segment = build_segment(h[c > 0], c[c > 0], bits_per_key).tobytes()
            values = Filter({0: segment}, 1).levels(h)
        else:
            values = c
        ends = np.cumsum([len(x) for x in parts])[:-1]
        answers = [_narrow(x) for x in np.split(values[inverse], ends)]
        rows = pd.DataFrame({"kind": kind, "bucket": bucket, "block": group["block"].to_numpy(), "answer": answers, "distinct": 0, "total": 0})
        rows.loc[rows.index[0], ["distinct", "total"]] = (int((c > 0).sum()), int(c.sum()))
        return rows

    return answer


def _probability(levels: np.ndarray, context: np.ndarray, count: np.ndarray, n: int, v: int, smoothing: float) -> np.ndarray:
    """Of tokens that occur ``count`` times after tokens that occur ``context`` times; the base alone where nothing was learnt."""
    base = (count + 1.0) / (n + v + 1)
    met = np.maximum(1.0, context)
    trust = context / (context + smoothing) if smoothing else (context > 0).astype(float)
    return trust * np.minimum(COUNT_OF_LEVEL[levels], met) / met + (1 - trust) * base


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(folder: str, n: int, v: int, smoothing: float):
    def score_block(answers: pd.DataFrame) -> pd.DataFrame:
        fs, path = fs_path(folder)
        with fs.open_input_stream(f"{path}/{answers['block'].iloc[0]}") as f:
            ids, none, learn, sizes, places, known = _unpack_block(f.read())
        answers = answers.sort_values("bucket")
        got = [np.concatenate([_wide(x) for x in answers.loc[answers["kind"] == k, "answer"]]) for k in (TOKENS, PAIRS)]
        stream = known[places]
        distinct, place = np.unique(pairs(stream) & ~np.uint64(1), return_inverse=True)
        if len(got[0]) != len(known) or len(got[1]) != len(distinct):
            raise ValueError("the answers do not match the block: its documents were not read alike twice")
        counts = np.empty(len(known), np.int64)
        counts[np.argsort(known)] = got[0]
        count = counts[places].astype(np.float64)
        first = np.append(0, np.cumsum(sizes)[:-1])
        # the end of the document before stands in front of each document; that of the block has the same count
        context = np.append(count[sizes[0] - 1], count[:-1])
        value = np.log10(_probability(got[1][place], context, count, n, v, smoothing))
        add = lambda x: np.add.reduceat(x, first)
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": ~learn, "n_tokens": sizes, "n_known": add((count > 0).astype(np.int64)), "train_tokens": n, "base_score": add(np.log10(count + 1.0)) - sizes * np.log10(n + v + 1.0), "score": add(value)})
        out.loc[none, "doc_id"] = pd.NA
        return out

    return score_block


def score(docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", smoothing: float = SMOOTHING, bits_per_key: int = BITS_PER_KEY, buckets: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Score every document with a model of those where ``learn`` holds.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``,
    one row per row of docs; ``held_out`` is ``not learn``. Tokens are words with
    A-Z lower-cased, then one end token a document. ``base_score`` is exact: the sum
    of log10((c + 1) / (N + V + 1)) over the tokens. ``score`` is the model's log10
    probability of the text, with the exact counts of all words and the filter's
    counts of pairs. Words are told apart by 64-bit hashes.

    Null texts are empty: the end token alone. Rows with null ids and repeated
    rows are each scored, and learnt from as often as they occur; where ``learn``
    is null, a document is held out. Without anything to learn from, N and V are 0.
    An empty table gives no rows; other columns are ignored.

    Documents are read once for their size, once for their words. A task puts
    them in blocks of ``block_tokens`` tokens (or one longer text); a block asks for
    each of its distinct words and pairs once, so frequent ones leave it once.
    Buckets of hashes, one for ``BUCKET_BYTES`` of text, count what is learnt, build
    the segment of the filter and answer; a block's answers meet it again. Nothing
    is broadcast, and the driver gets two numbers. The result does not depend on
    ``buckets`` or ``block_tokens`` but for what the filter's false answers are.
    ``docs`` must give the same rows in the same order if a task is run again, as
    tables do; if not, the answers do not match and the job fails.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    with Scratch(spark) as scratch:
        folder = scratch.folder("lm-blocks")
        asked = rows.mapInArrow(_asker(folder, buckets, block_tokens), _ASKED)
        answered = scratch.stash(_one_a_task(asked, buckets).groupBy("slot").applyInPandas(_answerer(bits_per_key), _ANSWERED), "lm-answers")
        n, v = (int(x or 0) for x in answered.where(F.col("kind") == TOKENS).agg(F.sum("total"), F.sum("distinct")).first())
        blocks = dealt(answered.select("kind", "bucket", "block", "answer"), size // (4 * block_tokens), "block")
        scored = blocks.groupBy("block").applyInPandas(_scorer(folder, n, v, smoothing), _SCORED)
        return stash(scored, "lm-scores")
