"""Content-addressed store of token ids.

Token streams are cut where a rolling hash over the ids meets a condition. Each
distinct chunk is stored once under its digest; a document is a recipe, the list
of its chunks' digests; Merkle roots over chunks and recipes verify what is read.

Format, in one folder:
``parts/``    Parquet by kind; ``kind=chunk``: ``key`` (BLAKE2b digest, 16 bytes)
              and ``data`` (ids, little-endian unsigned integers of 2 bytes, 4 if
              the vocabulary needs them)
``recipes/``  Parquet in ascending doc_id order, over the files by name and within
              each: ``doc_id, start, n_tokens, digests``
``manifest/`` JSON: format version, bytes of an id, tokenizer digest, end id,
              documents, chunks, the Merkle roots of chunks and recipes

A Merkle tree has 4096 leaves: a leaf is the number of entries whose digest falls
in its bucket and the sum, modulo 2**256, of their BLAKE2b digests; inner nodes
hash their children. An entry is a chunk's digest, or a document with its id,
start, length and recipe. Readers compute both roots again and compare.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import Scratch, exists, move, work_dir

END_ID = 2
#: Digests that a task remembers of the chunks it has sent; older ones may be sent again.
REMEMBERED = 1 << 19
#: Leaves of a Merkle tree.
LEAVES = 4096
#: Ids that the rolling hash sees, the bits it must have zero at a boundary, and the bounds of a chunk.
ROLL = 16
CUT_BITS = 9
MIN_IDS, MAX_IDS = 64, 4096
VERSION = 1


@lru_cache(maxsize=1)
def _gear(size: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, size, dtype=np.uint64)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream; the last is its length."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n] if n else []
    rolled = _gear(1 << 16)[ids & 0xFFFF]
    width = 1
    while width < ROLL:  # each step doubles how many ids the hash at a place has seen
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint64(width))
        width *= 2
    out, begin = [], 0
    for i in (np.flatnonzero((rolled >> np.uint64(40)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1).tolist():
        while i - begin > MAX_IDS:
            begin += MAX_IDS
            out.append(begin)
        if i - begin >= MIN_IDS:
            out.append(i)
            begin = i
    while n - begin > MAX_IDS:
        begin += MAX_IDS
        out.append(begin)
    return out if begin == n else [*out, n]


class Encoder:
    """Token ids of whole texts by the tokenizers library, looked up word by word.

    Byte-level pre-tokenization ends a piece before each white space and before
    punctuation behind a letter or digit, and a single newline is a token of its
    own. So the ids of a text are those of its words, where a word keeps the blank
    or newline before it. Words repeat: a table holds the ids of those seen, under
    two independent hashes of 64 bits. Hashing, lookup and joining run over whole
    arrays; new words are encoded together, with newlines between them. A text
    with other white space, or with a special token in it, is encoded as it is.
    """

    SLOT_BITS = 21
    POOL = 1 << 24
    LONGEST = 64

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.tables = np.random.default_rng(4099).integers(0, 1 << 64, (2, self.LONGEST * 256), dtype=np.uint64)
        kind = np.zeros(256, np.uint8)
        kind[[c for c in range(128) if chr(c).isalnum()]] = 1
        kind[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
        kind[[10, 32]] = 3
        self.kind = kind
        self._forget()

    def _forget(self) -> None:
        slots = 1 << self.SLOT_BITS
        self.keys = np.zeros((2, slots), np.uint64)
        self.begin = np.zeros(slots, np.int32)
        self.length = np.zeros(slots, np.uint16)
        self.pool, self.used = np.zeros(self.POOL, self.dtype), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _store(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool) // 2), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of new words begin and how many they are; none for words that need the whole text."""
        begin, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        texts = [w.decode() for w in words]
        bare = [x[1:] if x[0] in " \n" else x for x in texts]
        plain = [i for i, x in enumerate(bare) if x.split() == [x] and not any(t in words[i] for t in self.special)]
        for a in range(0, len(plain), 500):
            some = plain[a : a + 500]
            ids = self._ids("".join([texts[i] if texts[i][0] == "\n" else "\n" + texts[i] for i in some]))
            at = np.append(np.flatnonzero(ids == self.newline[0]), len(ids)) + self._store(ids)
            own = np.array([texts[i][0] != "\n" for i in some])  # the newline before them is not theirs
            begin[some] = at[:-1] + own
            length[some] = at[1:] - begin[some]
        return begin, length

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of UTF-8 texts as bytes, without the end id."""
        filled = [i for i, x in enumerate(texts) if x]
        out = [b""] * len(texts)
        if not filled:
            return out
        if self.used > self.POOL * 3 // 4:
            self._forget()
        data = b"\n" + b"\n".join([texts[i] for i in filled])
        sizes = np.array([len(texts[i]) + 1 for i in filled])
        x = np.frombuffer(data, np.uint8)
        kind = self.kind[x]
        starts = np.flatnonzero((kind == 3) | np.append(False, (kind[1:] == 2) & (kind[:-1] == 1)))
        lengths = np.diff(starts, append=len(x))
        place = np.arange(len(x), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        place = (np.minimum(place, self.LONGEST - 1) << 8) | x
        h, h2 = (np.add.reduceat(t[place], starts) for t in self.tables)
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        odd = (lengths == 1) & (kind[starts] == 3)
        far = lengths > self.LONGEST
        known = (self.keys[0, slot] == h) & (self.keys[1, slot] == h2) & ~far
        begin, length = self.begin[slot].astype(np.int64), self.length[slot].astype(np.int64)
        new = np.flatnonzero(~known & ~odd & ~far)
        if len(new):
            _, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[first]
            b, n = self._learn([data[i:j] for i, j in zip(starts[at].tolist(), (starts[at] + lengths[at]).tolist(), strict=True)])
            begin[new], length[new] = b[inverse], n[inverse]
            same = h2[new] == h2[at][inverse]
            where = slot[at]
            self.keys[0, where], self.keys[1, where], self.begin[where], self.length[where] = h[at], h2[at], b, n
            far[new[~same]] = True  # another word of an equal hash
        long = np.flatnonzero(far)
        if len(long):
            begin[long], length[long] = self._learn([data[i:j] for i, j in zip(starts[long].tolist(), (starts[long] + lengths[long]).tolist(), strict=True)])
        length[odd] = 0
        ends = np.cumsum(length)
        ids = self.pool[np.repeat(begin - (ends - length), length) + np.arange(ends[-1])].tobytes()
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        word_at = np.append(np.searchsorted(starts, text_at[:-1]), len(starts))
        token_at = (np.append(0, ends)[word_at] * self.dtype.itemsize).tolist()
        whole = np.logical_or.reduceat(length == 0, word_at[:-1]) | (len(self.newline) != 1)
        special = any(t in data for t in self.special)
        for k, i in enumerate(filled):
            if whole[k] or (special and any(t in texts[i] for t in self.special)):
                out[i] = self._ids(texts[i].decode()).tobytes()
            else:  # a text begins with no newline of its own
                out[i] = ids[token_at[k] + self.dtype.itemsize : token_at[k + 1]]
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, width: int) -> Encoder:
    """One encoder a worker, so that tasks of one worker share its words."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def id_width(tokenizer_path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Recent:
    """The digests seen last, at most twice REMEMBERED."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.most, self.new, self.old = most, set(), set()

    def add(self, digest: bytes) -> bool:
        """Remember; whether it was not known."""
        if digest in self.new or digest in self.old:
            return False
        if len(self.new) >= self.most:
            self.new, self.old = set(), self.new
        self.new.add(digest)
        return True


def _merkle(leaves: list[bytes]) -> bytes:
    level = leaves or [_digest(b"")]
    while len(level) > 1:
        level = [_digest(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> str:
    """Encode all documents and write a store; returns its folder.

    Null and empty texts are the end id alone. Null ids come first, as in an
    ascending sort; rows that share an id are stored one after the other, in the
    order of their ids' digests. Other columns are ignored. An empty table makes a
    store without chunks and recipes. ``path`` must be seen by all executors;
    without it the store goes to the session's shared folder.

    Text is encoded once. Chunks and recipes leave one task together; a task keeps
    one copy of its equal chunks, and a shuffle by digest brings the copies of all
    tasks together, of which one is stored.
    """
    spark = docs.sparkSession
    path = path or f"{work_dir(spark)}/token-store-{uuid.uuid4().hex}"
    width = id_width(tokenizer_path, end_id)
    end = np.array([end_id], "<u2" if width == 2 else "<u4").tobytes()
    schema = "kind string, key binary, data binary, doc_id long, n_tokens long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(tokenizer_path, width), Recent()
        for batch in batches:
            for a in range(0, batch.num_rows, 400):
                part = batch.slice(a, 400)
                rows: list[tuple] = []
                for i, data in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    data += end
                    recipe, begin = [], 0
                    for stop in cut_points(np.frombuffer(data, encoder.dtype)):
                        chunk = data[begin * width : stop * width]
                        begin = stop
                        recipe.append(digest := _digest(chunk))
                        if seen.add(digest):
                            rows.append(("chunk", digest, chunk, None, None))
                    joined = b"".join(recipe)
                    rows.append(("recipe", _digest(joined), joined, i, begin))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["kind", "key", "data", "doc_id", "n_tokens"])

    encoded = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(encode, schema)
    with Scratch(spark) as scratch:
        # recipes of one text have one digest: they are dealt by document, only chunks by digest
        salt = F.when(F.col("kind") == "recipe", F.col("doc_id"))
        sorted_ = encoded.repartition(F.col("key"), salt).sortWithinPartitions("kind", "key")
        scratch.paths.append(parts := f"{path}/_encoded")
        sorted_.mapInArrow(_first_of_equal, schema).write.partitionBy("kind").parquet(parts)
        # the chunks stay where they are written: their folder becomes the store's
        move(spark, f"{parts}/kind=chunk", f"{path}/parts/kind=chunk")
        recipes = spark.read.schema("key binary, data binary, doc_id long, n_tokens long").parquet(f"{parts}/kind=recipe") if exists(spark, f"{parts}/kind=recipe") else spark.createDataFrame([], "key binary, data binary, doc_id long, n_tokens long")
        _write_recipes(scratch, recipes.select("doc_id", "n_tokens", "key", F.col("data").alias("digests")), f"{path}/recipes")
    stored, kept = chunks(spark, path), _recipes(spark, path)
    documents, recipe_root = _root(kept, _RECIPE)
    pieces, chunk_root = _root(stored, ("digest",))
    root = {"version": VERSION, "id_bytes": width, "end_id": end_id, "tokenizer": _file_digest(tokenizer_path), "documents": documents, "chunks": pieces, "chunk_root": chunk_root, "recipe_root": recipe_root}
    spark.createDataFrame([(json.dumps(root),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return path


def _first_of_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind and key: all recipes, and of chunks of one key the first."""
    last = None
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(kind == "recipe" or key != last)
            last = key if kind == "chunk" else None
        yield batch.filter(pa.array(keep, pa.bool_()))


def _file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.blake2b(f.read(), digest_size=16).hexdigest()


_CHUNK = "key binary, data binary"
_RECIPE = ("doc_id", "start", "n_tokens", "digests")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """``digest, ids`` of the chunks of a store."""
    folder = f"{path}/parts/kind=chunk"
    found = spark.read.schema(_CHUNK).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], _CHUNK)
    return found.select(F.col("key").alias("digest"), F.col("data").alias("ids"))


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, n_tokens long, digests binary").parquet(f"{path}/recipes")


def _leaves(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``leaf, n, l0 .. l7``: the leaves that entries of these columns fall in, added up by task; the sum in parts of 32 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * LEAVES, [0] * LEAVES
        blake = hashlib.blake2b
        for batch in batches:
            # what has a fixed length comes first, so that equal bytes mean equal entries
            fixed = b"".join(c.fill_null(np.iinfo(np.int64).min).to_numpy().astype("<i8").tobytes() for c in batch.columns[:-1])
            numbers = np.frombuffer(fixed, "<i8").reshape(len(batch.columns) - 1, -1).T.tobytes() if len(batch.columns) > 1 else b""
            width = 8 * (len(batch.columns) - 1)
            for i, data in enumerate(batch.columns[-1].to_pylist()):
                value = int.from_bytes(blake(numbers[i * width : (i + 1) * width] + data, digest_size=32).digest(), "little")
                counts[value % LEAVES] += 1
                sums[value % LEAVES] += value
        held = [k for k in range(LEAVES) if counts[k]]
        limbs = np.frombuffer(b"".join((sums[k] % (1 << 256)).to_bytes(32, "little") for k in held), "<u4").reshape(-1, 8).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([counts[k] for k in held], pa.int64()), *(pa.array(limbs[:, i]) for i in range(8))], names=["leaf", "n", *_LIMBS])

    return rows.select(*columns).mapInArrow(add, "leaf int, n long, " + ", ".join(f"{x} long" for x in _LIMBS))


_LIMBS = [f"l{i}" for i in range(8)]


def _top(leaves: DataFrame) -> tuple[int, str]:
    """Entries and Merkle root from at most LEAVES rows, of which there is one a leaf."""
    rows = leaves.groupBy("leaf").agg(*(F.sum(x).alias(x) for x in ("n", *_LIMBS))).orderBy("leaf").collect()
    total = lambda r: sum(r[x] << 32 * i for i, x in enumerate(_LIMBS)) % (1 << 256)
    return sum(r.n for r in rows), _merkle([_digest(r.leaf.to_bytes(4, "big") + r.n.to_bytes(8, "big") + total(r).to_bytes(32, "big")) for r in rows]).hex()


def _root(rows: DataFrame, columns: tuple[str, ...]) -> tuple[int, str]:
    return _top(_leaves(rows, columns))


def verify(spark: SparkSession, path: str) -> dict:
    """The manifest, after documents and chunks have been counted and both Merkle roots computed again; else an error."""
    told = manifest(spark, path)
    for name, root, found in (("documents", "recipe_root", _root(_recipes(spark, path), _RECIPE)), ("chunks", "chunk_root", _root(chunks(spark, path), ("digest",)))):
        if found != (told[name], told[root]):
            raise ValueError(f"the {name} of {path} are not those of its manifest: {found[0]} of {told[name]}")
    return told


def _write_recipes(scratch: Scratch, recipes: DataFrame, path: str) -> None:
    """Recipes in ascending doc_id order with the number of ids before each.

    A range sort is kept with the range's number; sums of ranges, one row each, then
    running sums within each range. A second range sort by what the first found puts
    the ranges in order again, and files are named by their task.
    """
    order = (F.col("doc_id").asc_nulls_first(), F.col("key"))
    ordered = scratch.stash(recipes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "recipes")
    totals = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    starts = totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ordered.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
    placed.select("doc_id", "start", "n_tokens", "digests").repartitionByRange("start").sortWithinPartitions("start").write.parquet(path)


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def _partition_of_worker() -> int:
    return TaskContext.get().partitionId()


# --- crc32 of a concatenation from the crc32 of its parts

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the crc polynomial, bits reflected."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


@lru_cache(maxsize=1)
def _shifts() -> list[np.ndarray]:
    """For each k below 48, tables (4 by 256) that append 2**k zero bytes to what has a crc."""
    out, power = [], _times(1 << 27, 1 << 27)  # x**8 is the square of x**4
    for _ in range(48):
        bits = [_times(power, 1 << i) for i in range(32)]
        table = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for value in range(256):
                for i in range(8):
                    if value >> i & 1:
                        table[byte, value] ^= bits[8 * byte + i]
        out.append(table)
        power = _times(power, power)
    return out


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc adds to that of a whole in which so many bytes follow its part."""
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k, table in enumerate(_shifts()):
        on = np.flatnonzero(n_bytes >> k & 1)
        if len(on):
            v = crc[on]
            crc[on] = table[0, v & 255] ^ table[1, v >> 8 & 255] ^ table[2, v >> 16 & 255] ^ table[3, v >> 24]
        elif not (n_bytes >> k).any():
            break
    return crc


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the stored files alone.

    Documents and chunks are first held to the manifest (``verify``). Each stored
    chunk is read once, checked against its digest and summed up as (ids, crc32 as
    32-bit integers); a recipe's sums are combined in its order, so no chunk is
    copied to the documents that share it. A recipe whose chunks are missing or
    whose length differs is an error.
    """
    width = verify(spark, path)["id_bytes"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, n, crc = batch.column(0).to_pylist(), [], []
            for digest, data in zip(digests, batch.column(1).to_pylist(), strict=True):
                if _digest(data) != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(data, "<u2" if width == 2 else "<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "ids", "crc"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document's number is unique in the read of the recipes, which one stash keeps
        row = _partition_of_worker() << 40
        for batch in batches:
            out: list[tuple] = []
            for i, start, n, joined in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                out += [(row, i, start, n, at // 16, joined[at : at + 16], len(joined) // 16) for at in range(0, len(joined), 16)]
                row += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["row", "doc_id", "start", "n_tokens", "at", "digest", "parts"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(4)
            parts, lengths = found.flatten(), np.diff(found.offsets.to_numpy())
            if parts.field(1).null_count:
                raise ValueError("a recipe names a chunk that is missing")
            ids, crc = (parts.field(k).to_numpy() for k in (1, 2))
            first = np.append(0, np.cumsum(lengths)[:-1])
            ends = np.cumsum(ids)
            total = np.add.reduceat(ids, first)
            if (lengths != batch.column(3).to_numpy()).any() or (total != batch.column(2).to_numpy()).any():
                raise ValueError("a recipe does not match the stored chunks")
            after = np.repeat(ends[first + lengths - 1], lengths) - ends
            whole = np.bitwise_xor.reduceat(crc_shift(crc, 4 * after), first)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(whole.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    stored = chunks(spark, path).mapInArrow(sums, "digest binary, ids long, crc long")
    recipes = _recipes(spark, path)
    occurrences = recipes.mapInArrow(split, "row long, doc_id long, start long, n_tokens long, at long, digest binary, parts long")
    # a chunk that is not there leaves nulls, which combine() finds
    joined = occurrences.join(stored, "digest", "left")
    return (
        joined.groupBy("row")
        .agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.min("n_tokens").alias("n_tokens"), F.min("parts").alias("parts"), F.array_sort(F.collect_list(F.struct("at", "ids", "crc"))).alias("found"))
        .select("doc_id", "start", "n_tokens", "parts", "found")
        .mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def read_documents(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, ids`` (array of int): documents put together from their recipes, all or those of ``doc_ids``.

    Documents and chunks are first held to the manifest (``verify``), and each
    chunk used to its digest. Missing chunks and wrong lengths are errors.
    Documents that share an id are told apart by ``start``.
    """
    dtype = "<u2" if verify(spark, path)["id_bytes"] == 2 else "<u4"
    recipes = _recipes(spark, path)
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select(F.col(doc_ids.columns[0]).alias("doc_id")).distinct(), "doc_id", "left_semi")
    each = recipes.select("doc_id", "start", "n_tokens", "digests", F.explode(F.expr("sequence(0, cast(octet_length(digests) / 16 as int) - 1)")).alias("at")).select("doc_id", "start", "n_tokens", "at", F.expr("substring(digests, at * 16 + 1, 16)").alias("digest"))
    parts = each.join(chunks(spark, path), "digest", "left").groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "ids"))).alias("parts"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for n, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if any(x["ids"] is None or _digest(x["ids"]) != x["digest"] for x in found):
                    raise ValueError("a chunk is missing or damaged")
                values.append(np.frombuffer(b"".join(x["ids"] for x in found), dtype).astype(np.int32))
                if len(values[-1]) != n:
                    raise ValueError("a recipe does not match the stored chunks")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return parts.mapInArrow(ids, "doc_id long, start long, ids array<int>")
