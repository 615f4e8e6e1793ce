"""Language identification with string kernels.

Two texts are as alike as the n-grams that both hold, over a blend of n: the
presence kernel |A & B| / sqrt(|A| |B|). Kernel ridge regression, one language
against the rest, is solved over Nystroem landmarks. As the kernel is a scalar product of
presence vectors, the landmarks and their coefficients fold into one matrix of
n-grams by languages, and texts are scored by products of their presence
vectors with it, in batches. n-grams are hashed to 65,536 places, so the kernel
is that of the places: n-grams that share one count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: n of the blended spectrum, in bytes of the cleaned text; n-grams are hashed to SLOTS places.
ORDERS = (1, 2, 3, 4)
SLOTS = 1 << 16
#: The sample that is learnt from: so many documents of each language, fewer if they
#: would be more than MAX_SAMPLE in all, one at least; and the landmarks among them.
PER_LANG = 200
MAX_SAMPLE = 4000
LANDMARKS = 400
SPREAD = 16
RIDGE = 1e-3
UNDEFINED = "und"

#: ASCII bytes that are no letters become blanks; bytes of other characters stay.
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MULTIPLIERS = np.random.default_rng(1202).integers(1 << 30, 1 << 31, 8, dtype=np.uint32) | np.uint32(1)


def ngrams(text: str | None) -> np.ndarray | None:
    """Places of the n-grams of a text, each once; None without letters."""
    if not text or not any(map(str.isalpha, text)):
        return None
    clean = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split()) + b" "
    x = np.frombuffer(clean, np.uint8).astype(np.uint32)
    there = np.zeros(SLOTS, bool)
    code = np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            break
        code = code[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            there[(code * _MULTIPLIERS[n] + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(16)] = True
    return np.flatnonzero(there).astype(np.uint16)


@dataclass
class Model:
    """Languages and the matrix of n-grams by languages."""

    langs: list[str]
    matrix: np.ndarray

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for a in range(0, len(texts), batch):
            rows = [ngrams(x) for x in texts[a : a + batch]]
            known = [r for r in rows if r is not None]
            best, sure = [], []
            if known and self.langs:
                # the presence vectors as a sparse matrix: sums of the rows of their n-grams
                ends = np.cumsum([len(r) for r in known])
                values = np.add.reduceat(self.matrix[np.concatenate(known)], np.concatenate([[0], ends[:-1]]), axis=0) / np.sqrt([[len(r)] for r in known])
                top = values.argmax(1)
                best = [self.langs[i] for i in top]
                sure = np.clip((values[np.arange(len(top)), top] + 1) / 2, 0, 1).tolist()
            pairs = iter(zip(best, sure, strict=True))
            for r in rows:
                lang, score = (UNDEFINED, 0.0) if r is None or not self.langs else next(pairs)
                langs.append(lang)
                scores.append(score)
        return langs, scores


def packed(places: np.ndarray) -> bytes:
    """Places as a bitmap of SLOTS bits."""
    there = np.zeros(SLOTS, bool)
    there[places] = True
    return np.packbits(there).tobytes()


def fit(bitmaps: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression over landmarks, taken from the languages in turn, one of each language at least."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    bits = np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)
    size = np.sqrt(np.bitwise_count(bits).sum(1, dtype=np.int64))
    seen: dict[str, int] = {}
    turns = [seen.update({x: seen.get(x, 0) + 1}) or seen[x] for x in langs]
    turn = np.argsort(turns, kind="stable")[: max(landmarks, len(names))]
    kernel = np.stack([np.bitwise_count(bits & bits[j]).sum(1, dtype=np.int64) / (size * size[j]) for j in turn], axis=1)
    wanted = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # both classes of each language weigh the same, however many languages there are
    weigh = np.stack([np.where(w > 0, 0.5 / max(1, (w > 0).sum()), 0.5 / max(1, (w < 0).sum())) for w in wanted.T], axis=1)
    coefficients = np.empty((len(turn), len(names)))
    for c in range(len(names)):
        weighted = kernel * weigh[:, c : c + 1]
        left = weighted.T @ kernel + ridge * kernel[turn] + 1e-9 * np.eye(len(turn))
        coefficients[:, c] = np.linalg.solve(left, weighted.T @ wanted[:, c])
    matrix = np.zeros((SLOTS, len(names)), np.float32)
    for j, a in zip(turn, coefficients, strict=True):
        matrix[np.flatnonzero(np.unpackbits(bits[j].view(np.uint8)))] += a / size[j]
    return Model(names, matrix)


def train(docs: DataFrame, learnable: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_sample: int = MAX_SAMPLE) -> Model:
    """A model from a bounded sample of the rows where ``learnable`` holds and lang is not null.

    All languages are learnt. Of each, the sample holds the PER_LANG texts of the
    smallest hashes of id and text, fewer if all would be more than ``max_sample``,
    but one at least; rows alike in id, text and language are one. Only bitmaps of
    the sample reach the driver, 8 KB a text. Texts without letters teach nothing.
    """
    labelled = docs.where(learnable & F.col(lang).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), F.col(text).cast("string").alias("text"))
    with_letters = labelled.where(F.col("text").rlike("\\p{L}"))
    hashes = with_letters.select("lang", "h").distinct()
    n = hashes.select("lang").distinct().count()
    each = max(1, min(PER_LANG, max_sample // max(1, n)))
    # the smallest of each part first: a common language is dealt over SPREAD tasks
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("h"))
    few = hashes.withColumn("part", F.pmod("h", F.lit(SPREAD))).withColumn("rank", rank("part")).where(F.col("rank") <= each)
    chosen = few.withColumn("rank", rank()).where(F.col("rank") <= each).select("lang", "h")
    rows = with_letters.join(F.broadcast(chosen), ["lang", "h"], "left_semi")

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(x) for x in batch.column(2).to_pylist()]
            keep = pa.array([f is not None for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([packed(f) for f in found if f is not None], pa.binary())], names=["lang", "h", "bitmap"])

    sample = sorted((r.h, r.lang, bytes(r.bitmap)) for r in rows.mapInArrow(bitmaps, "lang string, h long, bitmap binary").groupBy("lang", "h").agg(F.min("bitmap").alias("bitmap")).collect())
    return fit([x for _, _, x in sample], [x for _, x, _ in sample])


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of docs.

    ``und`` with score 0 where the text is null, empty or without letters, or
    where nothing could be learnt. ``score`` is the regression of the language
    predicted, brought from -1 .. 1 to 0 .. 1. Ties go to the language first in
    order. Letters are what Unicode calls so. Whole texts are scored; other columns,
    languages among them, are not read. The model that is broadcast has SLOTS rows
    and one column a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of docs whose language is not ``und``, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _ = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNDEFINED for x in langs], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
