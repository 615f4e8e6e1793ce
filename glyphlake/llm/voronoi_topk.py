"""Exact top-k inner products by a Voronoi join.

Pivots divide the vectors into cells, and each cell into rings by the distance to
its pivot. A summary of each ring (its least and greatest distance, its greatest
norm) bounds the score that any of its vectors can have with a query. A query
first meets the rings of its highest bounds, which gives it a threshold: its k-th
best score so far; then it is replicated only to the rings whose bound reaches
the threshold, where all scores are computed. Queries, the smaller side, are what
is replicated; data stay in the blocks of their ring.

For a query q, a pivot p and a vector x of the ring:
<q, x> = <q, p> + <q, x - p> <= <q, p> + |q| * max |x - p|, and
<q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 with |q - x| at least the gap between
|q - p| and the distances of the ring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import Scratch, stash

SCALE = 1024
#: Vectors of a cell on average, up to MAX_PIVOTS pivots (whose vectors are broadcast).
CELL_ROWS = 4096
MAX_PIVOTS = 1024
#: Rings of a cell: summaries are at most RINGS for each pivot.
RINGS = 16
#: Vectors of a ring that one group of a task holds.
BLOCK_ROWS = 8192
#: Queries whose scores with a block are computed at once.
BATCH = 512


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: floor(scale * x) for each component, without unusable vectors.

    Vectors that are null, empty or hold null or non-finite components go.
    """
    x = F.col(embedding)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & finite).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(lengths))[:-1]
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where all sums are below 2**53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 2**52 else a @ b.T


class Pivots:
    """Pivots of several lengths; vectors of a length without a pivot are one cell (-1) without distances."""

    def __init__(self, vectors: list[list[int]]) -> None:
        self.cells = {n: np.array([i for i, v in enumerate(vectors) if len(v) == n]) for n in {len(v) for v in vectors}}
        self.points = {n: np.array([vectors[i] for i in at], np.float64) for n, at in self.cells.items()}

    def far(self, v: np.ndarray) -> np.ndarray | None:
        """Distances to the pivots of this length."""
        p = self.points.get(v.shape[1])
        if p is None:
            return None
        v = v.astype(np.float64)
        return np.sqrt(np.maximum(0, (p * p).sum(1)[None, :] - 2 * v @ p.T + (v * v).sum(1)[:, None]))


def _assigner(pivots):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far, norm = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for rows, v in _by_length(batch.column(1)) if batch.num_rows else ():
                norm[rows] = np.sqrt((v.astype(np.float64) ** 2).sum(1))
                distances = pivots.value.far(v)
                if distances is not None:
                    nearest = distances.argmin(1)
                    cell[rows], far[rows] = pivots.value.cells[v.shape[1]][nearest], distances[np.arange(len(v)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far), pa.array(norm)], names=[*batch.schema.names, "cell", "far", "norm"])

    return assign


def _bounds(v: np.ndarray, pivots: Pivots, rings: np.ndarray) -> np.ndarray:
    """The most that each query (row) can score with a vector of each ring, -inf for rings of other lengths.

    ``rings`` has cell, lo, hi, norm. Rounded up by more than the errors of floats.
    """
    x = v.astype(np.float64)
    own = np.sqrt((x * x).sum(1))[:, None]
    most = np.full((len(v), len(rings)), -np.inf)
    cells = rings[:, 0].astype(np.int64)
    loose = cells == -1
    most[:, loose] = own * rings[loose, 3][None, :]
    points = pivots.points.get(v.shape[1])
    if points is not None:
        where = {int(c): k for k, c in enumerate(pivots.cells[v.shape[1]])}
        some = np.flatnonzero([int(c) in where for c in cells])
        at = np.array([where[int(cells[i])] for i in some], np.int64)
        gap, (lo, hi, norm) = pivots.far(v)[:, at], (rings[some, k][None, :] for k in (1, 2, 3))
        near = np.maximum(0, np.maximum(gap - hi, lo - gap))
        most[:, some] = np.minimum(np.minimum((x @ points.T)[:, at] + own * hi, (own * own + norm * norm - near * near) / 2), own * norm)
    return np.where(np.isfinite(most), most * (1 + np.sign(most) * 1e-9) + 1e-6 * (own * own + rings[:, 3][None, :] ** 2) + 1, most)


_VISIT = "cell int, ring int, block int, query long, vec_id long, v array<long>, n long, least long"


def _visitor(pivots, rings, blocks, first: int, rest: bool):
    """Copies of queries (query, vec_id, v, n, least), one for each block they visit.

    At first, one block of the rings of the highest bounds until they hold
    ``first`` vectors; then (``rest``) all other blocks of the rings whose bound
    reaches the threshold.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count = rings.value, blocks.value
        for batch in batches:
            for rows, v in _by_length(batch.column(2)) if batch.num_rows else ():
                for a in range(0, len(rows), BATCH):
                    most = _bounds(v[a : a + BATCH], pivots.value, table[:, 1:])
                    some = rows[a : a + BATCH]
                    order = np.argsort(-most, axis=1, kind="stable")
                    held = np.cumsum((table[:, 5] / count)[order], axis=1)
                    early = np.zeros(most.shape, bool)
                    np.put_along_axis(early, order, np.append(np.zeros((len(some), 1)), held[:, :-1], axis=1) < first, axis=1)
                    early &= np.isfinite(most)
                    if rest:
                        least = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)[some]
                        reach = np.isfinite(most) & (most >= np.where(np.isnan(least), -np.inf, least)[:, None])
                        # a block seen at first is not seen again
                        times = np.where(reach, count[None, :] - early, 0)
                    else:
                        times = early.astype(np.int64)
                    i, j = np.nonzero(times)
                    many = times[i, j]
                    q, ring = np.repeat(some[i], many), np.repeat(j, many)
                    number = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + (np.repeat(early[i, j], many) if rest else 0)
                    for b in range(0, len(q), 4096):
                        part, own = batch.take(pa.array(q[b : b + 4096])), ring[b : b + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(table[own, 1].astype(np.int32)), pa.array(table[own, 0].astype(np.int32)), pa.array(number[b : b + 4096].astype(np.int32)), *part.columns], names=["cell", "ring", "block", "query", "vec_id", "v", "n", "least"])

    return visit


def _solver(k: int):
    """Each query's k best of the block it visits. Rows come by block, data (query null) before queries."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, data = None, [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            is_data = np.array(batch.column(3).is_null())
            change = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1) | (is_data[1:] != is_data[:-1])))
            out: list[tuple] = []
            for a, b in zip(change, [*change[1:], batch.num_rows], strict=True):
                if at != (key := tuple(keys[a])):
                    at, held, data = key, [], {}
                part = batch.slice(a, b - a)
                if is_data[a]:
                    held.append(part)
                    continue
                if held:
                    data, held = _matrices(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                _answer(part, data, k, out)
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "vec_id", "score", "n"])

    return solve


#: Stands for a null id, which is behind all others.
_NO_ID = np.iinfo(np.int64).max


def _matrices(batch: pa.RecordBatch) -> dict[int, tuple]:
    ids = batch.column(4).fill_null(_NO_ID).to_numpy()
    none, n = np.array(batch.column(4).is_null()), batch.column(6).to_numpy()
    return {v.shape[1]: (ids[rows], none[rows], n[rows], v) for rows, v in _by_length(batch.column(5))}


def _answer(queries: pa.RecordBatch, data: dict[int, tuple], k: int, out: list[tuple]) -> None:
    number, ids = queries.column(3).to_numpy(), queries.column(4).fill_null(_NO_ID).to_numpy()
    least = queries.column(7).fill_null(np.iinfo(np.int64).min).to_numpy()
    for rows, v in _by_length(queries.column(5)):
        if v.shape[1] not in data:
            continue
        d_ids, d_none, d_n, d_v = data[v.shape[1]]
        for a in range(0, len(rows), BATCH):
            some = rows[a : a + BATCH]
            for i, scores in zip(some, _dot(v[a : a + BATCH], d_v), strict=True):
                # k scores and one more, as one row may be the query's own
                floor = max(least[i], np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if len(scores) > k + 1 else least[i])
                found = np.flatnonzero(scores >= floor)
                found = found[np.lexsort((d_none[found], d_ids[found], -scores[found]))]
                left = k
                own = v[a + np.searchsorted(some, i)]
                for j in found:
                    n = int(d_n[j]) - (d_ids[j] == ids[i] and not d_none[j] and (d_v[j] == own).all())
                    if n > 0:
                        out.append((int(number[i]), None if d_none[j] else int(d_ids[j]), int(scores[j]), n))
                        left -= n
                    if left <= 0:
                        break


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS, block_rows: int = BLOCK_ROWS, stats: dict | None = None) -> DataFrame:
    """The k vectors of the highest integer inner product for each query.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``. Returns
    ``query_id, rank, vec_id, score``; all candidates, if there are fewer than k.
    Ties go to the smaller id, a null id last. Exact: a bound only drops pairs that
    cannot enter the result.

    Each row of vectors is a candidate, rows of one id and rows without an id too;
    only one row of a query's own id and vector is none. Vectors that are null,
    empty or hold null or non-finite components take no part, on either side;
    vectors of another length than a query are not its candidates. Query rows
    that repeat an id and vector are answered once. Empty tables give no rows;
    other columns are ignored.

    Equal rows are one row with a count. Rings are dealt into blocks of
    ``block_rows``, so a crowded cell is spread over tasks, and a task holds one
    block while queries stream past it. Broadcast are at most ``max_pivots`` vectors
    and ``RINGS`` summaries for each. ``stats`` gets the numbers of visits.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    with Scratch(spark) as scratch:
        once = lambda df: scaled(df, vec_id, embedding, scale).groupBy("vec_id", "v").agg(F.count("*").alias("n"))
        data = scratch.stash(once(vectors), "knn-data")
        asked = scratch.stash(once(queries).withColumn("query", F.monotonically_increasing_id()).select("query", "vec_id", "v", "n"), "knn-queries")
        rows = data.count()
        if not rows or asked.isEmpty():
            return spark.createDataFrame([], schema)
        wanted = min(max_pivots, max(1, -(-rows // cell_rows)))
        chosen = data.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
        pivots = spark.sparkContext.broadcast(Pivots([r.v for r in chosen]))
        celled = scratch.stash(data.mapInArrow(_assigner(pivots), "vec_id long, v array<long>, n long, cell int, far double, norm double"), "knn-cells")
        widest = celled.groupBy("cell").agg(F.max("far").alias("widest"))
        ringed = celled.join(F.broadcast(widest), "cell").withColumn("ring", F.when(F.col("widest") > 0, F.least(F.lit(RINGS - 1), F.floor(F.col("far") * RINGS / F.col("widest")))).otherwise(0).cast("int"))
        summary = ringed.groupBy("ring", "cell").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.max("norm").alias("norm"), F.count("*").alias("rows"))
        table = np.array([[float(x) for x in r] for r in summary.orderBy("cell", "ring").collect()])
        count = np.ceil(table[:, 5] / block_rows).astype(np.int64)
        rings, blocks = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(count)
        sizes = spark.createDataFrame([(int(r[1]), int(r[0]), int(b)) for r, b in zip(table, count, strict=True)], "cell int, ring int, blocks int")
        placed = ringed.join(F.broadcast(sizes), ["cell", "ring"]).select("cell", "ring", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int").alias("block"), F.lit(None).cast("long").alias("query"), "vec_id", "v", "n", F.lit(None).cast("long").alias("least"))

        def met(visits: DataFrame) -> DataFrame:
            both = placed.unionByName(visits).repartition("cell", "ring", "block").sortWithinPartitions("cell", "ring", "block", F.col("query").asc_nulls_first())
            return both.mapInArrow(_solver(k), "query long, vec_id long, score long, n long")

        open_ = asked.withColumn("least", F.lit(None).cast("long"))
        early = scratch.stash(open_.mapInArrow(_visitor(pivots, rings, blocks, 2 * k, False), _VISIT), "knn-visits")
        first = scratch.stash(met(early), "knn-first")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        before = F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        upper = lambda df: df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).withColumn("before", before).where(F.col("before") < k)
        # the threshold: the score at which k candidates are met
        kth = upper(first).groupBy("query").agg(F.sum("n").alias("met"), F.min("score").alias("score")).select("query", F.when(F.col("met") >= k, F.col("score")).alias("least"))
        later = scratch.stash(asked.join(kth, "query", "left").mapInArrow(_visitor(pivots, rings, blocks, 2 * k, True), _VISIT), "knn-visits")
        if stats is not None:
            stats |= {"rows": rows, "queries": asked.count(), "blocks": int(count.sum()), "first": early.count(), "second": later.count()}
        found = upper(first.unionByName(met(later)))
        each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k) - F.col("before")))))
        answers = each.join(asked.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", (F.col("before") + F.col("copy")).cast("int").alias("rank"), "vec_id", "score")
        return stash(answers, "knn-answers")
