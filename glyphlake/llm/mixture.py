"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key divided by its quality weight; the
documents of a source in the order of their keys are a weighted sample of any
length. Whole epochs of a source come first, then the documents whose running
size still fits the rest of the source's target. A source may hold any share of
the rows: the running sums are taken within key ranges and then over the ranges,
so no task reads a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import stash, word_count

#: Rows of one key range, on average.
RANGE_ROWS = 2000
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, n`` to the same with ``target``.

    Sources by code point, null last, weigh ``weights``, repeating, and share
    ``share`` of all sizes. A target stops at ``max_epochs`` times its source's
    size; the excess goes to the others by weight until none is above. This is
    the level L at which the sum of min(cap, L * weight) meets the total: with
    the sources in the order of cap / weight, those before some source are
    capped and the rest share what is left. One row per source is sorted in one
    task; the number of sources is that of the corpora mixed, not of rows.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    up_to, everything = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("capped", F.sum("cap").over(up_to) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(everything) - (F.sum("weight").over(up_to) - F.col("weight")))
        .withColumn("level", F.greatest(F.lit(0.0), F.col("total") - F.col("capped")) / F.col("open"))
    )
    # the level is that of the first source whose own cap is above it; without one all are at their caps
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    return levels.withColumn("at", level["level"]).select("source", "source_size", "n", F.coalesce(F.least(F.col("cap"), F.col("at") * F.col("weight")), F.col("cap")).alias("target"))


def sampling_key(doc_id: Column, salt: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u from a hash, so that reruns agree."""
    u = (F.pmod(F.xxhash64(doc_id, salt, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def mix(docs: DataFrame, quality: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """How often and how far each document is taken.

    Returns ``doc_id, source, text_hash, size, source_size, target, taken``, one row
    per row of docs. ``taken`` counts words: whole epochs of the document, and its
    size once more if the sample of the last, partial epoch takes it. The sample
    takes documents whole, in the order of their keys, as long as more than half
    of the next one fits, so a source ends within half a document of its target.
    ``quality`` (``doc_id, weight``) scales the keys; documents without a positive
    weight count 1, several weights of one id are averaged.

    Null texts and texts without words have size 0 and are taken with 0 words.
    A null source is a source, the last in order. Repeated rows are rows of their
    own with equal keys; which of them comes first makes no difference to the
    result as a set. An empty table gives no rows. Other columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("text_hash"))
    if quality is not None:
        weight = quality.where("doc_id is not null").groupBy("doc_id").agg(F.avg("weight").alias("weight"))
        base = base.join(weight, "doc_id", "left").withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0)))
    else:
        base = base.withColumn("weight", F.lit(1.0))
    base = stash(base.select("doc_id", "source", "size", "text_hash", sampling_key(F.col("doc_id"), F.col("text_hash"), F.col("weight"), seed).alias("key")), "mix-base")
    per_source = stash(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, max_epochs), "mix-targets")
    # 1 - exp(-key) is spread over 0 .. 1, evenly where the weights are 1
    keyed = base.join(per_source, base["source"].eqNullSafe(per_source["source"])).select("doc_id", base["source"], "size", "text_hash", "key", "source_size", "target", F.floor((1 - F.exp(-F.col("key"))) * F.ceil(F.col("n") / RANGE_ROWS)).alias("range"))
    by_range = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before_range = by_range.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")).alias("before_range"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = keyed.withColumn("before", F.sum("size").over(within) - F.col("size"))
    placed = ordered.join(before_range, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.when(rest - (F.col("before") + F.col("before_range")) > F.col("size") / 2, F.col("size")).otherwise(0)
    return placed.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, taken: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, each as many times as the mix takes it.

    Rows of the same id and text are alike to the mix; their takes are dealt as
    an average over them, so that repeated rows multiply neither.
    """
    times = taken.where("taken > 0").groupBy("doc_id", "text_hash").agg((F.sum("taken") / F.first("size")).alias("all_times"))
    rows = taken.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    per_row = times.join(rows, [times["doc_id"].eqNullSafe(rows["doc_id"]), times["text_hash"].eqNullSafe(rows["text_hash"])]).select(times["doc_id"].alias("_id"), times["text_hash"].alias("_hash"), F.round(F.col("all_times") / F.col("rows")).cast("int").alias("_times"))
    joined = docs.join(per_row, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_hash")))
    return joined.where("_times > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _times)"))).select(*docs.columns)
