"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the tokens of each window and ignore the others, so a
substituted word between the picked ones leaves the hash as it is. Hashes of
benchmark items and of documents are joined; around each hit the aligned tokens
are compared one by one, and an overlap counts when enough of a window agrees.
Only built-in functions are used: tokens become 64-bit hashes once, positions
are generated and probed in one code-generated stage, and documents are not
shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token offsets that the seeds look at. Any 16 aligned tokens with up to three
#: substitutions hold a window in which one of the masks sees no substitution.
MASKS = ((0, 1, 2, 5, 6), (0, 2, 3, 4, 5), (0, 1, 2, 7, 8))
SPAN = 9
#: Aligned tokens that are compared, and the share of them that must agree.
WINDOW = 16
AGREE = 0.8
#: Seeds of one broadcast (three numbers each); a larger benchmark is searched in blocks of that size.
MAX_SEEDS = 400_000
#: Tokens of the items, of eight bytes each, up to which their tokens are broadcast.
ITEM_TOKENS = 4_000_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(tokens: Column, at: Column, mask: Column) -> Column:
    """Hash of the tokens that a mask (0, 1, ..) picks at a position; 0 where the window would run past the end.

    One expression for all masks, as the stage that evaluates it for each
    position must stay small enough to be compiled; never null, so that no filter
    evaluates it a second time.
    """

    def offset(k: int) -> Column:
        out = F.lit(MASKS[0][k])
        for i, m in enumerate(MASKS[1:], 1):
            out = F.when(mask == i, m[k]).otherwise(out)
        return out

    picked = [F.get(tokens, at + offset(k)) for k in range(1, len(MASKS[0]))]
    return F.when(F.size(tokens) - at > offset(-1), F.xxhash64(mask, F.get(tokens, at), *picked)).otherwise(F.lit(0).cast("long"))


def _positions(rows: DataFrame, tokens: str) -> DataFrame:
    """Rows with ``at`` and ``mask`` for each position of their tokens and mask, from one sequence of numbers."""
    k = len(MASKS)
    shortest = min(m[-1] for m in MASKS) + 1
    numbers = F.when(F.size(tokens) >= shortest, F.sequence(F.lit(0), F.size(tokens) * k - 1))
    # the outer form keeps Spark from filtering by the size of tokens computed anew
    return rows.select(*rows.columns, F.explode_outer(numbers).alias("n")).select(*rows.columns, F.expr(f"cast(n div {k} as int)").alias("at"), (F.col("n") % k).alias("mask"))


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_key, item`` (token hashes) of the distinct texts with tokens, and all their ids."""
    items = benchmark.select(F.col(item_id).alias("item_id"), token_hashes(F.col(text)).alias("item")).where(F.size("item") > 0)
    return items.groupBy("item").agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("nameless")).select(F.xxhash64("item").alias("item_key"), "item", "ids", "nameless")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """``seed, item_key, item_at``: one row per item of SPAN tokens or more, position and mask."""
    at = _positions(items.where(F.size("item") >= SPAN).select("item_key", "item"), "item").where("at is not null").withColumnRenamed("at", "item_at")
    return at.select(_seed(F.col("item"), F.col("item_at"), F.col("mask")).alias("seed"), "item_key", "item_at").where("seed <> 0").distinct()


def _agreeing(doc: Column, item: Column, before: Column) -> Column:
    """Most agreeing tokens in WINDOW aligned tokens that hold the hit, of all such windows.

    The slices begin ``before`` tokens in front of the hit.
    """
    equal = F.zip_with(doc, item, lambda a, b: F.when(a == b, 1).otherwise(0))
    in_window = lambda s: F.aggregate(F.slice(equal, s + 1, F.lit(WINDOW)), F.lit(0), lambda n, x: n + x)
    return F.array_max(F.transform(F.sequence(F.lit(0), before), in_window))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_seeds: int = MAX_SEEDS) -> DataFrame:
    """Documents that hold (almost) a passage of a benchmark item.

    Returns ``doc_id, item_id, hits, first_token, last_token, agreeing``: one row
    per pair, the number of verified hits, the range of token positions they
    start at, and the most tokens that agree in one window. A pair is returned
    when at least ``AGREE`` of ``WINDOW`` aligned tokens agree (of the whole
    item, if it is shorter) and a mask's tokens are among them, which three
    substitutions or fewer in ``WINDOW`` tokens never prevent. Items of fewer than
    ``SPAN`` tokens are too short for substitutions: a document must hold all of
    their tokens in a row. Tokens are lower-cased runs of letters and digits.

    Nulls count as empty texts; texts without tokens take no part. Null ids are
    kept as ids; rows that share an id are one document. Items of equal tokens are
    searched once and returned under each of their ids. An empty table on either
    side gives no rows. Other columns are ignored.

    Seeds are rows of three numbers, counted first. Up to ``max_seeds`` of them are
    broadcast; more are dealt by hash into blocks of about that size, and the
    documents are scanned once for each block. The items' tokens meet only the
    hits: broadcast if all of them are ``ITEM_TOKENS`` at most, else in a shuffle.
    """
    items = benchmark_items(benchmark, item_id, item_text)
    size = items.agg(F.sum(F.size("item")).alias("tokens"), F.sum(F.when(F.size("item") >= SPAN, F.size("item"))).alias("long"), F.collect_set(F.when(F.size("item") < SPAN, F.size("item"))).alias("short"), F.count(F.when(F.size("item") < SPAN, 1)).alias("shorts")).first()
    small = lambda df, n, most: F.broadcast(df) if n <= most else df
    seeds = benchmark_seeds(items)
    known = small(items.select("item_key", "item"), size.tokens or 0, ITEM_TOKENS)
    found = []
    if size.long:
        blocks = max(1, -(-seeds.count() // max_seeds))
        found += [_search(docs, seeds.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == b) if blocks > 1 else seeds, known, doc_id, text) for b in range(blocks)]
    if size.short:
        found.append(_search_short(docs, small(items.where(F.size("item") < SPAN), size.shorts, max_seeds), sorted(size.short), doc_id, text))
    if not found:
        return docs.sparkSession.createDataFrame([], docs.select(F.col(doc_id).alias("doc_id")).schema.add("item_id", benchmark.schema[item_id].dataType).add("hits", "long", False).add("first_token", "integer").add("last_token", "integer").add("agreeing", "integer"))
    hits = reduce(DataFrame.unionByName, found)
    pairs = hits.groupBy("doc_id", "item_key").agg(F.count("*").alias("hits"), F.min("at").alias("first_token"), F.max("at").alias("last_token"), F.max("agreeing").alias("agreeing"))
    # a set holds no nulls: an item without an id has one more row
    names = items.select("item_key", F.explode(F.when(F.col("nameless"), F.concat("ids", F.array(F.lit(None)))).otherwise(F.col("ids"))).alias("item_id"))
    return pairs.join(small(names, size.tokens or 0, ITEM_TOKENS), "item_key").select("doc_id", "item_id", "hits", "first_token", "last_token", "agreeing")


def _search(docs: DataFrame, seeds: DataFrame, items: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Verified hits: ``doc_id, item_key, at, agreeing``.

    Generating positions, hashing and probing fuse into one code-generated stage;
    only hits leave it, with the tokens around them. What follows uses lambdas,
    which Spark interprets: the number of the row (``hit``) keeps it from being
    moved into the join.
    """
    least_span = min(m[-1] for m in MASKS) + 1
    tokens = docs.select(F.col(doc_id).alias("doc_id"), token_hashes(F.col(text)).alias("doc"))
    probes = _positions(tokens, "doc").select("doc_id", "doc", "at", _seed(F.col("doc"), F.col("at"), F.col("mask")).alias("seed"))
    hits = probes.join(F.broadcast(seeds), "seed")
    before = F.least(F.lit(WINDOW - least_span), F.col("at"), F.col("item_at"))
    around = lambda t, at: F.slice(F.col(t), F.col(at) - before + 1, F.lit(2 * WINDOW - least_span))
    cut = hits.select("doc_id", "item_key", "at", "item_at", before.alias("before"), around("doc", "at").alias("doc_near"), F.monotonically_increasing_id().alias("hit"))
    near = cut.where("hit >= 0").join(items, "item_key").select("doc_id", "item_key", "at", "before", "doc_near", F.size("item").alias("length"), F.slice("item", F.col("item_at") - F.col("before") + 1, F.lit(2 * WINDOW - least_span)).alias("item_near"), F.monotonically_increasing_id().alias("met"))
    needed = F.ceil(F.least(F.lit(WINDOW), F.col("length")) * F.lit(AGREE))
    agreeing = _agreeing(F.col("doc_near"), F.col("item_near"), F.col("before"))
    return near.select("doc_id", "item_key", "at", "met", needed.alias("needed"), agreeing.alias("agreeing")).where("met >= 0 and agreeing >= needed").select("doc_id", "item_key", "at", "agreeing")


def _search_short(docs: DataFrame, items: DataFrame, lengths: list[int], doc_id: str, text: str) -> DataFrame:
    """Places of documents that hold a short item whole; runs of each length that items have are looked up."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), token_hashes(F.col(text)).alias("doc"))
    starts = F.when(F.size("doc") > 0, F.sequence(F.lit(0), F.size("doc") - 1))
    runs = tokens.select("doc_id", "doc", F.explode(starts).alias("at")).select("doc_id", "doc", "at", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    asked = runs.where(F.col("at") + F.col("n") <= F.size("doc")).select("doc_id", "at", F.slice("doc", F.col("at") + 1, F.col("n")).alias("item"))
    return asked.join(items, "item").select("doc_id", "item_key", "at", F.size("item").alias("agreeing"))
