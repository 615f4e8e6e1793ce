"""Vectors, token store, archives and the pipeline: against brute force and exact round trips."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from glyphlake.llm import queries, token_store, voronoi_topk, warc
from pyspark.sql import functions as F

# --- top-k


def brute_topk(vectors, queries_, k):
    """Every row but one of the query's own id and vector; ties to the smaller id, a null one last."""
    usable = []
    for i, v in vectors:
        if not v or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        usable.append((i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)))
    out = Counter()
    for i, q in {x for x in usable if x[0] in queries_}:
        others = list(usable)
        others.remove((i, q))
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for j, v in others if len(v) == len(q))[:k]
        out.update((i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored))
    return out


def vectors_of(kind, n=300):
    rng = np.random.default_rng(1)
    if kind == "spread":
        return rng.normal(size=(n, 8))
    if kind == "clustered":
        return rng.normal(size=(6, 8))[rng.integers(0, 6, n)] * 3 + rng.normal(size=(n, 8)) * 0.05
    return np.where(rng.random(n)[:, None] < 0.5, np.ones(8), rng.normal(size=(n, 8)))


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies"])
def test_topk_against_brute_force(spark, kind):
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(vectors_of(kind))]
    vectors += [(1000, None), (1010, []), (1020, [1.0] * 7 + [None]), (1030, [float("nan")] * 8), (1040, [float("inf")] * 8), (None, [1.0] * 8), (None, [1.0] * 8), (None, [0.5] * 8), (1050, [1.0, 2.0]), (1051, [3.0, 2.0])]
    vectors += [(20, [1.0] * 8), (20, [1.0] * 8), (21, [1.0] * 8), (30, vectors[30][1]), *[(25, [0.9] * 8)] * 14]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, cell string, score int")
    got = voronoi_topk.topk(df, df.where("vec_id % 10 = 0"), 5, cell_rows=30, block_rows=10).select("query_id", "rank", "vec_id", "score").collect()
    assert Counter(map(tuple, got)) == brute_topk(vectors, range(0, 2000, 10), 5)


def test_topk_prunes(spark):
    """In clusters, queries reach few of the blocks; copies of one vector are one row."""
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors_of("clustered", 3000))], "vec_id long, embedding array<float>")
    stats = {}
    got = voronoi_topk.topk(df, df.where("vec_id % 10 = 0"), 5, cell_rows=100, block_rows=100, stats=stats).count()
    assert got == 300 * 5 and stats["queries"] == 300
    assert stats["first"] + stats["second"] < 0.3 * stats["queries"] * stats["blocks"]


def test_topk_keeps_every_other_row(spark):
    df = spark.createDataFrame([(100, [1.0]), (7, [1.0]), (7, [1.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.rank, r.vec_id) for r in voronoi_topk.topk(df, df.where("vec_id = 100")).collect()) == [(1, 7), (2, 7), (3, None)]


def test_topk_of_few(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in (0, 10, 11)], "vec_id long, embedding array<float>")
    assert voronoi_topk.topk(df, df.where("vec_id % 10 = 0"), 5).count() == 4
    assert voronoi_topk.topk(df.limit(0), df.limit(0)).count() == 0
    assert voronoi_topk.topk(df, df.limit(0)).count() == 0
    one = df.where("vec_id = 0")
    assert voronoi_topk.topk(one, one).count() == 0


# --- token store


def encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_the_library():
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "'s", "'", "12", "!", ".", "\xa0", "日本", "\r", "\x1f", " \n", "<|endoftext|>", "<|", "…", "x" * 70, "“", "don't", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    whole, enc = encoder(), token_store.Encoder(queries.tokenizer_path(), 2)
    got = [x for a in range(0, 3000, 300) for x in enc.encode([t.encode() for t in texts[a : a + 300]])]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole(t)[:-1] for t in texts]
    assert enc.encode([None, b""]) == [b"", b""]


def test_cut_points_bounds_and_shifts():
    ids = np.random.default_rng(3).integers(0, 50_000, 60_000).astype(np.uint16)
    ends = token_store.cut_points(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MAX_IDS and (sizes[:-1] >= token_store.MIN_IDS).all()
    chunks = {ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}
    moved = np.append(np.uint16(7), ids)
    again = token_store.cut_points(moved)
    assert sum(moved[a:b].tobytes() in chunks for a, b in zip([0, *again], again, strict=False)) >= len(again) - 3
    assert token_store.cut_points(ids[:0]) == [] and token_store.cut_points(np.zeros(10_000, np.uint16))[-1] == 10_000


def test_store_round_trip(spark, tmp_path):
    rng = random.Random(4)
    shared = " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "ünd"]) for _ in range(4000))
    rows = [(d, f"doc {d} " + (shared if d % 3 == 0 else shared[: d * 7])) for d in range(60)] + [(70, None), (71, ""), (72, shared), (73, shared), (None, "no id"), (74, "twice"), (74, "twice")]
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, key string, start int")
    path = token_store.write_store(docs.repartition(5), queries.tokenizer_path(), f"file://{tmp_path}/store")
    enc = encoder()
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = enc(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, map(tuple, token_store.read_index(spark, path).collect()))) == sorted(map(repr, want))
    whole = {(r.doc_id, r.start): r.ids for r in token_store.read_documents(spark, path).collect()}
    assert all(whole[d, s] == enc(t) for (d, s, _, _), t in zip(want, [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0]))], strict=True))
    some = token_store.read_documents(spark, path, spark.createDataFrame([(3,), (72,)], "doc_id long"))
    assert {r.doc_id for r in some.collect()} == {3, 72}
    stored = token_store.chunks(spark, path)
    assert stored.count() == stored.select("digest").distinct().count()
    assert stored.agg(F.sum(F.octet_length("ids"))).first()[0] < 2 * start * 0.6
    m = token_store.manifest(spark, path)
    assert m["id_bytes"] == 2 and m["chunk_root"] != m["recipe_root"]


def rewritten(spark, path, to, chunks=None, recipes=None):
    """A copy of a store with other chunks or recipes."""
    part = spark.read.parquet(f"{path}/parts/kind=chunk")
    (chunks(part) if chunks else part).write.parquet(f"{to}/parts/kind=chunk")
    kept = spark.read.parquet(f"{path}/recipes")
    (recipes(kept) if recipes else kept).coalesce(1).sortWithinPartitions("start").write.parquet(f"{to}/recipes")
    spark.read.text(f"{path}/manifest").write.text(f"{to}/manifest")
    return to


def test_damage_is_found(spark, tmp_path):
    """A damaged chunk, a lost chunk (a document's only one too), a lost document, recipes that have been swapped."""
    rows = [(i, " ".join(f"word{i} {k}" for k in range(400 * (i % 2)))) for i in range(6)]
    path = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path(), f"{tmp_path}/a")
    short = spark.read.parquet(f"{path}/recipes").where("doc_id = 0").first().digests
    swapped = lambda df: df.select(F.when(F.col("doc_id") == 1, 3).when(F.col("doc_id") == 3, 1).otherwise(F.col("doc_id")).cast("long").alias("doc_id"), "start", "n_tokens", "digests")
    cases = [
        (rewritten(spark, path, f"{tmp_path}/b", chunks=lambda c: c.withColumn("data", F.concat("data", F.unhex(F.lit("0000"))))), "damaged"),
        (rewritten(spark, path, f"{tmp_path}/c", chunks=lambda c: c.where(F.col("key") != F.lit(short))), "not those of its manifest"),
        (rewritten(spark, path, f"{tmp_path}/d", recipes=lambda r: r.where("doc_id <> 4")), "not those of its manifest"),
        (rewritten(spark, path, f"{tmp_path}/e", recipes=swapped), "not those of its manifest"),
    ]
    for at, error in cases:
        for read in (token_store.read_index, token_store.read_documents):
            with pytest.raises(Exception, match=error):
                read(spark, at).collect()
    assert token_store.read_index(spark, rewritten(spark, path, f"{tmp_path}/f")).count() == 6


def test_recipes_are_in_order_on_disk(spark, tmp_path):
    import pyarrow.parquet as pq

    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([((i * 7919) % 1000, f"text {i}") for i in range(1000)] + [(None, "x")], "doc_id long, text string").repartition(8)
        path = token_store.write_store(docs, queries.tokenizer_path(), f"{tmp_path}/store")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    files = sorted((tmp_path / "store/recipes").glob("*.parquet"))
    rows = [r for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) > 1 and [r["doc_id"] for r in rows] == [None, *range(1000)]
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()


def test_digests_seen_long_ago_are_forgotten():
    seen = token_store.Recent(2)
    assert [seen.add(x) for x in b"aabcab"] == [True, False, True, True, False, False]
    assert [seen.add(x) for x in b"dea"] == [True, True, True]


def test_store_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.read_index(spark, token_store.write_store(docs, queries.tokenizer_path(), f"{tmp_path}/none")).count() == 0


# --- WARC


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(5)
    bodies = ["<html>" + " ".join(rng.choice(["row", "cell", "ü", "text"]) for _ in range(50 + i)) + "</html>" for i in range(30)]
    rows = [(i, f"http://x/{i}", bodies[i % 30] if i % 4 else bodies[0]) for i in range(90)]
    rows += [(200, None, None), (201, "http://e", ""), (202, "http://long", "z" * 3_000_000), (300, "http://twice", "same"), (300, "http://twice", "same"), (None, "http://n", "same"), (None, "http://m", "no id")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    files = warc.write_archives(pages, f"file://{tmp_path}/warc")
    got = warc.read_archives(files).collect()
    assert len(got) == len(rows) and files.agg(F.sum("records")).first()[0] == len(rows)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b = best[h or ""]
        response = b == i or b == -1
        body = (h or "").encode()
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else b, body if response else b""))
    assert sorted(map(repr, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.body)) for r in got])) == sorted(map(repr, want))
    ids = Counter(r.record_id for r in got)
    assert max(ids.values()) == 1
    responses = {r.record_id: (r.page_id, r.payload_digest) for r in got if r.record_type == "response"}
    assert all(responses[r.refers_to_record] == (r.refers_to, r.payload_digest) for r in got if r.record_type == "revisit")
    assert warc.write_archives(pages.limit(0), f"{tmp_path}/none").count() == 0


def test_dictionary_of_a_hot_page(spark):
    """Rows of one page and address are one record of the sample."""
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html"))
    rest = spark.range(50).select((F.col("id") + 10).alias("page_id"), F.concat(F.lit("http://"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("<html>some text "), F.md5(F.col("id").cast("string")), F.lit(" and more</html>")).alias("html"))
    assert warc.build_dictionary(hot, "page_id", "url", "html") == b""
    assert len(warc.build_dictionary(hot.unionByName(rest), "page_id", "url", "html")) > 0


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b" * 50), (4, "u", "b" * 50)], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, f"{tmp_path}/w", min_revisit_bytes=10)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archive_is_a_dictionary_frame_and_single_records():
    import struct

    import zstandard

    records = [warc.record(i, f"http://a/{i}", b"<p>body %d</p>" % i) for i in range(200)]
    dictionary = zstandard.train_dictionary(4096, records).as_bytes()
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data = warc.dictionary_frame(dictionary) + b"".join(c.compress(r) for r in records)
    assert struct.unpack("<II", data[:8]) == (0x184D2A5D, len(dictionary))
    assert [h["x-page-id"] for h, _ in warc.read_archive(io.BytesIO(data))] == [str(i) for i in range(200)]
    with pytest.raises(ValueError, match="truncated"):
        list(warc.read_archive(io.BytesIO(data[:-3])))


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34", "en", "src0", 5), (None, "some words without an id here", "en", "src1", 30)], docs.schema)
    at = docs.unionByName(odd)
    assert len(corpus_pipeline.STAGES) == 5
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        sizes.append(out.count())
        if k < 3:  # filters
            assert out.exceptAll(at).count() == 0
        at = out
    assert sizes[0] == docs.where("text rlike '\\\\p{L}'").count() + 1
    assert sizes[0] > sizes[1] > sizes[2] and sizes[3] == sizes[4] > 0
    assert at.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
