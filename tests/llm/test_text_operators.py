"""Operators over documents against plain restatements, with nulls, ties, repeats and clashing columns."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from glyphlake.llm import bloom_lm, components, decontaminate, licences, line_chunks, mixture, simhash, string_kernel
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seed string, size string, hit string"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); other columns have names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(900, None), (901, ""), (902, "  \n\t "), (None, "a b c d"), (903, "one"), (904, "one two"), (905, "one two"), (905, "one two"), (906, "x " * 30_000)]


# --- decontamination


def brute_leaks(docs, items):
    """Pairs with a verified overlap: 13 of 16 aligned tokens (or 4/5 of a shorter item) of which some five are in a mask's places; short items whole."""
    tok = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = set()
    for i, item in items:
        b = tok(item)
        for d, text in docs:
            a = tok(text)
            if len(b) < decontaminate.SPAN:
                if b and any(a[k : k + len(b)] == b for k in range(len(a))):
                    found.add((d, i))
                continue
            n = min(16, len(b))
            for shift in range(-len(b), len(a)):
                same = [0 <= shift + k < len(a) and a[shift + k] == b[k] for k in range(len(b))]
                if any(sum(same[s : s + n]) >= math.ceil(n * 0.8) and any(all(m + o < s + n and same[m + o] for o in mask) for mask in decontaminate.MASKS for m in range(s, s + n)) for s in range(len(b) - n + 1)):
                    found.add((d, i))
                    break
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.randint(9, 40))) for i in range(12)] + [(20 + n, prose(rng, n)) for n in range(1, 9)] + [(91, None), (92, ""), (93, items_twice := prose(rng, 30)), (94, items_twice), (None, prose(rng, 20))]
    docs = []
    for d in range(90):
        words = prose(rng, 80).split()
        if d % 3 == 0:
            leak = items[d % 12][1].split()
            for _ in range(d % 5):  # substitutions
                leak[rng.randrange(len(leak))] = "changed"
            words[10:10] = leak
        elif d % 3 == 1:
            words[20:20] = items[12 + d % 8][1].split()
        docs.append((d, " ".join(words).upper() if d % 2 else ", ".join(words)))
    docs += [(200, items_twice), (201, items[-1][1] + " and more"), *ODD, (907, "one two three " * 9000 + items[0][1])]
    bench = spark.createDataFrame([(*x, "a", 1) for x in items], "item_id long, text string, seed string, at int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, docs), bench).collect()}
    want = brute_leaks([d for d in docs if d[0] not in (906, 907)], items)
    want |= {(907, 0)} | {(d, i) for d, t in docs if d in (906, 907) for i, x in items if x and len(x.split()) < 9 and f" {x} " in f" {t} "}
    assert got == want
    assert {(200, 93), (200, 94), (201, None)} <= got and {i for _, i in got} == {0, 3, 6, 9, *range(21, 29), 93, 94, None}


def test_no_pattern_of_three_substitutions_escapes(spark):
    """All ways to substitute up to three of sixteen tokens of an item (and of a passage within a longer one)."""
    rng = random.Random(21)
    item, longer = ([f"q{rng.random()}".replace(".", "") for _ in range(n)] for n in (16, 60))
    ways = [w for n in range(4) for w in itertools.combinations(range(16), n)]
    assert len(ways) == 697
    changed = lambda words, way: " ".join("changed" if k in way else w for k, w in enumerate(words))
    docs = [(k, "before it " + changed(item, way) + " after it") for k, way in enumerate(ways)] + [(1000 + k, "before it " + changed(longer[20:36], way) + " after it") for k, way in enumerate(ways)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(longer))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.agreeing for r in decontaminate.contaminated(table(spark, docs), bench).collect()}
    assert set(got) == {(k, 1) for k in range(697)} | {(1000 + k, 2) for k in range(697)}
    assert all(got[k, 1] == got[1000 + k, 2] == 16 - len(way) for k, way in enumerate(ways))


def test_long_items_are_small_in_the_broadcast(spark):
    """What is broadcast of an item grows with its length, not with its square."""
    rng = random.Random(22)
    bench = spark.createDataFrame([(1, prose(rng, 20_000))], "item_id long, text string")
    seeds = decontaminate.benchmark_seeds(decontaminate.benchmark_items(bench))
    assert 50_000 < seeds.count() < 60_000 and {f.dataType.simpleString() for f in seeds.schema} == {"bigint", "int"}


def test_decontamination_in_blocks_and_empty(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, 20)) for i in range(6)]
    docs = table(spark, [(d, prose(rng, 30) + " " + items[d % 6][1]) for d in range(12)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "hits").collect())
    assert len(whole) == 12
    assert sorted(decontaminate.contaminated(docs, bench, max_seeds=50).select("doc_id", "item_id", "hits").collect()) == whole
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


# --- line dedup


def brute_lines(docs, bits=128):
    cutting = {"roll": line_chunks.ROLL, "divisor": line_chunks.DIVISOR, "max_lines": line_chunks.MAX_LINES}
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None and x[1]), key=lambda x: x[0]):
        b = t.encode()
        for s, e, _ in line_chunks._offsets(b, **cutting):
            first.setdefault(b[s:e].removesuffix(b"\n"), d)
    out = []
    for d, t in docs:
        if d is None or t is None:
            out.append((d, t))
            continue
        b, keep, at, seen, cut_ = t.encode(), b"", 0, set(), False
        for s, e, _ in line_chunks._offsets(b, **cutting):
            c = b[s:e].removesuffix(b"\n")
            if c in seen or first[c] < d:
                keep, at, cut_ = keep + b[at:s], e, True
            seen.add(c)
        rest = keep + b[at:]
        if cut_ and at == len(b) and not b.endswith(b"\n"):
            rest = rest.removesuffix(b"\n")
        out.append((d, rest.decode()))
    return out


@pytest.mark.parametrize("bits", [128, 6])
def test_line_dedup_against_brute_force(spark, bits):
    rng = random.Random(3)
    passages = ["\n".join(prose(rng, 8) for _ in range(9)) for _ in range(4)]
    docs = [(d, "\n".join([prose(rng, 6), passages[d % 4] if d % 2 else prose(rng, 5), prose(rng, 6), *([passages[0]] * (d % 5 == 0))])) for d in range(40)]
    docs += [(50, "a\n\n\nb"), (51, "a\n\n\nb"), *ODD[:8]]
    got = {(r.doc_id, r.text) for r in line_chunks.dedup_lines(table(spark, docs), digest_bits=bits).collect()}
    if bits == 128:
        assert got == set(brute_lines(docs))
        assert sum(len(t or "") for _, t in got) < 0.8 * sum(len(t or "") for _, t in docs)
    else:  # chunks that share a short digest are told apart by their bytes: nothing wrong goes
        kept = {(d, w) for d, t in brute_lines(docs) for w in (t or "").split()}
        assert kept <= {(d, w) for d, t in got for w in (t or "").split()}


def test_line_chunks_cover_and_resist_shifts():
    rng = random.Random(4)
    lines = [prose(rng, 4).encode() for _ in range(300)]
    cuts = line_chunks.cut(lines)
    assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == 300
    moved = {tuple(([b"new", *lines])[a:b]) for a, b in line_chunks.cut([b"new", *lines])}
    assert sum(tuple(lines[a:b]) in moved for a, b in cuts) >= len(cuts) - 2
    assert line_chunks.cut([]) == []


def brute_passages(docs, long_words):
    """The definition, line by line: pairs of lines that are not blank, and long lines, with all places that hold them."""
    places = defaultdict(list)
    split = {}
    for at, (d, t) in enumerate(docs):
        if d is None or t is None:
            continue
        lines = t.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip()]
        units = [(i, j) for i, j in zip(filled, filled[1:])] + [(i, i) for i in filled if len(lines[i].split()) >= long_words]
        split[at] = (lines, units)
        for i, j in units:
            places["\n".join(lines[i : j + 1])].append((d, i, j))
    out = []
    for at, (d, t) in enumerate(docs):
        if at not in split:
            out.append((d, t))
            continue
        lines, units = split[at]
        gone = set()
        for i, j in units:
            first_doc, _, end = min(places["\n".join(lines[i : j + 1])])
            if first_doc < d or end < i:
                gone |= set(range(i, j + 1))
        out.append((d, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


@pytest.mark.parametrize("bits", [128, 6])
def test_passages_against_brute_force(spark, bits):
    rng = random.Random(13)
    passages = ["\n".join(prose(rng, 8) for _ in range(n)) for n in (2, 3, 5, 9)] + [prose(rng, 60), "a b\n\n \nc d"]
    docs = [(d, "\n".join([prose(rng, 6), passages[rng.randrange(6)], prose(rng, 6), *([passages[d % 6]] * (d % 5 == 0)), *([prose(rng, 3)] * (d % 2))])) for d in range(60)]
    docs += [(70, "a\n\n\nb"), (71, "a\n\n\nb"), (72, "q\nq\nq"), (73, "r\nr\nr\nr\n"), (74, passages[4]), (75, passages[4] + "\n"), *ODD[:8]]
    got = {(r.doc_id, r.text): r for r in line_chunks.dedup_passages(table(spark, docs), digest_bits=bits).collect()}
    want = set(brute_passages(docs, line_chunks.LONG_WORDS))
    if bits == 128:
        assert set(got) == want
    else:
        kept = {(d, w) for d, t in want for w in (t or "").split()}
        assert kept <= {(d, w) for d, t in got for w in (t or "").split()}


def test_planted_passages_are_removed_whole(spark):
    """Each passage, of two lines or of one long line too, goes from all documents but the first; the query does so."""
    rng = random.Random(14)
    own = lambda d, k: f"line {k} of document {d} alone"
    passages = [[prose(rng, 9) + f" {p} {k}" for k in range(2 + p % 5)] for p in range(30)] + [[prose(rng, 55) + f" {p}"] for p in range(5)]
    docs = [(d, "\n".join([own(d, 0), own(d, 1), *passages[d % 35], own(d, 2), own(d, 3)])) for d in range(105)]
    got = {r.doc_id: r.text for r in line_chunks.dedup_passages(table(spark, docs)).collect()}
    assert all(got[d] == (t if d < 35 else "\n".join(own(d, k) for k in range(4))) for d, t in docs)


def test_line_dedup_empty(spark):
    assert line_chunks.dedup_lines(table(spark, []).limit(0)).count() == 0


# --- mixing


def test_targets_fill_by_weight(spark):
    sizes = [("a", 100, 1), ("b", 1000, 1), ("c", 10, 1), ("d", 500, 1), (None, 300, 1), ("e", 0, 1)]
    got = {r.source: r.target for r in mixture.targets(spark.createDataFrame(sizes, "source string, source_size long, n long")).collect()}
    order = ["a", "b", "c", "d", "e", None]
    size = {s: n for s, n, _ in sizes}
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    total, target = 1.5 * sum(size.values()), dict.fromkeys(order, 0.0)
    left, open_ = total, set(order)
    while left > 1e-9 and open_:  # reshare the excess until none is above its cap
        share = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += share * weight[s]
        left = sum(max(0, target[s] - 2 * size[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 2 * size[s]:
                target[s] = 2 * size[s]
                open_.discard(s)
    assert got == pytest.approx(target)


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(5)
    rows = [(d, prose(rng, rng.randint(0, 60)), "en", f"s{d % 4}" if d % 3 else "hot") for d in range(900)] + [(*r, "en", None) for r in ODD]
    docs = table(spark, rows)
    quality = spark.createDataFrame([(d, 2.0 if d % 2 else 0.5) for d in range(300)] + [(None, 1.0), (3, 8.0)], "doc_id long, weight double")
    got = mixture.mix(docs, quality).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixture.mix(docs.repartition(7), quality).collect()))
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 2 * r.size
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1
        assert sum(r.size for r in rs) == rs[0].source_size
    want = Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, r.size) for r in got) == want
    applied = mixture.apply_mix(docs, mixture.mix(docs, quality))
    assert applied.columns == docs.columns
    words = applied.select(F.sum(mixture.word_count(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in got)
    assert mixture.mix(docs.limit(0)).count() == 0


def test_sample_against_brute_force(spark):
    """Which documents are taken: in the order of their keys, whole, while more than half of the next one fits."""
    rng = random.Random(25)
    rows = [(d, prose(rng, rng.randint(0, 40)) if d % 11 else None, "en", f"s{d % 3}" if d % 2 else None) for d in range(400)] + [(7, "same text twice"), (7, "same text twice"), (None, "no id"), (None, "no id")]
    docs = table(spark, rows)
    quality = spark.createDataFrame([(d, 4.0 if d % 2 else 0.25) for d in range(0, 400, 3)], "doc_id long, weight double")
    got = mixture.mix(docs, quality).collect()
    weight = {r.doc_id: r.weight for r in quality.collect()}
    u = {(r.doc_id, r.text_hash): r.u for r in docs.select("doc_id", F.xxhash64("text").alias("text_hash"), (F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17)) % (1 << 52)).alias("u")).collect()}
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rs in by.values():
        key = lambda r: -math.log((u[r.doc_id, r.text_hash] % (1 << 52) + 0.5) / (1 << 52)) / weight.get(r.doc_id, 1.0)
        epochs = int(rs[0].target // rs[0].source_size) if rs[0].source_size else 0
        rest, before = rs[0].target - epochs * rs[0].source_size, 0
        want = []
        for r in sorted(rs, key=key):
            want.append((r.doc_id, r.size, epochs * r.size + (r.size if rest - before > r.size / 2 else 0)))
            before += r.size
        assert Counter((r.doc_id, r.size, r.taken) for r in rs) == Counter(want)


def test_sampling_prefers_weight(spark):
    """Of a source that is sampled in part, documents of a large weight are taken far more often."""
    docs = table(spark, [(d, "a b c", "en", "s0") for d in range(900)] + [(5000 + d, "a b c", "en", "s2") for d in range(2000)] + [(9000, "a", "en", "s1")])
    quality = spark.createDataFrame([(5000 + d, 4.0 if d % 2 else 0.25) for d in range(2000)], "doc_id long, weight double")
    rows = mixture.mix(docs, quality).where("source = 's2'").collect()
    assert rows[0].target % rows[0].source_size > 0
    more = Counter(r.doc_id % 2 for r in rows if r.taken % (2 * r.size) != 0 or r.taken == 2 * r.size)
    some = [r for r in rows if r.taken == max(x.taken for x in rows)]
    assert len(some) < len(rows) and sum(r.doc_id % 2 for r in some) > 0.75 * len(some), more


# --- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    votes = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, seed=42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles)) if shingles else 0


def brute_components(fps):
    """fps: (doc_id, fp)"""
    parent = {d: d for d, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d, _ in fps}


def test_simhash_against_brute_force(spark):
    rng = random.Random(6)
    docs = []
    for d in range(40):
        base = prose(rng, 120).split()
        for k in range(4):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(len(words))] = "changed"
            docs.append((d * 10 + k, " ".join(words)))
    docs += [x for x in ODD if x[0] is not None and x[0] != 905]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, docs)).collect()}
    fps = [(d, brute_fingerprint(t)) for d, t in docs]
    want = brute_components(fps)
    assert got == {d: (f"{fp:016x}", want[d]) for d, fp in fps}
    assert len(set(want.values())) < len(want)


def test_simhash_nulls_and_repeats(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "q r s t u"), (9, "q r s t u"), (7, "a b c d"), (None, "only here now")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {(None, 7), (7, 7), (9, 7), (None, None)}
    assert simhash.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_dense_entries_are_solved_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        x = base
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    monkeypatch.setattr(simhash, "BLOCK", 64)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    unsigned = lambda v: v % (1 << 64)
    assert all((unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 3 for r in found)
    linked = {x: x for x in fps}

    def root(x):
        while linked[x] != x:
            x = linked[x]
        return x

    for r in found:
        linked[root(unsigned(r.a))] = root(unsigned(r.b))
    order = sorted(fps)
    want = brute_components([(x, x) for x in order])
    groups = lambda f: {frozenset(x for x in order if f(x) == c) for c in {f(x) for x in order}}
    assert groups(root) == groups(want.get)


def test_components_of_long_chains(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(1000, 1300)] + [(5, x) for x in range(50, 150)] + [(3, 3), (None, 4)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in range(1000, 1301)} == {1000} and {got[x] for x in range(50, 150)} == {5} and 3 not in got and 4 not in got


# --- licences


def test_licences(spark):
    mit = next(t for k, t in licences.KNOWN if k == "MIT" and len(t) > 100)
    variants = [mit, mit.upper(), "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit.replace(",", " ,"), "\n".join("// " + x for x in mit.split("\n")), mit.replace("Software", "software").replace("\n\n", "\n")]
    bsd = next(t for k, t in licences.KNOWN if k == "BSD-3-Clause").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "(c) ")
    rows = [(i, v) for i, v in enumerate(variants)] + [(20, mit + " and more"), (21, bsd.replace("(c) ", "3) ")), (22, "Released under the MIT Licence!"), (23, "the licence of MIT"), *ODD]
    got = {(r.doc_id, r.license_id) for r in licences.scan(table(spark, rows)).collect()}
    assert {(i, "MIT") for i in range(5)} <= got
    assert {(20, None), (21, "BSD-3-Clause"), (22, None), (23, None), (900, None), (901, None), (None, None)} <= got
    assert licences.scan(table(spark, rows)).count() == len(rows)
    assert licences.scan(table(spark, []).limit(0)).count() == 0


def brute_canonical(text):
    """The form of the docstring, step by step over lines and words."""
    lines = []
    for line in re.split(r"\r\n|[\n\r]", text.lower()):
        bare = line.strip().lstrip("/*#;%!- \t")
        mark = bare.startswith(("©", "(c)")) or re.match(r"copyright\b(?=.{0,40}(?:\d{4}|©|\(c\)|<|\[))", bare)
        lines.append(" " if mark else line)
    # a mark may stand on a line of its own, so long as another line follows
    lines = [re.sub(r"\ball rights reserved\b", " ", x) + "\n" * (i + 1 < len(lines)) for i, x in enumerate(lines)]
    lines = [re.sub(r"^\s*(?:[*•-]|\(?[a-z0-9]{1,2}[.)])\s+", " ", x) for x in lines]
    x = re.sub(r"&(?:amp;)?", " and ", "\n".join(lines))
    words = " " + " ".join("".join(c if c.isalnum() else " " for c in x).split()) + " "
    for a, b in sorted(licences.SPELLINGS, key=lambda p: -len(p[0])):
        words = re.sub(f" {a}(?= )", f" {b}", words)
    return words.strip()


def test_licences_against_brute_force(spark):
    """Documents of the tables and variants of known licences: digests, and the licence of equal forms."""
    import hashlib

    rng = random.Random(41)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    known = [*licences.KNOWN, *itertools.islice(licences.headers(), 0, None, 25), *itertools.islice(licences.full_texts(), 0, None, 9)]
    for k, (_, t) in enumerate(known):
        kind = k % 4
        planted = t.upper() if kind == 0 else "Copyright (c) 1999 A B\nAll rights reserved\n" + t if kind == 1 else t.replace("license", "licence").replace(",", " ;") if kind == 2 else t + " " + rng.choice(WORDS)
        docs.append((10_000 + k, planted))
    digest = lambda t: hashlib.sha256(brute_canonical(t).encode()).hexdigest()
    table_ = {}
    for name, t in [*licences.KNOWN, *licences.headers(), *licences.full_texts()]:
        table_[digest(t)] = min(name, table_.get(digest(t), name))
    got = {r.doc_id: (r.digest, r.license_id) for r in licences.scan(table(spark, docs)).collect()}
    want = {d: (None, None) if t is None else (digest(t), table_.get(digest(t))) for d, t in docs}
    assert {d: x for d, x in got.items() if x != want[d]} == {}
    assert sum(x is not None for _, x in got.values()) > 0.6 * len(known)


def test_licence_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, licences.KNOWN[0][1], "x", "y", "z")], "doc_id long, text string, digest string, form string, untitled string")
    got = licences.scan(docs).first()
    assert got.license_id == licences.KNOWN[0][0] and len(got.digest) == 64


def test_whole_licence_texts_and_headers(spark):
    folder = Path(licences.__file__).parent / "licence_texts"
    texts = {f.stem: f.read_text() for f in folder.iterdir()}
    assert {"Apache-2.0", "GPL-1.0-only", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Artistic-1.0-Perl", "GFDL-1.3-only"} <= set(texts)
    header = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU {0} as published by\n    the Free Software Foundation, either version {1} of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU {0} for more details.\n\n    You should have received a copy of the GNU {0}\n    along with this program.  If not, see <https://www.gnu.org/licenses/>.\n"
    cases = [(k, t) for k, t in texts.items()] + [(k, t.upper().replace("\n", "\r\n")) for k, t in texts.items()]
    cases += [("GPL-2.0-only", texts["GPL-2.0-only"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"))]
    cases += [("GPL-3.0-only", texts["GPL-3.0-only"].split("How to Apply")[0]), ("Apache-2.0", texts["Apache-2.0"].split("APPENDIX:")[0])]
    cases += [("GPL-3.0-or-later", header.format("General Public License", 3)), ("GPL-2.0-or-later", "Copyright (C) 2001 Some One\n\n" + header.format("General Public License", 2)), ("AGPL-3.0-or-later", header.format("Affero General Public License", 3))]
    cases += [("LGPL-2.1-or-later", "".join(f" * {x.strip()}\n" for x in header.format("Lesser General Public License", "2.1").replace("program", "library").split("\n")))]
    cases += [(None, texts["GPL-3.0-only"] + " but not quite"), (None, texts["MPL-2.0"][:5000])]
    got = {r.doc_id: r.license_id for r in licences.scan(table(spark, [(i, t) for i, (_, t) in enumerate(cases)])).collect()}
    assert [(k, got[i]) for i, (k, _) in enumerate(cases) if got[i] != k] == []


# --- language model


def brute_scores(docs, learn):
    """The definition, over plain counters: base score, and the model's score without a filter's false answers."""
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for d, t in docs if learn(d) for w in tok(t))
    after = Counter(x for d, t in docs if learn(d) for x in zip([None, *tok(t)], tok(t)))  # noqa: B905
    n, v = sum(counts.values()), len(counts)

    def stands_for(c):
        return max((x for k in range(40) for x in (2**k, 3 * 2**k) if x <= c), default=0)

    out = []
    for d, t in docs:
        base = model = 0.0
        for a, b in zip([None, *tok(t)], tok(t)):  # noqa: B905
            p = (counts[b] + 1) / (n + v + 1)
            base += math.log10(p)
            trust = counts[a] / (counts[a] + bloom_lm.SMOOTHING)
            model += math.log10(trust * stands_for(after[a, b]) / max(1, counts[a]) + (1 - trust) * p)
        out.append((d, not learn(d), len(tok(t)), sum(w in counts for w in tok(t)), n, round(base, 6), round(model, 6)))
    return out


SCORED = [(d, f"rare{d % 9} " + " ".join(["w1", f"w{d % 5}", "w1 w2"] * (d % 40)) + f" only{d} UP{d % 3}") for d in range(80)]
SCORED += [(900, None), (901, ""), (None, "w1 w2 w3"), (905, "w1 w2"), (905, "w1 w2"), (906, "x " * 30_000), (907, "x y " * 9)]


@pytest.mark.parametrize(("buckets", "block"), [(None, bloom_lm.BLOCK_TOKENS), (3, 200), (40, 2000)])
def test_scores_against_brute_force(spark, buckets, block):
    """Whatever the buckets and blocks are; at 64 bits a key false answers are too rare to be met."""
    learn = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    got = bloom_lm.score(table(spark, SCORED), crc, buckets=buckets, block_tokens=block, bits_per_key=64).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == Counter(brute_scores(SCORED, learn))


def test_filter_moves_scores_little(spark):
    rng = random.Random(15)
    docs = table(spark, [(d, prose(rng, 60)) for d in range(300)])
    exact, usual = ({r.doc_id: r.score / r.n_tokens for r in bloom_lm.score(docs, F.col("doc_id") % 5 != 0, bits_per_key=bits).collect()} for bits in (64, bloom_lm.BITS_PER_KEY))
    assert np.mean([abs(exact[d] - usual[d]) for d in exact]) < 0.01


def test_probabilities_of_successors_add_up_to_one_at_most(spark):
    """Texts of one word after a context, for all words known and one that is not: P(text) / P(context) summed."""
    train = ["a b"] * 4 + ["a c"] * 4 + ["a d"] * 3 + ["b c a"] * 7
    words = ["a", "b", "c", "d", "unknown"]
    asked = ["a", "b", "c", *[f"{x} {y}" for x in "abc" for y in words]]
    docs = table(spark, [(i, t) for i, t in enumerate(train)] + [(100 + i, t) for i, t in enumerate(asked)])
    scored = {asked[r.doc_id - 100]: r for r in bloom_lm.score(docs, F.col("doc_id") < 100, bits_per_key=64).collect() if r.doc_id >= 100}
    counts = Counter(w for t in train for w in [*t.split(), None])
    after = Counter(x for t in train for x in zip([None, *t.split()], [*t.split(), None], strict=True))
    n, v = sum(counts.values()), len(counts)
    stands = lambda c: max((x for k in range(9) for x in (2**k, 3 * 2**k) if x <= c), default=0)
    step = lambda a, b: (lambda k: k * stands(after[a, b]) / max(1, counts[a]) + (1 - k) * (counts[b] + 1) / (n + v + 1))(counts[a] / (counts[a] + 5))
    for x in "abc":
        # the end of "x" is one of its successors; the ends of "x y" are successors of y
        share = {y: 10 ** (scored[f"{x} {y}"].score - scored[x].score) * step(x, None) / step(y, None) for y in words}
        assert sum(share.values()) + step(x, None) <= 1 + 1e-9
        assert share["unknown"] > 0


def test_model_beats_base_on_held_out_text(spark):
    rng = random.Random(10)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}

    def walk(n):
        w, out = rng.choice(WORDS), []
        for _ in range(n):
            out.append(w)
            w = rng.choice(follow[w])
        return " ".join(out)

    docs = table(spark, [(d, walk(100)) for d in range(300)])
    got = bloom_lm.score(docs, F.col("doc_id") % 5 != 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.7 * got[1] and got[0] < 0
    none = bloom_lm.score(docs, F.lit(False)).first()
    assert none.train_tokens == 0 and none.n_known == 0 and none.base_score == 0.0
    assert bloom_lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_filter_never_underestimates():
    rng = np.random.default_rng(11)
    h = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    c = rng.geometric(0.2, len(h))
    bucket = bloom_lm._bucket(h, 4).astype(int)
    f = bloom_lm.Filter({b: bloom_lm.build_segment(h[bucket == b], c[bucket == b]).tobytes() for b in range(4)}, 4)
    got, want = f.levels(h), bloom_lm.level(c)
    assert (got >= want).all() and (got > want).mean() < 0.15
    other = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert (f.levels(other) > 0).mean() < 0.15


def test_filter_error_rate():
    rng = np.random.default_rng(12)
    h = np.unique(rng.integers(0, 1 << 63, 200_000).astype(np.uint64))
    c = rng.geometric(0.5, len(h))
    f = bloom_lm.Filter({0: bloom_lm.build_segment(h, c).tobytes()}, 1)
    other = rng.integers(1 << 63, (1 << 64) - 1, 200_000, dtype=np.uint64)
    assert (f.levels(other) > 0).mean() < 0.004
    assert (f.levels(h) > bloom_lm.level(c)).mean() < 0.004


def test_large_counts_keep_their_level():
    c = np.array([1, 1 << 24, 3 << 24, 1 << 40], np.int64)
    h = bloom_lm._mix(np.arange(1, 5, dtype=np.uint64))
    got = bloom_lm.COUNT_OF_LEVEL[bloom_lm.Filter({0: bloom_lm.build_segment(h, c).tobytes()}, 1).levels(h)]
    assert (got > c * 0.7).all() and (got < c * 1.6).all()


# --- language identification


def test_language_held_out_accuracy(spark):
    rng = random.Random(12)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ei", "ung", "ö"], "cc": ["eau", "é", "tion", "oi"]}

    def text(lang):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30))

    rows = [(d, text(lang), lang) for d in range(240) for lang in [sorted(parts)[d // 3 % 3]]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!! 45", "cc"), (None, text("aa"), "aa"), (903, text("bb"), None), (904, text("cc") * 300, "cc")]
    docs = table(spark, rows)
    model = string_kernel.train(docs, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)))
    got = string_kernel.identify(docs.drop("lang", "source"), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (900, 901, 902)] == ["und"] * 3 and by[903] == "bb" and by[904] == "cc" and by[None] == "aa"
    held = [d for d in range(240) if d % 3 == 0]
    assert sum(by[d] == sorted(parts)[d // 3 % 3] for d in held) >= 0.95 * len(held)
    kept = string_kernel.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    nothing = string_kernel.train(docs, F.lit(False))
    assert {r.lang_pred for r in string_kernel.identify(docs, nothing).collect()} == {"und"}
    assert string_kernel.identify(docs.limit(0), model).count() == 0


def test_letters_are_letters(spark):
    model = string_kernel.Model(["xx"], np.zeros((string_kernel.SLOTS, 1), np.float32))
    rows = [(i, x) for i, x in enumerate(["²", "½", "Ⅷ", "①", "_", "7", "a", "é", "日", "²a"])]
    got = {r.doc_id: r.lang_pred for r in string_kernel.identify(table(spark, rows), model).collect()}
    assert [got[i] for i in range(10)] == ["und"] * 6 + ["xx"] * 4


def test_all_languages_are_learnt(spark):
    """More languages than texts the sample may hold, and a language of one text; ties go to the first in order."""
    names = [f"l{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(2)]
    rows = [(i, f"{n}{n} {n[::-1]}{n} " * 5, n) for i, n in enumerate(names)] + [(500, "common words here", "la"), (500, "common words here", "la")]
    model = string_kernel.train(table(spark, rows), F.lit(True), max_sample=10)
    assert model.langs == sorted({*names, "la"})
    got = string_kernel.identify(table(spark, rows), model).collect()
    assert sum(r.lang_pred == dict((i, n) for i, _, n in rows)[r.doc_id] for r in got) >= 0.95 * len(rows)
    tied = string_kernel.Model(["aa", "bb"], np.ones((string_kernel.SLOTS, 2), np.float32))
    assert tied.predict(["text"])[0] == ["aa"]


def test_places_stand_for_ngrams():
    """The kernel of the places is close to that of the n-grams themselves, and to the matrix's scores exactly."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 80))) for _ in range(40)]

    def grams(t):
        b = b" " + t.encode() + b" "
        return {b[i : i + n] for n in string_kernel.ORDERS for i in range(len(b) - n + 1)}

    for a, b in itertools.combinations(range(0, 40, 3), 2):
        exact = len(grams(texts[a]) & grams(texts[b])) / math.sqrt(len(grams(texts[a])) * len(grams(texts[b])))
        x, y = (set(string_kernel.ngrams(texts[k]).tolist()) for k in (a, b))
        assert abs(exact - len(x & y) / math.sqrt(len(x) * len(y))) < 0.03
    langs = ["p" if k % 2 else "q" for k in range(40)]
    model = string_kernel.fit([string_kernel.packed(string_kernel.ngrams(t)) for t in texts], langs, landmarks=40)
    places = [set(string_kernel.ngrams(t).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in places] for a in places])
    wanted = np.array([1.0 if x == "p" else -1.0 for x in langs])
    weigh = np.full(40, 0.5 / 20)
    alpha = np.linalg.solve(kernel.T @ (weigh[:, None] * kernel) + string_kernel.RIDGE * kernel + 1e-9 * np.eye(40), kernel.T @ (weigh * wanted))
    value = kernel @ alpha
    got = dict(zip(texts, zip(*model.predict(texts), strict=True), strict=True))
    for t, x in zip(texts, value, strict=True):
        assert (abs(x) < 1e-3 or got[t][0] == ("p" if x > 0 else "q")) and abs(got[t][1] - min(1, (abs(x) + 1) / 2)) < 1e-3


def test_language_of_documents_held_out(spark):
    """On the given documents: those held out get their own language nearly always."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = string_kernel.train(docs, ~held_out)
    got = string_kernel.identify(docs, model).join(docs.where(held_out & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}{3}")).select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.9 * n, (right, n)
