"""Reading files into elements: golden vectors and random differential tests."""

import random
import re

import pytest
import vectors as V
from glyphlake.functions import text as T
from glyphlake.sources import files as S
from glyphlake.sources import framing
from glyphlake.sources.sniff import is_clear_text
from pyspark.sql import functions as F


def elements(files, spark_files):
    rows = S.elements(spark_files(files)).orderBy("doc_id", "seq").collect()
    out = {k: [] for k in files}
    for r in rows:
        out[r.doc_id].append((r.class_id, r.element_id, bytes(r.parameters).hex(), r.offset))
    return out


def test_binary_vectors(files):
    got = elements({k: V.BINARY[k] for k in ("short_padded", "empty", "semicolon", "long_form", "two_parts", "cell_array")}, files)
    assert got["short_padded"] == [(4, 9, "616263", 0)]
    assert got["empty"] == []
    assert got["semicolon"] == [(4, 9, "6162633b646566", 0)]
    assert got["long_form"] == [(2, 3, "68656c6c6f", 0)]
    assert got["two_parts"] == [(2, 3, "6162636465", 0)]
    assert got["cell_array"][0][2].endswith("5041594c4f4144")


def test_cut_files(files):
    table = files({"bad": V.BINARY["short_padded"] + V.TRUNCATED, "half": b"\x41", "good": V.BINARY["long_form"]})
    with pytest.raises(Exception, match="end"):
        S.elements(table).collect()
    kept = S.elements(table, mode="PERMISSIVE").groupBy("doc_id").count().collect()
    assert {tuple(r) for r in kept} == {("bad", 1), ("good", 1)}
    assert {r.doc_id for r in S.parse_errors(table).collect()} == {"bad", "half"}
    with pytest.raises(ValueError, match="mode"):
        framing.frame_files(table, "OTHER")


def test_text_vectors(files):
    got = elements({k: v.encode("latin-1") for k, v in V.TEXT.items()}, files)
    ids = lambda k: [(c, e) for c, e, _, _ in got[k]]
    assert ids("line") == [(4, 1), (4, 5)] and len(got["line"][0][2]) == 32
    tile = got["bitonal_tile"][0]
    assert tile[:2] == (4, 9) and tile[2] == "00" * 12 + "0002" + "0002" + "0010" + "0000" + "0123456789abcdeffedcba9876543210"
    assert got["direct_default"][0][2][32:36] == "0018"
    assert got["index_tile"][0][2][24:40] == "0002" + "0001" + "0008" + "0000"
    assert ids("primitives") == [(4, e) for e in (2, 3, 8, 11, 12, 13, 15, 17, 18, 10)]
    assert [(e, p) for _, e, p, _ in got["transparency"]] == [(4, "00"), (4, "01"), (4, "00")]
    assert [(e, p) for _, e, p, _ in got["clipping"]] == [(5, "00010002000b0016"), (6, "01"), (6, "00")]
    assert got["cell_text"][0][2].endswith("0002" + "0002" + "0008" + "0000" + "01020304")
    assert ids("stray_quote") == [(2, 6), (4, 1), (0, 21), (9, 1), (9, 1), (0, 22)]


CASES = [
    ("COLRTABLE 1 0 0.5 1 2 255 300;", [(5, 34, "010080ff02ffff")]),
    ("LINECOLR 7; LINECOLOUR 300;", [(5, 4, "07"), (5, 4, "ff")]),
    ("VDCEXT -5 0 70000 1.5;", [(2, 6, "00000000ffff0002")]),
    ("VDCEXT 1 2 3;", []),
    ("APD region 1 2 3 4;", [(9, 1, "06726567696f6e" + "08" + "0001000200030004")]),
    ("APD name (ZONE), B;", [(9, 1, "046e616d65" + "06" + "5a4f4e452042")]),
    ("APD alone;", []),
    ("BEGAPS; ENDAPS;", [(0, 21, "00"), (0, 22, "")]),
    ("CLIPIND; CLIPIND 0.4; CLIP 2;", [(3, 6, "00"), (3, 6, "01")]),
    ("CLIPIND true;", [(3, 6, "01")]),
    ("TEXT 1 2 'a' \"b c\";", [(4, 5, "3f80000040000000" + "03" + "622063")]),
    ("APPENDTEXT \"x\"; RESTRTEXT 1 2 3 4 'y';", [(4, 6, "0178"), (4, 29, "0001000200030004" + "0179")]),
    ("ARC3PT 0 0 5 10 10;", [(4, 13, "40400000" + "00000000" * 2 + "40a00000" + "41200000" * 2)]),
    ("line 1 2 3; CIRCLE .5 1;", [(4, 1, "3f80000040000000"), (4, 12, "40a000003f800000")][:1]),
    ("LINE 1e-46 1e39 0.1 -0;", [(4, 1, "000000007f8000003dcccccd80000000")]),
    ("LINE 1 \"2; 3\" 4", [(4, 1, "3f800000400000004040000040800000")]),
    ("BEGTILEARRAY 0 0 0 0 1 1 5 6; BITONALTILE 0 1; COLORTILE ABCD EF01; ENDTILEARRAY; BITONALTILE '' FF;", None),
]


def test_text_cases(files):
    got = elements({f"{i:02}": ("LINE;" + t).encode() for i, (t, _) in enumerate(CASES)}, files)
    for i, (text, want) in enumerate(CASES):
        if want is not None:
            assert [x[:3] for x in got[f"{i:02}"][1:]] == want, text
    tiles = got[f"{len(CASES) - 1:02}"][1:]
    # without a marker the command's own letters count as digits, and so do the numbers
    assert tiles[0][2][24:32] == "0005" + "0006" and tiles[0][2].endswith("bae01"[:4])
    assert tiles[-1][2] == "00" * 12 + "0001" + "0001" + "0001" + "0000" + "ff"


def plain_split(text):
    out, start, quote = [], 0, ""
    for i, ch in enumerate(text):
        if ch in "\"'":
            quote = "" if quote == ch else quote or ch
        elif ch == ";" and not quote:
            out.append((start, text[start:i].strip()))
            start = i + 1
    out.append((start, text[start:].strip()))
    return [x for x in out if x[1]]


def test_statements_against_a_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "LINE", " ", ";", '"', "'", "\n", "1", "\xa0", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {i: [] for i in range(len(texts))}
    for r in T.statements(rows, "i", F.col("t")).orderBy("i", "seq").collect():
        got[r.i].append((r.offset, r.statement))
    assert got == {i: plain_split(t) for i, t in enumerate(texts)}


def test_numbers_and_strings(spark):
    t = "ARC3PT -1.5 +2 3e2 .5 \"q 7\" 'r' 1.e5"
    r = spark.createDataFrame([(t,)], "t string").select(T.numbers(F.col("t")).alias("n"), T.strings(F.col("t")).alias("s")).first()
    assert r.n == [float(x) for x in re.findall(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", t)]
    assert r.s == ["q 7", "r"]


def test_sniff(spark):
    cases = {b"": False, None: False, b"LINE 0 0;": True, b"line 0;": True, b"LINE 0 0": False, b"nothing; here": False, b"\x00LINE;": False, b"LINE;\xe9": False, b"\x01" * 4 + b"LINE;": True, b"\x01" * 5 + b"LINE;": False, b" " * 600 + b"LINE;": False, b"x" * 490 + b"LINE;" + b"\xff" * 100: False}
    rows = spark.createDataFrame([(i, None if k is None else bytearray(k)) for i, k in enumerate(cases)], "i int, b binary")
    got = {r.i: r.x for r in rows.select("i", is_clear_text(F.col("b")).alias("x")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_files_and_stream(spark, tmp_path):
    from glyphlake.streaming.ingest import stream_elements

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.cgm").write_bytes(V.BINARY["poly_f32"])
    (tmp_path / "in" / "b.cgm").write_bytes(V.TEXT["line"].encode())
    (tmp_path / "in" / "c.txt").write_bytes(b"LINE;")
    found = S.read_metafiles(spark, str(tmp_path / "in"))
    assert S.elements(found).groupBy("doc_id").count().count() == 2
    assert [r.doc_id for r in S.sample_files(found, 1).collect()] == [r.doc_id for r in S.sample_files(found.repartition(3), 1).collect()]
    for _ in range(2):  # the second run finds no new files
        stream_elements(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == S.elements(found).count()
