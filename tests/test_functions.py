"""Column expressions and decoders against struct and small loops."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from glyphlake.functions import bytes as B
from glyphlake.functions import decoders as D
from glyphlake.functions import fax, images
from glyphlake.functions import text as T
from pyspark.sql import functions as F


def column(spark, values, expr, kind="binary"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers_from_bytes(spark):
    rng = random.Random(1)
    raw = [rng.randbytes(8) for _ in range(300)] + [struct.pack(">d", x) for x in (0.0, -0.0, 5e-324, 1e308, -1.5)] + [struct.pack(">ff", x, -x) for x in (0.0, 1e-45, 3.4e38, 1.17e-38)] + [b"\x7f\x80" + b"\0" * 6, b"\x7f\xf0" + b"\0" * 6, b"\1", b""]
    finite = lambda f: lambda b: (x if math.isfinite(x := struct.unpack(f, b)[0]) else None)
    for expr, n, want in ((lambda v: B.i16(v, 0), 2, lambda b: struct.unpack(">h", b)[0]), (lambda v: B.i32(v, 2), 6, lambda b: struct.unpack(">i", b[2:])[0]), (lambda v: B.u32(v, 0), 4, lambda b: struct.unpack(">I", b)[0]), (lambda v: B.f32(v, 0), 4, finite(">f")), (lambda v: B.f64(v, 0), 8, finite(">d"))):
        got = column(spark, [bytearray(r) for r in raw], expr)
        assert got == [want(r[:n]) if len(r) >= n else None for r in raw]


def test_numbers_to_bytes(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-44, 38) for _ in range(300)] + [0.0, 1.0, -2.0, 0.1, 16777217.0, 1e-45, 1.1754942e-38, 3.4028235e38]
    assert column(spark, values, B.hex_f32, "double") == [struct.pack(">f", v).hex().upper() for v in values]
    assert column(spark, values, B.hex_f64, "double") == [struct.pack(">d", v).hex().upper() for v in values]
    assert column(spark, [-1, 0, 300, 70000], lambda v: B.hex_unsigned(v, 2), "long") == ["0000", "0000", "012C", "FFFF"]
    assert column(spark, [-1, -300, 300], lambda v: B.hex_signed(v, 2), "long") == ["FFFF", "FED4", "012C"]


def test_points(spark):
    raw = [struct.pack(">4f", 1, 2, float("nan"), 3) + b"\1\2", b"\0" * 7, struct.pack(">hh", -5, 6)]
    assert [[tuple(p) for p in x] for x in column(spark, [bytearray(r) for r in raw], lambda v: B.points(v, "f32"))] == [[(1.0, 2.0)], [], []]
    assert [tuple(p) for p in column(spark, [bytearray(raw[2])], lambda v: B.points(v, "i16"))[0]] == [(-5.0, 6.0)]


def plain_text(b):
    for i, n in enumerate(b):
        if n and i + 1 + n == len(b) and all(32 <= x <= 126 for x in b[i + 1 :]):
            return b[i + 1 :].decode()
    return None


def test_text_decoders(spark):
    rng = random.Random(3)
    raw = [b"\x05HELLO", b"\x00\x02ab", b"\x01\x01a", b"\x03ab", b"", b"\x00", b"\x02a\x07", b"x" * 300 + b"\x03abc"] + [bytes(rng.choice([0, 1, 2, 3, 5, 65, 32, 97]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    assert column(spark, [bytearray(r) for r in raw], D.cgm_text) == [plain_text(r) for r in raw]
    assert column(spark, [bytearray(x) for x in (b"\x03abc--", b"\x00", b"\x05ab", b"\x01\x01", b"")], D.prefixed_ascii) == ["abc", None, None, None, None]
    got = column(spark, [bytearray(x) for x in (b"\x01k\x02vw", b"\x01k\x00\x02vw", b"\x01k\x07vw", b"\x02k", b"\x01\x01v", b"\x04name\x00")], D.application_property)
    assert [None if x is None else (x.key, bytes(x.value)) for x in got] == [("k", b"vw"), ("k", b"vw"), ("k", b"\x07vw"), None, None, ("name", b"")]


def test_boxes_and_flags(spark):
    h = lambda *v: bytearray(struct.pack(f">{len(v)}h", *v))
    got = column(spark, [h(0, 0, 10, 20), h(10, 20, 0, -5), h(1, 0, 1, 5), bytearray(struct.pack(">4f", 0.5, 0.5, 2, 3)), bytearray(struct.pack(">4f", 1, 1, 1, 3)), bytearray(b"\x00" * 7)], D.vdc_extent)
    assert [None if x is None else tuple(x) for x in got][:4] == [(0, 0, 10, 20), (0, -5, 10, 20), None, (0.5, 0.5, 2, 3)]
    assert got[5] is None
    assert column(spark, [h(0, 0, 1, 1), h(5, 5, 5, 9), bytearray(b"\0")], lambda v: D.region_box(v).isNotNull()) == [True, False, False]
    assert column(spark, [bytearray(x) for x in (b"\0\1", b"\0\0\1", b"\1", b"\0", b"")], D.flag) == [True, False, True, False, None]


def test_color_tables_and_palette(spark):
    got = column(spark, [bytearray.fromhex("0002ffff00008000"), bytearray.fromhex("05010203"), bytearray(b"\0\1")], D.color_table)
    last = [{r.color_index: (r.r, r.g, r.b) for r in sorted(x, key=lambda r: r.layout)} for x in got]
    assert last == [{2: (255, 0, 128), 3: (0, 128, 0)}, {5: (1, 2, 3)}, {}]
    assert column(spark, [0, 1, 7, 8, 300, -4], lambda v: D.color_hex(D.default_color(v)), "int") == ["#000000", "#ffffff", "#a0a0a0", "#080808", "#ffffff", "#000000"]


def test_restricted_text_and_sizes(spark):
    two, four = struct.pack(">4H", 120, 20, 30, 40) + b"\x05HELLO", struct.pack(">4i", 120, 20, -30, 40) + b"\x02ab"
    got = column(spark, [bytearray(x) for x in (two, four, struct.pack(">4H", 0, 20, 30, 40) + b"\x01a", b"\0" * 9)], D.restricted_text)
    assert [None if x is None else tuple(x) for x in got] == [(30, 40, 120, 20, "HELLO"), (-30, 40, 120, 20, "ab"), None, None]
    r = spark.range(1).select(D.tile_grid(F.lit(6), F.lit(300), F.lit(200)).alias("a"), D.tile_grid(F.lit(1), F.lit(1), F.lit(9)).alias("b"), D.tile_grid(F.lit(4), F.lit(1), F.lit(0)).alias("c"), D.to_int(F.lit(" 7 ")).alias("d"), D.to_int(F.lit("x"), 3).alias("e")).first()
    assert tuple(r.a) == (3, 2) and tuple(r.b) == (1, 1) and tuple(r.c) == (2, 2) and (r.d, r.e) == (7, 3)


def test_shown_numbers(spark):
    values = [0.5, 1.0625, 2.0005, -3.14159, 1e6 / 3, 123456789.98765]
    assert column(spark, values, T.fixed3, "double") == [f"{v:.3f}" for v in values]
    assert column(spark, [0.5, 1.5, 2.5, -0.5], T.rounded, "double") == [0, 2, 2, 0]
    assert column(spark, ["a<b>&\"'"], T.escaped, "string") == ["a&lt;b&gt;&amp;&quot;&#x27;"]


# --- fax and images


def test_codes_are_prefix_free():
    for table in fax.RUNS:
        codes = sorted([*table, fax.END_OF_LINE[:11]])
        assert len(table) == 64 + 27 + 13
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))
    assert sum(2.0 ** -len(c) for c in fax.MODES) < 1


@pytest.mark.parametrize("width", [1, 7, 64, 200, 2700])
def test_fax_round_trip(width):
    rng = np.random.default_rng(width)
    for share in (0.0, 0.1, 0.5, 1.0):
        runs = (rng.random((6, width)) < share).astype(np.uint8)
        slow = np.repeat(runs, 3, axis=1)[:, :width] if width > 3 else runs
        for bits in (runs, slow):
            assert (fax.decode_t6(fax.encode_t6(bits), width, 6) == bits).all()
            for eol in (False, True):
                assert (fax.decode_t4(fax.encode_t4(bits, eol), width, 6) == bits).all()


def test_fax_by_hand():
    pack = lambda s: np.packbits([int(c) for c in s.ljust(-(-len(s) // 8) * 8, "0")]).tobytes()
    # white 2, black 3, white 3; then the same line by vertical modes
    assert fax.decode_t4(pack("0111" + "10" + "1000"), 8, 1).tolist() == [[0, 0, 1, 1, 1, 0, 0, 0]]
    two = fax.decode_t6(pack("001" + "0111" + "10" + "1" + "111"), 8, 2)
    assert two.tolist() == [[0, 0, 1, 1, 1, 0, 0, 0]] * 2
    with pytest.raises(fax.FaxError):
        fax.decode_t4(b"\x00", 8, 1)
    assert not fax.decode_t6(pack(fax.END_OF_LINE * 2), 8, 3).any()


def read_png(data):
    at, idat, plte = 8, b"", b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        if kind == b"IHDR":
            width, height, _, color = struct.unpack(">IIBB", body[:10])
        idat, plte = idat + body * (kind == b"IDAT"), plte + body * (kind == b"PLTE")
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, -1)[:, 1:].reshape(height, width, channels)
    return np.frombuffer(plte, np.uint8).reshape(-1, 3)[rows[:, :, 0]] if color == 3 else rows


def test_image_ladders():
    cell = lambda p, w, h, b, m=0, pal=None, ext=None: images.cell_image(p, w, h, b, m, pal, ext)
    assert cell(bytes(4), 2, 2, 8).mode == "P" and cell(bytes(4), 2, 2, 8, 2).mode == "L"
    assert cell(bytes(16), 2, 2, 32).mode == "RGBA" and cell(bytes(12), 2, 2, 24).mode == "RGB"
    assert cell(bytes(12), 2, 2, 9).mode == "RGB"
    assert cell(b"\0\1\1\0", 2, 2, 99).pixels.tolist() == [[255, 0], [0, 255]]
    assert cell(b"\0\2\1\0", 2, 2, 99).pixels.tolist() == [[0, 2], [1, 0]]
    assert cell(b"\x80\x40", 2, 2, 99).pixels.tolist() == [[0, 255], [255, 0]]
    assert cell(b"", 2, 2, 8) is None and cell(bytes(9), None, 2, 8) is None
    rgb = cell(bytes.fromhex("000004000c000c000800ffff"), 2, 1, 16, 0, None, [1024] * 3 + [3072] * 3)
    assert rgb.pixels.tolist() == [[[0, 0, 255], [255, 128, 255]]]
    assert images.scale16(bytes.fromhex("000100050009"), 1, [5, 5, 5, 5, 5, 5]) == bytes([0, 0, 255])
    tile = lambda p, **k: images.tile_image(p, 2, 2, **({"compression": None, "bit_order": None, "row_padding": None, "family": None, "precision": None, "mode": None, "palette": None, "extent": None} | k))
    assert tile(bytes(4), family="indexed").mode == "P" and tile(bytes(8)).mode == "L"
    assert tile(b"\x80\x40", compression=0).pixels.tolist() == [[0, 255], [255, 0]]
    assert tile(b"\x01\x02", compression=0, bit_order=1).pixels.tolist() == [[0, 255], [255, 0]]
    bits = np.array([[1, 0], [0, 1]], np.uint8)
    assert tile(fax.encode_t6(bits), compression=2).pixels.tolist() == [[0, 255], [255, 0]]
    assert tile(fax.encode_t4(bits), compression=1).pixels.tolist() == [[0, 255], [255, 0]]
    padded = np.array([[1, 0, 0], [0, 1, 0]], np.uint8)
    assert tile(fax.encode_t6(padded), compression=2, row_padding=1).pixels.tolist() == [[0, 255], [255, 0]]
    assert images.raster_image(b"\x80\x40", 2, 2, 6, 0, 8, 6).pixels.tolist() == [[0, 255], [255, 0]]
    assert images.raster_image(b"\x80\x40", 2, 2, 3, 0, 0, 0) is None


def test_png_round_trip():
    rng = np.random.default_rng(5)
    for mode, shape in (("L", (3, 5)), ("RGB", (3, 5, 3)), ("RGBA", (3, 5, 4))):
        px = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (read_png(images.png(images.Image(mode, px))).reshape(shape) == px).all()
    pal = rng.integers(0, 256, 768, dtype=np.uint8)
    px = rng.integers(0, 256, (3, 5), dtype=np.uint8)
    assert (read_png(images.png(images.Image("P", px, pal.tobytes()))) == pal.reshape(-1, 3)[px]).all()
    assert images.Image("L", px).crop(2, 1).size == (2, 1)
