"""Hotspots, images, drawings, snapshots and sinks of the golden vectors."""

import base64
import json
import random
import re

import pytest
import vectors as V
from glyphlake import api, cli
from glyphlake.operators import diagnostics, scopes
from pyspark.sql import functions as F
from test_functions import read_png


@pytest.fixture(scope="module")
def all_files(files):
    return files(V.BINARY | {f"t_{k}": v.encode("latin-1") for k, v in V.TEXT.items()}).cache()


@pytest.fixture(scope="module")
def parsed(all_files):
    return api.elements(all_files).cache()


@pytest.fixture(scope="module")
def svgs(all_files, parsed):
    return {r.doc_id: r.svg for r in api.vector_svg(all_files, parsed).collect()}


def test_hotspots(all_files, parsed):
    got = {r.doc_id: r for r in api.hotspots(all_files, parsed).collect()}
    box = lambda k: (got[k].source_tag, got[k].name, got[k].x_min, got[k].y_min, got[k].x_max, got[k].y_max)
    assert box("hotspot_region") == ("PUMP-7", "INLET", 90, 40, 130, 75)
    assert box("hotspot_geometry") == ("SEAL_3", "SEAL_3", 4, 2, 15, 15)
    assert box("t_hotspot_text") == ("FLANGE", "GASKET", 3, 8, 21, 33)
    assert got["t_stray_quote"].name == "LEFT" and got["hotspot_region"].raw_region_hex.endswith("005a00280082004b")
    assert len(got) == 4


def test_nested_and_open_scopes(files):
    text = "ENDAPS; BEGAPS 'a'; POLYGON 0 0 4 4; BEGAPS 'b'; LINE 1 1 9 9; ENDAPS; BEGAPS 'c'; LINE 2 2 2 8; APD 'region' '1 1 1 1'; BEGAPS 'd'; TEXT 0 0 'x'; LINE 5 5 6 6; POLYGON 3 3;"
    got = [(r["index"], r.name, r.x_min, r.y_min, r.x_max, r.y_max) for r in api.hotspots(files({"n": text.encode()})).orderBy("index").collect()]
    # b closes first; then at the end d, c (which has no width) and a
    assert got == [(0, "b", 1, 1, 9, 9), (1, "d", 0, 0, 6, 6), (2, "a", 0, 0, 4, 4)]


def test_scopes_against_a_stack(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice([1, -1, 0, 0, 1, -1])) for d in range(60) for i in range(rng.randint(1, 40))]
    want, stacks = {}, {}
    for d, i, s in rows:
        stack = stacks.setdefault(d, [])
        if s > 0:
            stack.append(i)
        want[d, i] = stack[-1] if stack else None
        if s < 0 and stack:
            stack.pop()
    df = spark.createDataFrame(rows, "doc_id int, seq int, step int")
    assert {(r.doc_id, r.seq): r.owner for r in scopes.owners(df, F.col("step")).collect()} == want


def test_raw_images_and_tiles(all_files, parsed):
    got = {r.doc_id: r for r in api.raw_images(all_files, parsed).where("index = 0").collect()}
    assert (got["cell_array"].width, got["cell_array"].height, bytes(got["cell_array"].payload)) == (2, 3, b"PAYLOAD")
    assert got["short_padded"].width is None and bytes(got["short_padded"].payload) == b"abc"
    arrays = {r.doc_id: r for r in api.tile_arrays(all_files, parsed).collect()}
    assert len(arrays["t_two_color_tiles"].tiles) == 2 and arrays["t_two_color_tiles"].cols == 2
    assert arrays["t_tile_meta"].tiles[0].local_color_precision == 24 and arrays["t_tile_meta"].tiles[0].cell_representation_mode == 1
    assert arrays["t_bitonal_tile"].tiles[0].row_padding == 16 and arrays["t_index_tile"].tiles[0].family == "indexed"


def test_colors(all_files, parsed):
    assert {(r.color_index, r.r, r.g, r.b) for r in api.color_table(all_files, parsed).collect()} == {(2, 255, 0, 128), (3, 0, 128, 0)}
    assert {r.doc_id: r.color_extent for r in api.color_value_extent(all_files, parsed).collect()}["color_extent"] == [0, 0, 0, 4095, 4095, 4095]


def points(svg):
    return re.findall(r'points="([^"]*)"', svg)


def box(svg):
    return re.search(r'viewBox="([^"]*)"', svg)[1]


def pixels(svg):
    return [read_png(base64.b64decode(x)).tolist() for x in re.findall(r"base64,([^\"]*)\"", svg)]


def test_svg_vectors(svgs):
    assert len(svgs) == len(V.BINARY) + len(V.TEXT)
    assert points(svgs["poly_i16"]) == ["0.000,100.000 100.000,0.000"]
    assert points(svgs["poly_i32"]) == ["2500000.000,2600000.000 2600000.000,2500000.000"]
    assert points(svgs["poly_f32"]) == ["1.000,2.000 2.000,1.000"]
    assert "HELLO" in svgs["restricted"] and 'textLength="120.000"' in svgs["restricted"]
    assert '<clipPath id="cgmClip0">' in svgs["clip"] and 'clip-path="url(#cgmClip0)"' in svgs["clip"]
    assert points(svgs["t_line"]) == [] and box(svgs["t_line"]) == "0.000 0.000 100.000 100.000"
    assert 'fill="#ffffff"' in svgs["t_transparency"] and 'fill="#ffffff"' not in svgs["poly_f32"]
    assert svgs["empty"].startswith('<?xml version="1.0" encoding="UTF-8"?>\n<svg ') and svgs["empty"].endswith("</svg>\n")


def test_svg_rasters(svgs):
    assert pixels(svgs["rgb_cell"]) == [[[[255, 0, 0], [0, 255, 0]]]]
    assert box(svgs["t_index_tile"]) == "0.000 0.000 2.000 1.000" and pixels(svgs["t_index_tile"]) == [[[[0, 0, 0], [255, 255, 255]]]]
    assert box(svgs["t_two_color_tiles"]) == "0.000 0.000 8.000 2.000" and len(pixels(svgs["t_two_color_tiles"])) == 2
    assert pixels(svgs["t_scaled"]) == [[[[0, 0, 255], [255, 128, 255]]]]


def test_styles_and_kinds(files):
    from glyphlake.plans import synth  # noqa: F401

    el = lambda c, e, p: (c * 4096 + e * 32 + len(p) // 2).to_bytes(2, "big") + bytes.fromhex(p) + b"\0" * (len(p) // 2 % 2)
    i16 = lambda *v: "".join(f"{x & 0xFFFF:04x}" for x in v)
    doc = b"".join([el(1, 3, "0000"), el(1, 11, "0010"), el(5, 4, "02"), el(5, 3, "40400000"), el(4, 26, "0009" + i16(0, 0, 5, 5)), el(4, 11, i16(1, 2, 7, 9)), el(4, 12, i16(3, 3, 2)), el(4, 17, i16(0, 0, 3, 4, 0, 2)), el(4, 3, i16(8, 8)), el(4, 7, i16(0, 0, 1, 0, 1, 1)), el(4, 2, i16(0, 0, 1, 1, 2, 2, 3, 3)), el(4, 6, "0178"), el(4, 5, i16(1, 1) + "00000000" + "0161"), el(4, 6, "0162"), el(5, 34, "02ff0000"), el(5, 4, "05"), el(4, 1, i16(0, 0, 9, 9)), el(4, 13, i16(0, 0, 1, 1))])
    svg = api.vector_svg(files({"d": doc})).first().svg
    body = [x.strip() for x in svg.split("\n") if re.match(r" +<(polyline|polygon|circle|rect|ellipse|text)", x)]
    assert [re.match(r"<(\w+)", x)[1] for x in body] == ["polyline"] * 5 + ["polygon", "circle", "rect", "circle", "ellipse", "text"]
    # colours come from the final table, also for what was drawn before it; GDP lines come last, in the final style
    assert ['stroke="#ff0000"' in x for x in body[:5]] == [True, True, False, False, False] and 'stroke="#606060"' in body[4]
    assert points(body[4])[0].startswith("0.000,") and 'stroke-width="3.000"' in body[0]
    assert body[-1].endswith(">ab</text>") and 'r="2.000"' in body[6] and 'rx="5.000"' in body[9]


def test_diagnostics_of_element29(all_files, parsed):
    got = {r.doc_id: r for r in api.element29_analysis(all_files, parsed).collect()}
    r = got["restricted"]
    assert (r.length, r.ascii_ratio, r.entropy_bits_per_byte, r.restricted_text_detected) == (14, 0.5, 3.0931, True)
    assert [(x.byte, x["count"]) for x in r.top_bytes][:2] == [("0x00", 4), ("0x4c", 2)] and r.head_u16[:4] == [120, 20, 30, 40]
    assert [(x.offset, x.length, x.preview) for x in r.ascii_runs] == [(9, 5, "HELLO")]


def test_empty_payload_and_consensus(spark):
    r = diagnostics.analyze(spark.createDataFrame([(1, bytearray(b""))], "k int, payload binary"), ["k"]).first()
    assert (r.length, r.ascii_ratio, r.entropy_bits_per_byte, r.top_bytes, r.head_u16, r.likely_binary_payload) == (0, 0.0, 0.0, [], [], False)
    votes = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 3, 4), ("a", None, 4), ("b", 5, 5)], "doc_id string, w int, h int")
    got = {tuple(x) for x in diagnostics.consensus(votes, ["w", "h"]).collect()}
    assert got == {("a", 1, 2), ("b", 5, 5)}
    assert {x.doc_id for x in diagnostics.consensus(votes, ["w", "h"], min_count=2).collect()} == {"a"}
    assert {x.doc_id for x in diagnostics.consensus(votes, ["w", "h"], min_fraction=0.9).collect()} == {"b"}


def test_snapshot(all_files, parsed):
    got = {r.doc_id: json.loads(r.json) for r in api.data_json(all_files, parsed).collect()}
    s = got["hotspot_region"]
    assert list(s) == ["byte_length", "element_count", "element_histogram", "elements", "element29_analysis", "raw_images", "hotspots", "vector_svg"]
    assert s["byte_length"] == len(V.BINARY["hotspot_region"]) and s["element_count"] == 4
    assert s["element_histogram"][0] == {"class_id": 9, "element_id": 1, "count": 2}
    assert s["elements"][0] == {"offset": 0, "class_id": 0, "element_id": 21, "parameter_length": 9, "parameters_hex": "0650554d502d370000"}
    assert s["hotspots"][0]["name"] == "INLET" and s["raw_images"] == []
    assert got["short_padded"]["raw_images"][0]["width"] is None
    assert got["restricted"]["element29_analysis"][0]["decode_candidates"] == [] and got["empty"]["element_count"] == 0


def test_sinks_and_command(spark, files, tmp_path, capsys):
    for k in ("hotspot_region", "rgb_cell"):
        (tmp_path / f"{k}.cgm").write_bytes(V.BINARY[k])
    (tmp_path / "tiles.cgm").write_bytes(V.TEXT["two_color_tiles"].encode())
    assert cli.main([str(tmp_path), str(tmp_path / "out"), "--pattern", "*.cgm", "--debug"]) == 0
    names = sorted(p.rsplit("/", 1)[1] for p in capsys.readouterr().out.split())
    assert names == sorted(f"{s}{e}" for s in ("hotspot_region", "rgb_cell", "tiles") for e in ("_0000.svg", "_0000.hotspots.json", "_decode_report.json"))
    out = tmp_path / "out"
    assert json.loads((out / "hotspot_region_0000.hotspots.json").read_text())[0]["x_min"] == 90
    assert (out / "rgb_cell_0000.hotspots.json").read_text() == "[]\n"
    report = json.loads((out / "tiles_decode_report.json").read_text())
    assert report["arrays"][0]["tile_count"] == 2 and report["raw_image_count"] == 2 and report["source"].endswith("tiles.cgm")
    read = api.read_metafiles(spark, str(tmp_path))
    assert api.write_raw_images(read, str(out)).count() == 3 and (out / "rgb_cell_0000.bin").read_bytes() == bytes.fromhex("ff000000ff00")
    both = api.final_images_and_hotspots(read.where("doc_id like '%region%'")).first()
    assert both.hotspots[0].name == "INLET" and both.image.startswith("<?xml")
    (tmp_path / "bad.cgm").write_bytes(V.TRUNCATED)
    assert cli.main([str(tmp_path / "bad.cgm"), str(out)]) == 1 and "Error" in capsys.readouterr().err


def test_files_of_one_name_are_an_error(spark, tmp_path):
    from glyphlake.operators import sinks

    rows = spark.createDataFrame([("a/x.cgm", "one"), ("b/x.cgm", "two")], "doc_id string, svg string")
    with pytest.raises(Exception, match="several documents would be written as x_0000.svg"):
        sinks.write_files(sinks.svg_files(rows), str(tmp_path / "clash")).collect()
    assert [r.path for r in sinks.write_files(sinks.svg_files(rows.limit(1)), str(tmp_path / "one")).collect()] == [f"{tmp_path}/one/x_0000.svg"]


def test_files_are_read_by_their_tasks(spark, tmp_path):
    from glyphlake.operators import sinks

    contents = {"a b.svg": b"\x00\xff\n", "c%20d#e.svg": b"", "\u00e9.svg": bytes(9 << 20), "f.svg": b"last\n"}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "name string, content binary").coalesce(1)
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        paths = spark.createDataFrame([(r.path,) for r in sinks.write_files(rows, folder).collect()], "path string").coalesce(1)
        found = sinks.read_files(paths)
        assert found.inputFiles() == [] and {r.path.rpartition("/")[2]: bytes(r.content) for r in found.collect()} == contents
    gone = spark.createDataFrame([(f"{tmp_path}/plain/none.svg",)], "path string")
    with pytest.raises(Exception, match="none.svg"):
        sinks.read_files(gone).collect()
