"""Queries over single elements: each kind of statement as bytes, tiles as cells, states, palettes, rasters, whole drawings."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake import api
from glyphlake.functions import decoders as D
from glyphlake.functions.bytes import hex_f32, hex_unsigned
from glyphlake.operators import diagnostics, raster, sinks, state, tiles
from glyphlake.plans.synth import binary_files, table, text_files
from glyphlake.sources import cleartext, files
from glyphlake.sources.work import dealt, materialize, work_dir

# --- SQL for bytes


def _f32(x: str) -> str:
    """Hexadecimal digits of a number as a single."""
    power = f"floor(log2(abs({x})))"
    return f"CASE WHEN {x} = 0 THEN '00000000' ELSE printf('%08x', CAST((CASE WHEN {x} < 0 THEN 2147483648 ELSE 0 END) + ({power} + 127) * 8388608 + round((abs({x}) / pow(2, {power}) - 1) * 8388608) AS BIGINT)) END"


def _u(x: str, n: int) -> str:
    return f"printf('%0{2 * n}x', CAST({x} AS BIGINT))"


def _counted(s: str) -> str:
    return f"{_u(f'strlen({s})', 1)} || lower(hex({s}))"


def _joined(*parts: str) -> str:
    return " || ".join(f"({p})" for p in parts) if parts else "''"


# --- clear text: a statement of each kind, and its bytes

_COMPONENT = "CASE WHEN {0} BETWEEN 0 AND 1 THEN {0} * 255 ELSE {0} END"


def _floats(names: str) -> str:
    return _joined(*[_f32(x) for x in names.split()])


def _shorts(names: str) -> str:
    return _joined(*[_u(x, 2) for x in names.split()])


#: Statements (a, b, c, m and s are columns), their class and id, and their bytes in SQL; none for those that are dropped.
_STATEMENTS = (
    ("LINE a b c a", 4, 1, _floats("a b c a")),
    ("DISJTLINE a b c a", 4, 2, _floats("a b c a")),
    ("MARKER a b", 4, 3, _floats("a b")),
    ("POLYGON a b c a b c", 4, 7, _floats("a b c a b c")),
    ("POLYGONSET a b c a b", 4, 8, _floats("a b c a")),
    ("VDCEXT a b c a", 2, 6, _shorts("a b c a")),
    ("COLRVALUEEXT a b c a b c", 1, 10, _shorts("a b c a b c")),
    ("CLIPRECT a b c a", 3, 5, _shorts("a b c a")),
    ("CLIPIND ON", 3, 6, "'01'"),
    ("TRANSPARENCY OFF", 3, 4, "'00'"),
    ("TRANSPMODE m", 3, 4, _u("m", 1)),
    ('TEXT a b FINAL "s"', 4, 5, _joined(_f32("a"), _f32("b"), _counted("s"))),
    ('APPENDTEXT FINAL "s"', 4, 6, _counted("s")),
    ('RESTRTEXT a b c a FINAL "s"', 4, 29, _joined(_shorts("a b c a"), _counted("s"))),
    ("RECT a b c a", 4, 11, _floats("a b c a")),
    ("CIRCLE a b c", 4, 12, _floats("a b c")),
    # the digit of the command is a number of its statement
    ("ARC3PT a b c a b c", 4, 13, _floats("3 a b c a b")),
    ("ARC3PTCLOSE a b c a b c", 4, 14, _floats("3 a b c a b")),
    ("ARCCTR a b c a b c", 4, 15, _floats("a b c a b c")),
    ("ARCCTRCLOSE a b c a b c", 4, 16, _floats("a b c a b c")),
    ("ELLIPSE a b c a b c", 4, 17, _floats("a b c a b c")),
    ("ELLIPARC a b c a b c a b c a", 4, 18, _floats("a b c a b c a b c a")),
    ("ELLIPARCCLOSE a b c a b c a b c b", 4, 19, _floats("a b c a b c a b c b")),
    ("GDP a b c", 4, 10, _floats("a b c")),
    ("CELLARRAY 0 0 1 0 0 1 2 1 8 b c", 4, 9, _joined("'0000000000010000000000010002000100080000'", _u("b", 1), _u("c", 1))),
    ("LINECOLR b", 5, 4, _u("b", 1)),
    ("COLRTABLE b c a 0.2", 5, 34, _joined(_u("b", 1), _u(_COMPONENT.format("c"), 1), _u(_COMPONENT.format("a"), 1), "'33'")),
    ('BEGAPS "s"', 0, 21, _counted("s")),
    ("ENDAPS", 0, 22, "''"),
    ('APD "KEY" "s"', 9, 1, _joined("'036b6579'", _counted("s"))),
    ('APD "region" "a b c a"', 9, 1, _joined("'06726567696f6e08'", _shorts("a b c a"))),
    ('METAFILEDESC "s"', None, None, None),
    # a quote where a command begins is a blank
    ('"LINE c b', 4, 1, _floats("c b")),
)


def _said(statement: str) -> Column:
    out: list[Column] = []
    for x in statement.split(" "):
        bare = x.strip('"')
        value = F.col(bare).cast("string") if bare in ("a", "b", "c", "m", "s") else F.lit(bare)
        marks = [F.lit('"') if x.startswith('"') else None, value, F.lit('"') if x.endswith('"') and len(x) > 1 else None]
        out.append(F.concat(*[m for m in marks if m is not None]))
    return F.concat_ws(" ", *out)


def statement_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements of each kind in clear text, one kind an order, and the bytes they become."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key, (F.col("o_custkey") % 50).alias("doc"), (F.col("o_custkey") % 97 + 1).alias("a"), (key % 89).alias("b"), (key * 7 % 250).alias("c"), (key % 2).alias("m"), F.col("o_orderpriority").alias("s"))
    kind = F.col("o_orderkey") % len(_STATEMENTS)
    said = reduce(lambda c, i: c.when(kind == i, _said(_STATEMENTS[i][0])), range(1, len(_STATEMENTS)), F.when(kind == 0, _said(_STATEMENTS[0][0])))
    found = cleartext.elements(text_files(rows, F.col("doc"), F.col("o_orderkey"), said))
    return found.select(F.col("doc_id").cast("long").alias("doc"), "seq", F.col("class_id").cast("long").alias("class_id"), F.col("element_id").cast("long").alias("element_id"), F.lower(F.hex("parameters")).alias("bytes"))


_STATEMENT_CASES = " ".join(f"WHEN {i} THEN {{class_id: {c}, element_id: {e}, bytes: {b}}}" for i, (_, c, e, b) in enumerate(_STATEMENTS) if c is not None)
_STATEMENT_SQL = f"""
    WITH o AS (SELECT o_orderkey AS k, o_custkey % 50 AS doc, o_custkey % 97 + 1 AS a, o_orderkey % 89 AS b, o_orderkey * 7 % 250 AS c, o_orderkey % 2 AS m, o_orderpriority AS s FROM orders),
    e AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY k) - 1 AS BIGINT) AS seq, CASE k % {len(_STATEMENTS)} {_STATEMENT_CASES} END AS e FROM o)
    SELECT doc, seq, CAST(e.class_id AS BIGINT) AS class_id, CAST(e.element_id AS BIGINT) AS element_id, e.bytes AS bytes FROM e WHERE e IS NOT NULL"""


def tiles_as_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in clear text as cell arrays: the size of the array around them, or none after its end."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lower(F.lpad(F.hex(F.col("p_partkey") % 65536), 4, "0")).alias("h"))
    odd = F.col("p_partkey") % 2
    begin = F.when(odd == 0, F.concat(F.lit("BEGTILEARRAY 0 0 0 0 2 3 4 5 0 0 0 0 "), F.col("p_size").cast("string"), F.lit(" 3"))).otherwise("BEGTILEARRAY 0 0 0 0 2 3 5 7")
    parts = [begin, F.concat(F.lit("COLORTILE 0 8 0 0 "), odd.cast("string"), F.lit(" '' "), F.col("h")), F.concat(F.lit("BITONALTILE '' 0"), F.col("h"), F.lit("1")), F.lit("ENDTILEARRAY"), F.concat(F.lit("INDEXCOLORTILE '' "), F.col("h"))]
    each = rows.select("p_partkey", F.posexplode(F.array(*parts)).alias("j", "s"))
    found = cleartext.elements(text_files(each, F.col("p_partkey") % 30, F.struct("p_partkey", "j"), F.col("s")))
    return found.select(F.col("doc_id").cast("long").alias("doc"), "seq", F.lower(F.hex("parameters")).alias("bytes"))


_TILES_AS_CELLS_SQL = """
    WITH p AS (SELECT p_partkey AS k, p_partkey % 30 AS doc, p_size, printf('%04x', p_partkey % 65536) AS h, unnest(range(0, 5)) AS j FROM part),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY k, j) - 1 AS BIGINT) AS seq, CASE WHEN k % 2 = 0 THEN printf('%04x0003', CAST(p_size AS BIGINT)) ELSE '00050007' END AS size FROM p)
    SELECT doc, seq, repeat('00', 12) || CASE j WHEN 1 THEN size || '0008' || printf('%04x', k % 2) || h WHEN 2 THEN size || '00010000' || '0' || h || '1' ELSE '00010001' || '00080000' || h END AS bytes
    FROM n WHERE j IN (1, 2, 4)"""


# --- states


def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events set extents, clipping, transparency and colour extents of their user's document; the last of each counts."""
    kind, i = F.col("event_type"), F.col("event_id")
    box = F.concat(*[hex_unsigned(i * m % 5000 + p, 2) for m, p in ((1, 0), (3, 1), (5, 2), (7, 3))])
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id",
        F.when(kind == "error", 2).when(kind == "signup", 1).otherwise(3).alias("c"),
        F.when(kind == "error", 6).when(kind == "signup", 10).when(kind == "view", 4).when(kind == "purchase", 5).otherwise(6).alias("e"),
        F.when(kind.isin("error", "purchase"), box).when(kind == "signup", F.concat(box, hex_unsigned(i % 300, 2), F.lit("00ff"))).when(kind == "view", hex_unsigned(i % 2, 1)).otherwise(hex_unsigned(i % 3, 2)).alias("h"),
    )
    made = materialize(files.framing.frame_files(binary_files(rows, F.col("user_id"), F.col("event_id"), F.col("c"), F.col("e"), F.col("h"))), "elements")
    both = state.drawing_state(made).join(state.color_value_extent(made), "doc_id", "full")
    said = lambda x: F.coalesce(F.concat_ws(",", *[F.col(f"{x}.{k}").cast("long").cast("string") for k in ("x_min", "y_min", "x_max", "y_max")]), F.lit(""))
    colors = F.coalesce(F.array_join(F.col("color_extent").cast("array<string>"), ","), F.lit(""))
    return both.select(F.col("doc_id").cast("long").alias("user_id"), F.when(F.col("extent").isNull(), "").otherwise(said("extent")).alias("extent"), F.when(F.col("clip").isNull(), "").otherwise(said("clip")).alias("clip"), F.coalesce("transparent", F.lit(True)).alias("transparent"), F.coalesce("clipping", F.lit(False)).alias("clipping"), colors.alias("color_extent"))


_STATES_SQL = """
    WITH b AS (SELECT *, [event_id % 5000, event_id * 3 % 5000 + 1, event_id * 5 % 5000 + 2, event_id * 7 % 5000 + 3] AS v FROM events),
    s AS (SELECT *, least(v[1], v[3]) || ',' || least(v[2], v[4]) || ',' || greatest(v[1], v[3]) || ',' || greatest(v[2], v[4]) AS box, array_to_string(v, ',') || ',' || event_id % 300 || ',255' AS six FROM b)
    SELECT user_id, coalesce(arg_max(box, event_id) FILTER (event_type = 'error'), '') AS extent, coalesce(arg_max(box, event_id) FILTER (event_type = 'purchase'), '') AS clip,
      coalesce(arg_max(event_id % 2 <> 0, event_id) FILTER (event_type = 'view'), TRUE) AS transparent, coalesce(arg_max(event_id % 3 <> 0, event_id) FILTER (event_type = 'click'), FALSE) AS clipping,
      coalesce(arg_max(six, event_id) FILTER (event_type = 'signup'), '') AS color_extent
    FROM s GROUP BY user_id"""


def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of 256 colours: what customers set, the default for the others."""
    entry = F.concat(hex_unsigned(F.col("c_custkey") % 256, 1), *[hex_unsigned(F.col("c_custkey") * k % 256, 1) for k in (3, 5, 7)])
    made = binary_files(table(spark, sf_dir, "customer"), F.col("c_custkey") % 40, F.col("c_custkey"), F.lit(5), F.lit(34), entry)
    found = state.palette_bytes(files.framing.frame_files(made))
    return found.select(F.col("doc_id").cast("long").alias("doc"), F.lower(F.hex("palette")).alias("palette"))


_DEFAULT_SQL = "CASE WHEN i = 0 OR i = 2 THEN 0 WHEN i = 1 THEN 255 WHEN i = 3 THEN 47 WHEN i = 4 THEN 64 WHEN i = 5 THEN 96 WHEN i = 6 THEN 128 WHEN i = 7 THEN 160 ELSE i END"
_PALETTES_SQL = f"""
    WITH s AS (SELECT c_custkey % 40 AS doc, c_custkey % 256 AS i, max(c_custkey) AS k FROM customer GROUP BY ALL),
    a AS (SELECT DISTINCT doc, i FROM (SELECT doc FROM s), range(0, 256) AS r(i)),
    c AS (SELECT a.doc, a.i, CASE WHEN k IS NULL THEN repeat(printf('%02x', d), 3) ELSE printf('%02x%02x%02x', k * 3 % 256, k * 5 % 256, k * 7 % 256) END AS h
      FROM (SELECT doc, i, CAST({_DEFAULT_SQL} AS BIGINT) AS d FROM a) a LEFT JOIN s USING (doc, i))
    SELECT doc, string_agg(h, '' ORDER BY i) AS palette FROM c GROUP BY doc"""


def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent priority and status of a customer's orders, where half of them agree."""
    rows = table(spark, sf_dir, "orders")
    return diagnostics.consensus(rows, ["o_orderpriority", "o_orderstatus"], "o_custkey", min_count=2, min_fraction=0.3)


def tolerant_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", D.to_int(said, 7).cast("long").alias("n"))


# --- whole drawings

_KINDS = "a AS (SELECT p_partkey AS k, p_size AS a, p_partkey % 40 AS b FROM part)"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as drawings of every kind of primitive, with styles, colours, clipping and a background."""
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    f = lambda *xs: F.concat(*[hex_f32((F.lit(x) if isinstance(x, int | float) else x).cast("double")) for x in xs])
    u = lambda *xs: F.concat(*[hex_unsigned(F.lit(x) if isinstance(x, int) else x, 2) for x in xs])
    counted = lambda s: F.concat(hex_unsigned(F.length(s), 1), F.hex(s))
    said = F.concat(F.lit("P"), k.cast("string"), F.lit(" <&>"))
    listed = [
        (1, 3, F.lit("0001")), (1, 12, F.lit("0020")), (2, 6, u(0, 0, 100, 100)), (3, 5, u(1, 2, a + 1, a + 2)), (3, 6, F.when(k % 3 == 0, "01").otherwise("00")), (3, 4, F.when(k % 4 == 0, "00").otherwise("01")),
        (5, 34, F.concat(F.lit("05"), hex_unsigned(a, 1), hex_unsigned(b, 1), F.lit("07"))), (5, 4, F.lit("05")), (5, 3, f(2)), (5, 15, f(12)),
        (4, 7, f(0, 0, 100, 0, 100, 100, 0, 100)), (4, 1, f(1, 2, a, b)), (4, 2, f(1, 1, 2, 2, 3, 3, a, 4)), (4, 3, f(a, b, b, a)), (4, 11, f(a, b, 10, 20)), (4, 12, f(50, 50, a)), (4, 17, f(50, 50, F.lit(50) + a, 50, 50, 55)),
        (4, 5, F.concat(f(a, b), counted(said))), (4, 6, counted(F.lit(" more"))), (5, 4, F.lit("c8")), (4, 29, F.concat(u(30, 9, a, b), counted(F.lit("R")))), (4, 1, f(1000, 1000, a, 1)), (4, 10, f(1, 2, 3, a)), (5, 3, f(3)), (5, 3, f(-1)),
    ]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 40).alias("b"))
    each = dealt(rows, "doc_id").select("doc_id", F.posexplode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("e"), h.alias("h")) for c, e, h in listed])).alias("j", "x"))
    return binary_files(each, F.col("doc_id"), F.col("j"), F.col("x.c"), F.col("x.e"), F.col("x.h"))


def drawing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of every kind of primitive, written as files: what the files hold."""
    folder = _folder(spark, "drawings")
    made = materialize(_mixed(spark, sf_dir), "files")
    return _read_back(api.write_vector_svg(made, folder, files.framing.frame_files(made)))


def _drawing_sql() -> str:
    own, grey = "printf('#%02x%02x07', a, b)", "'#c8c8c8'"
    n = lambda x: f"printf('%.3f', CAST({x} AS DOUBLE))"
    y = lambda x: n(f"100 - ({x})")
    pts = lambda *xy: " || ' ' || ".join(f"{n(p)} || ',' || {y(q)}" for p, q in zip(xy[::2], xy[1::2], strict=True))
    stroke = lambda c, w: f"' stroke=\"' || {c} || '\" stroke-width=\"{w}.000\"'"
    line = lambda xy, c, w: f"'    <polyline points=\"' || {pts(*xy)} || '\"' || {stroke(c, w)} || ' />'"
    clip = "CASE WHEN k % 3 = 0 THEN ' clip-path=\"url(#cgmClip0)\"' ELSE '' END"
    lines = [
        line(("1", "2", "a", "b"), own, 2), line(("1", "1", "2", "2"), own, 2), line(("3", "3", "a", "4"), own, 2), line(("1000", "1000", "a", "1"), grey, 2), line(("1", "2", "3", "a"), grey, 3),
        f"'    <polygon points=\"' || {pts('0', '0', '100', '0', '100', '100', '0', '100')} || '\"' || {stroke(own, 2)} || ' fill=\"none\" />'",
        *[f"'    <circle cx=\"' || {n(p)} || '\" cy=\"' || {y(q)} || '\" r=\"2.000\" fill=\"' || {own} || '\" stroke=\"none\" />'" for p, q in (("a", "b"), ("b", "a"))],
        f"'    <rect x=\"' || {n('least(a, 10)')} || '\" y=\"' || {y('greatest(b, 20)')} || '\" width=\"' || {n('abs(a - 10)')} || '\" height=\"' || {n('abs(b - 20)')} || '\"' || {stroke(own, 2)} || ' fill=\"none\" />'",
        f"'    <circle cx=\"50.000\" cy=\"50.000\" r=\"' || {n('a')} || '\"' || {stroke(own, 2)} || ' fill=\"none\" />'",
        f"'    <ellipse cx=\"50.000\" cy=\"50.000\" rx=\"' || {n('a')} || '\" ry=\"5.000\"' || {stroke(own, 2)} || ' fill=\"none\" />'",
        "'  </g>'",
        f"'  <text x=\"' || {n('a')} || '\" y=\"' || {y('b')} || '\" fill=\"' || {own} || '\" font-size=\"12.000\" font-family=\"sans-serif\"' || {clip} || '>P' || k || ' &lt;&amp;&gt; more</text>'",
        f"'  <text x=\"' || {n('a')} || '\" y=\"' || {y('b')} || '\" fill=\"#c8c8c8\" font-size=\"9.000\" font-family=\"sans-serif\" textLength=\"30.000\" lengthAdjust=\"spacingAndGlyphs\"' || {clip} || '>R</text>'",
        "'</svg>'",
    ]
    head = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<svg xmlns=\"http://www.w3.org/2000/svg\" viewBox=\"0.000 0.000 100.000 100.000\">' || chr(10)"
    paper = "CASE WHEN k % 4 = 0 THEN '  <rect x=\"0.000\" y=\"0.000\" width=\"100.000\" height=\"100.000\" fill=\"#ffffff\" stroke=\"none\" />' || chr(10) ELSE '' END"
    # the clipping box is empty where a is not above 0
    box = f"CASE WHEN k % 3 = 0 THEN '  <defs>' || chr(10) || '    <clipPath id=\"cgmClip0\">' || chr(10) || '      <rect x=\"1.000\" y=\"' || {y('a + 2')} || '\" width=\"' || {n('a')} || '\" height=\"' || {n('a')} || '\" />' || chr(10) || '    </clipPath>' || chr(10) || '  </defs>' || chr(10) ELSE '' END"
    group = f"'  <g fill=\"none\" stroke-linecap=\"round\" stroke-linejoin=\"round\"' || {clip} || '>' || chr(10)"
    return f"WITH {_KINDS}, s AS (SELECT k, {head} || {paper} || {box} || {group} || {' || chr(10) || '.join(lines)} || chr(10) AS s FROM a) SELECT k || '_0000.svg' AS name, CAST(strlen(s) AS BIGINT) AS bytes, md5(s) AS digest FROM s"


def drawing_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final images with their hotspots: parts of which each third has an application structure around a line."""
    at = lambda k: F.concat(*[hex_f32(F.lit(x).cast("double") if isinstance(x, int) else x.cast("double")) for x in k])
    tag = F.concat(F.lit("T"), F.col("p_partkey").cast("string"))
    line = F.struct(F.lit(4).alias("c"), F.lit(1).alias("e"), at((1, 2, F.col("p_size") + 10, F.col("p_size") + 20)).alias("h"))
    begin = F.struct(F.lit(0).alias("c"), F.lit(21).alias("e"), F.concat(hex_unsigned(F.length(tag), 1), F.hex(tag)).alias("h"))
    head = [F.struct(F.lit(1).alias("c"), F.lit(e).alias("e"), F.lit(h).alias("h")) for e, h in ((3, "0001"), (12, "0020"))]
    end = F.struct(F.lit(0).alias("c"), F.lit(22).alias("e"), F.lit("").alias("h"))
    each = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.when(F.col("p_partkey") % 3 == 0, F.array(*head, begin, line, end)).otherwise(F.array(*head, line))).alias("j", "x"))
    made = binary_files(each, F.col("p_partkey"), F.col("j"), F.col("x.c"), F.col("x.e"), F.col("x.h"))
    found = api.final_images_and_hotspots(made, materialize(files.framing.frame_files(made), "elements"))
    spots = F.array_join(F.transform("hotspots", lambda h: F.concat(h["name"], F.lit(":"), F.concat_ws(",", *[h[k].cast("string") for k in ("x_min", "y_min", "x_max", "y_max")]))), ";")
    return found.select(F.col("doc_id").cast("long").alias("doc"), F.length("image").cast("long").alias("chars"), F.regexp_extract("image", 'viewBox="([^"]*)"', 1).alias("box"), spots.alias("hotspots"))


_HOTSPOTS_SQL = """
    WITH p AS (SELECT p_partkey AS doc, CAST(p_size AS DOUBLE) AS s FROM part),
    d AS (SELECT *, printf('1.000 2.000 %.3f %.3f', s + 9, s + 18) AS box, printf('    <polyline points="1.000,%.3f %.3f,2.000" stroke="#000000" stroke-width="1.000" />', s + 20, s + 10) AS line FROM p)
    SELECT doc, length('<?xml version="1.0" encoding="UTF-8"?>') + length('<svg xmlns="http://www.w3.org/2000/svg" viewBox="">') + length(box) + length('  <g fill="none" stroke-linecap="round" stroke-linejoin="round">') + length(line) + length('  </g>') + length('</svg>') + 6 AS chars,
      box, CASE WHEN doc % 3 = 0 THEN printf('T%d:1,2,%d,%d', doc, CAST(s + 10 AS BIGINT), CAST(s + 20 AS BIGINT)) ELSE '' END AS hotspots FROM d"""


_SNAPSHOT = """byte_length long, element_count long, element_histogram array<struct<class_id:long,element_id:long,count:long>>,
    elements array<struct<offset:long,class_id:long,element_id:long,parameter_length:long,parameters_hex:string>>,
    raw_images array<struct<index:long,width:long,height:long,payload_size:long,payload_hex:string>>, hotspots array<struct<name:string>>, vector_svg string"""


def snapshot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots written as JSON files, read again: sizes, elements in order, kinds by frequency, images and hotspots."""
    folder = _folder(spark, "snapshots")
    made = materialize(_celled(spark, sf_dir), "files")
    texts = _written(api.write_data_json(made, folder, files.framing.frame_files(made)))
    found = texts.select(F.regexp_extract("path", "([0-9]+)_0000\\.json$", 1).cast("long").alias("doc"), F.from_json(F.col("content").cast("string"), _SNAPSHOT).alias("x"))
    listed = F.array_join(F.transform("x.elements", lambda e: F.concat_ws("/", e["class_id"].cast("string"), e["element_id"].cast("string"), e["offset"].cast("string"), e["parameter_length"].cast("string"))), " ")
    kinds = F.array_join(F.transform("x.element_histogram", lambda e: F.concat_ws("/", e["class_id"].cast("string"), e["element_id"].cast("string"), e["count"].cast("string"))), " ")
    image = F.get("x.raw_images", F.lit(0))
    return found.select("doc", "x.byte_length", "x.element_count", listed.alias("elements"), kinds.alias("kinds"), F.size("x.raw_images").cast("long").alias("images"), image["payload_hex"].alias("payload"), F.size("x.hotspots").cast("long").alias("hotspots"), F.col("x.vector_svg").contains("<image").alias("drawn"))


# --- rasters: pixels of the images that drawings hold


def _pixels(rows: DataFrame) -> DataFrame:
    """``doc, i, kind, width, height, pixels`` (hexadecimal) of PNG images in ``href``."""

    def read(batches):  # noqa: ANN001, ANN202
        import base64
        import struct
        import zlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, i, href in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = base64.b64decode(href.partition(",")[2])
                at, parts = 8, {}
                while at < len(data):
                    n, name = struct.unpack(">I4s", data[at : at + 8])
                    parts[name] = parts.get(name, b"") + data[at + 8 : at + 8 + n]
                    at += 12 + n
                width, height, _, color = struct.unpack(">IIBB", parts[b"IHDR"][:10])
                raw = zlib.decompress(parts[b"IDAT"])
                stride = len(raw) // height
                out.append((doc, i, color, width, height, b"".join(raw[y * stride + 1 : (y + 1) * stride] for y in range(height)).hex(), parts.get(b"PLTE", b"").hex()))
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc", "i", "kind", "width", "height", "pixels", "palette"])

    return rows.mapInArrow(read, "doc long, i long, kind long, width long, height long, pixels string, palette string")


def _celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files with one cell array of 3 by 2, of a precision for each remainder of 5."""
    k = F.col("p_partkey")
    byte = lambda m: hex_unsigned((k * m + 11) % 256, 1)
    r = k % 5
    precision = F.when(r == 0, "0008").when(r == 1, "0010").when(r == 2, "0018").when(r == 3, "0001").otherwise("0020")
    many = lambda n: F.concat(*[byte(m) for m in range(1, n + 1)])
    payload = F.when(r == 0, many(6)).when(r == 1, many(36)).when(r == 2, many(18)).when(r == 3, many(2)).otherwise(many(24))
    listed = [(2, 6, F.lit("0000000000030002")), (1, 10, F.lit("000000000000" + "0fff1fff3fff")), (5, 34, F.lit("0a010203")), (4, 9, F.concat(F.lit("00" * 12 + "00030002"), precision, F.lit("0000"), payload))]
    rows = dealt(table(spark, sf_dir, "part").select(k.cast("string").alias("doc_id"), k), "doc_id")
    each = rows.select("doc_id", F.posexplode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("e"), h.alias("h")) for c, e, h in listed])).alias("j", "x"))
    return binary_files(each, F.col("doc_id"), F.col("j"), F.col("x.c"), F.col("x.e"), F.col("x.h"))


def cell_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell arrays as backgrounds: indexed, scaled from 16 bits, direct, bits, with alpha."""
    made = _celled(spark, sf_dir)
    found = raster.rasters(made, materialize(files.framing.frame_files(made), "elements"))
    return _pixels(found.select(F.col("doc_id").cast("long").alias("doc"), F.lit(0).cast("long").alias("i"), "href")).select("doc", "kind", "width", "height", "pixels", F.md5("palette").alias("palette"))


_CELL_BYTES = "list_transform(range(1, {n} + 1), lambda m: (k * m + 11) % 256)"
_BACKGROUND_SQL = f"""
    WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS r FROM part),
    b AS (SELECT *, CASE r WHEN 0 THEN {_CELL_BYTES.format(n=6)} WHEN 1 THEN {_CELL_BYTES.format(n=36)} WHEN 2 THEN {_CELL_BYTES.format(n=18)} WHEN 3 THEN {_CELL_BYTES.format(n=2)} ELSE {_CELL_BYTES.format(n=24)} END AS v FROM p),
    c AS (SELECT *, CASE r
        WHEN 1 THEN list_transform(range(0, 18), lambda j: CAST(round_even(least(v[2 * j + 1] * 256 + v[2 * j + 2], [4095, 8191, 16383][j % 3 + 1]) * 255.0::DOUBLE / [4095, 8191, 16383][j % 3 + 1], 0) AS BIGINT))
        WHEN 3 THEN list_transform(range(0, 6), lambda j: CASE WHEN (v[j // 3 + 1] // CAST(pow(2, 7 - j % 3) AS BIGINT)) % 2 = 1 THEN 0 ELSE 255 END)
        ELSE v END AS x FROM b)
    SELECT k AS doc, CAST(CASE r WHEN 0 THEN 3 WHEN 3 THEN 0 WHEN 4 THEN 6 ELSE 2 END AS BIGINT) AS kind, CAST(3 AS BIGINT) AS width, CAST(2 AS BIGINT) AS height, array_to_string(list_transform(x, lambda y: printf('%02x', y)), '') AS pixels,
      md5(CASE WHEN r = 0 THEN array_to_string(list_transform(range(0, 256), lambda i: CASE WHEN i = 10 THEN '010203' ELSE repeat(printf('%02x', CAST({_DEFAULT_SQL} AS BIGINT)), 3) END), '') ELSE '' END) AS palette FROM c"""
_SNAPSHOT_SQL = f"""
    WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS r FROM part),
    n AS (SELECT *, CASE r WHEN 0 THEN 6 WHEN 1 THEN 36 WHEN 2 THEN 18 WHEN 3 THEN 2 ELSE 24 END AS n FROM p)
    SELECT k AS doc, CAST(30 + 20 + n + CASE WHEN n + 20 > 30 THEN 4 ELSE 2 END AS BIGINT) AS byte_length, CAST(4 AS BIGINT) AS element_count, printf('2/6/0/8 1/10/10/12 5/34/24/4 4/9/30/%d', CAST(n + 20 AS BIGINT)) AS elements, '2/6/1 1/10/1 5/34/1 4/9/1' AS kinds,
      CAST(1 AS BIGINT) AS images, array_to_string(list_transform(range(1, n + 1), lambda m: printf('%02x', (k * m + 11) % 256)), '') AS payload, CAST(0 AS BIGINT) AS hotspots, TRUE AS drawn FROM n"""


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as overlays: in clear text of three families, in binary as packed bits of both orders."""
    k = F.col("p_partkey")
    h = lambda m: hex_unsigned((k * m + 5) % 256, 1)
    text = table(spark, sf_dir, "part").where("p_partkey % 2 = 0")
    statements = [
        F.lit("BEGTILEARRAY 0 0 0 0 2 2 2 1 0 0 0 0 4 2"), F.concat(F.lit("COLORTILE 0 24 0 0 '' "), *[h(m) for m in range(1, 7)]), F.concat(F.lit("INDEXCOLORTILE 0 8 0 0 '' "), h(7), h(8)),
        F.concat(F.lit("COLORTILE 0 32 0 0 '' "), *[h(m) for m in range(1, 9)]), F.concat(F.lit("COLORTILE 0 16 0 0 '' "), *[h(m) for m in range(1, 13)]), F.lit("ENDTILEARRAY"),
    ]
    said = text_files(text.select("p_partkey", F.posexplode(F.array(*statements)).alias("j", "s")), k, F.col("j"), F.col("s"))
    header = "00" * 8 + "0002" + "0001" + "0008" + "0002" + "00" * 12 + "000c" + "0002"
    item = lambda c, e, x: F.struct(F.lit(c).alias("c"), F.lit(e).alias("e"), x.alias("h"))
    binary = table(spark, sf_dir, "part").where("p_partkey % 2 = 1").select("p_partkey", F.posexplode(F.array(item(0, 19, F.lit(header)), item(4, 28, F.concat(F.lit("00000000000000"), h(1), h(2))), item(4, 28, F.concat(F.lit("00000000000100"), h(3), h(4))), item(0, 20, F.lit("")))).alias("j", "x"))
    made = said.unionByName(binary_files(binary, k, F.col("j"), F.col("x.c"), F.col("x.e"), F.col("x.h")))
    parsed = materialize(files.elements(made), "elements")
    found = raster.tile_overlays(tiles.tiles(made, parsed), parsed)
    each = found.select(F.col("doc_id").cast("long").alias("doc"), F.posexplode("overlays").alias("i", "o"))
    places = each.select("doc", F.col("i").cast("long").alias("i"), F.col("o.href").alias("href"), *[F.col(f"o.{c}").cast("long").alias(c) for c in "xywh"])
    kept = materialize(places, "overlays")
    return _pixels(kept.select("doc", "i", "href")).drop("palette").join(kept.drop("href"), ["doc", "i"])


_TILE_PIXELS_SQL = """
    WITH p AS (SELECT p_partkey AS doc, list_transform(range(1, 13), lambda m: (p_partkey * m + 5) % 256) AS v FROM part),
    t AS (
      SELECT doc, 0 AS i, 2 AS kind, v[1:6] AS x FROM p WHERE doc % 2 = 0 UNION ALL SELECT doc, 1, 3, v[7:8] FROM p WHERE doc % 2 = 0 UNION ALL SELECT doc, 2, 6, v[1:8] FROM p WHERE doc % 2 = 0 UNION ALL
      SELECT doc, 3, 2, list_transform(range(0, 6), lambda j: CAST(round_even((v[2 * j + 1] * 256 + v[2 * j + 2]) * 255.0::DOUBLE / 65535, 0) AS BIGINT)) FROM p WHERE doc % 2 = 0 UNION ALL
      SELECT doc, 0, 0, list_transform(range(0, 16), lambda j: CASE WHEN (v[j // 8 + 1] // CAST(pow(2, 7 - j % 8) AS BIGINT)) % 2 = 1 THEN 0 ELSE 255 END) FROM p WHERE doc % 2 = 1 UNION ALL
      SELECT doc, 1, 0, list_transform(range(0, 8), lambda j: CASE WHEN (v[j // 4 + 3] // CAST(pow(2, j % 4) AS BIGINT)) % 2 = 1 THEN 0 ELSE 255 END) FROM p WHERE doc % 2 = 1),
    s AS (SELECT *, CASE WHEN doc % 2 = 0 THEN 2 WHEN i = 0 THEN 8 ELSE 4 END AS w, CASE WHEN doc % 2 = 0 THEN 1 ELSE 2 END AS h FROM t)
    SELECT doc, CAST(i AS BIGINT) AS i, CAST(kind AS BIGINT) AS kind, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, array_to_string(list_transform(x, lambda y: printf('%02x', y)), '') AS pixels,
      CAST(CASE WHEN doc % 2 = 0 THEN i % 2 * 2 ELSE i * 8 END AS BIGINT) AS x, CAST(CASE WHEN doc % 2 = 0 THEN i // 2 ELSE 0 END AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM s"""


def raster_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster elements of packed bits: two in a document are laid out in a grid of its extent, one is its background."""
    k = F.col("p_partkey")
    h = lambda m: hex_unsigned((k * m + 5) % 256, 1)
    bits = lambda m: F.concat(F.lit("00060000000806"), *[h(m + j) for j in range(4)])
    item = lambda c, e, x: F.struct(F.lit(c).alias("c"), F.lit(e).alias("e"), x.alias("h"))
    extent = item(2, 6, F.lit("0000000000080004"))
    each = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.when(k % 2 == 0, F.array(extent, item(4, 29, bits(1)), item(4, 29, bits(5)))).otherwise(F.array(extent, item(4, 29, bits(1))))).alias("j", "x"))
    made = binary_files(each, k, F.col("j"), F.col("x.c"), F.col("x.e"), F.col("x.h"))
    found = raster.rasters(made, materialize(files.framing.frame_files(made), "elements"))
    whole = F.struct("href", *[F.lit(x).cast("double").alias(n) for n, x in zip("xywh", (0, 0, 8, 4), strict=True)])
    shown = found.select(F.col("doc_id").cast("long").alias("doc"), F.posexplode(F.coalesce("overlays", F.array(whole))).alias("i", "o"))
    kept = materialize(shown.select("doc", F.col("i").cast("long").alias("i"), F.col("o.href").alias("href"), F.col("o.x").cast("long").alias("x"), F.col("o.w").cast("long").alias("w")), "overlays")
    return _pixels(kept.select("doc", "i", "href")).select("doc", "i", "width", "height", "pixels").join(kept.drop("href"), ["doc", "i"])


_GRIDS_SQL = """
    WITH p AS (SELECT p_partkey AS doc, list_transform(range(1, 9), lambda m: (p_partkey * m + 5) % 256) AS v FROM part),
    t AS (SELECT doc, 0 AS i, v[1:4] AS v FROM p UNION ALL SELECT doc, 1, v[5:8] FROM p WHERE doc % 2 = 0), s AS (SELECT *, CASE WHEN doc % 2 = 0 THEN 4 ELSE 8 END AS w FROM t)
    SELECT doc, CAST(i AS BIGINT) AS i, CAST(w AS BIGINT) AS width, CAST(4 AS BIGINT) AS height,
      array_to_string(list_transform(range(0, 4 * w), lambda j: CASE WHEN (v[j // w + 1] // CAST(pow(2, 7 - j % w) AS BIGINT)) % 2 = 1 THEN '00' ELSE 'ff' END), '') AS pixels, CAST(i * 4 AS BIGINT) AS x, CAST(w AS BIGINT) AS w FROM s"""


# --- files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(paths: DataFrame) -> DataFrame:
    """``path, content`` of what has been written, all of it before the first file is read; from the files themselves."""
    return sinks.read_files(dealt(materialize(paths, "paths"), "path"))


def _read_back(paths: DataFrame) -> DataFrame:
    """``name, bytes, digest`` of what has been written."""
    return _written(paths).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as metafiles of their customers, written to a folder, read again as files and framed."""
    made = binary_files(table(spark, sf_dir, "customer"), F.col("c_nationkey"), F.col("c_custkey"), F.lit(7), F.lit(2), F.hex("c_name"))
    folder = _folder(spark, "files")
    sinks.write_files(made.select(F.concat(F.lit("n"), F.col("doc_id"), F.lit(".cgm")).alias("name"), "content"), folder).count()
    found = files.elements(files.read_metafiles(spark, folder))
    return found.select(F.regexp_extract("doc_id", "n([0-9]+)\\.cgm$", 1).cast("long").alias("nation"), "seq", F.decode("parameters", "UTF-8").alias("name"))


def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of cell arrays, one file each."""
    folder = _folder(spark, "payloads")
    made = _celled(spark, sf_dir)
    return _read_back(api.write_raw_images(made, folder, files.framing.frame_files(made)))


_PAYLOAD_FILES_SQL = """
    WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 36 WHEN 2 THEN 18 WHEN 3 THEN 2 ELSE 24 END AS n FROM part)
    SELECT k || '_0000.bin' AS name, n AS bytes, md5(unhex(array_to_string(list_transform(range(1, n + 1), lambda m: printf('%02x', (k * m + 11) % 256)), ''))) AS digest FROM (SELECT k, CAST(n AS BIGINT) AS n FROM p)"""


def hotspot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotspots of parts as JSON files: a list of one, or an empty list."""
    k = F.col("p_partkey")
    name = F.concat(F.lit('"S'), k.cast("string"), F.lit('"'))
    region = F.concat(F.lit('APD "region" "1 2 '), (F.col("p_size") + 1).cast("string"), F.lit(' 9"'))
    each = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.when(k % 2 == 0, F.array(F.concat(F.lit("BEGAPS "), name), region, F.lit("ENDAPS"))).otherwise(F.array(F.lit("LINE 0 0 1 1")))).alias("j", "s"))
    folder = _folder(spark, "hotspots")
    made = text_files(each, k, F.col("j"), F.col("s"))
    return _read_back(api.write_hotspots(made, folder, cleartext.elements(made).drop("error")))


_HOTSPOT_FILES_SQL = """
    WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '[' || chr(10) || '  {' || chr(10) || '    "index": 0,' || chr(10) || '    "source_tag": "S' || p_partkey || '",' || chr(10) || '    "name": "S' || p_partkey || '",' || chr(10)
        || '    "x_min": 1,' || chr(10) || '    "y_min": 2,' || chr(10) || '    "x_max": ' || (p_size + 1) || ',' || chr(10) || '    "y_max": 9,' || chr(10) || '    "raw_region_hex": "00010002' || printf('%04x', CAST(p_size + 1 AS BIGINT)) || '0009"' || chr(10) || '  }' || chr(10) || ']' || chr(10) ELSE '[]' || chr(10) END AS s FROM part WHERE p_partkey % 2 = 1 OR p_size > 0)
    SELECT k || '_0000.hotspots.json' AS name, CAST(strlen(s) AS BIGINT) AS bytes, md5(s) AS digest FROM p"""


def decode_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each document's rasters, written as files: their numbers."""
    made, folder = _celled(spark, sf_dir), _folder(spark, "reports")
    parsed = files.framing.frame_files(made)
    written = sinks.write_files(sinks.report_files(made, api.tile_arrays(made, parsed), api.raw_images(made, parsed)), folder)
    texts = _written(written).select(F.from_json(F.col("content").cast("string"), "source string, arrays array<struct<cols:int>>, raw_image_count long").alias("r"))
    return texts.select("r.source", F.size("r.arrays").cast("long").alias("arrays"), F.col("r.raw_image_count").alias("images"))


QUERIES = {
    f.__name__: f
    for f in (statement_bytes, tiles_as_cells, document_states, palettes, consensus_votes, tolerant_ints, drawing_kinds, drawing_hotspots, snapshot_fields, cell_backgrounds, tile_pixels, raster_grids, files_read, payload_files, hotspot_files, decode_reports)
}

SQL = {
    "statement_bytes": _STATEMENT_SQL,
    "tiles_as_cells": _TILES_AS_CELLS_SQL,
    "document_states": _STATES_SQL,
    "palettes": _PALETTES_SQL,
    "consensus_votes": """
        WITH v AS (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority, o_orderstatus) AS r FROM v)
        SELECT o_custkey, o_orderpriority, o_orderstatus FROM b WHERE r = 1 AND n >= 2 AND CAST(n AS DOUBLE) / CAST(total AS DOUBLE) >= 0.3""",
    "tolerant_ints": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 7 END AS BIGINT) AS n FROM part",
    "drawing_kinds": _drawing_sql(),
    "drawing_hotspots": _HOTSPOTS_SQL,
    "snapshot_fields": _SNAPSHOT_SQL,
    "cell_backgrounds": _BACKGROUND_SQL,
    "tile_pixels": _TILE_PIXELS_SQL,
    "raster_grids": _GRIDS_SQL,
    "files_read": "SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS seq, c_name AS name FROM customer",
    "payload_files": _PAYLOAD_FILES_SQL,
    "hotspot_files": _HOTSPOT_FILES_SQL,
    "decode_reports": "SELECT CAST(p_partkey AS VARCHAR) AS source, CAST(0 AS BIGINT) AS arrays, CAST(1 AS BIGINT) AS images FROM part",
}
