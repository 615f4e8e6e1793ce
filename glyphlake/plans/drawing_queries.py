"""Queries that make metafiles of tables, read them and evaluate them; their SQL answers from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions import decoders as D
from glyphlake.functions import images as I  # noqa: E741
from glyphlake.functions import text as T
from glyphlake.functions.bytes import hex_f32, hex_f64, hex_signed, hex_unsigned, points
from glyphlake.operators import hotspots as H
from glyphlake.operators import primitives as P
from glyphlake.operators import raster, scopes, snapshot, state, svg, tiles
from glyphlake.operators.images import raw_images as extract_raw_images
from glyphlake.plans.synth import binary_files, table, text_files
from glyphlake.sources import cleartext, files
from glyphlake.sources.work import materialize


def _n(name: str):  # noqa: ANN202
    return F.col(name).cast("string")


def _say(*parts):  # noqa: ANN002, ANN202
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _quoted(c):  # noqa: ANN001, ANN202
    return F.concat(F.lit('"'), c, F.lit('"'))


def _framed(made: DataFrame) -> DataFrame:
    """Elements as a table of their own, for what reads them several times."""
    return materialize(files.framing.frame_files(made), "elements")


# --- reading


def binary_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as elements of fifty binary files: the type of each third event, the properties of the others, both whole."""
    rows = table(spark, sf_dir, "events")
    made = binary_files(rows, F.col("event_id") % 50, F.col("event_id"), F.col("event_id") % 9, F.col("event_id") % 128, F.hex(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("props"))))
    found = files.framing.frame_files(made)
    return found.select(F.col("doc_id").cast("long").alias("doc"), "seq", "class_id", "element_id", F.octet_length("parameters").cast("long").alias("n"), F.md5("parameters").alias("digest"))


def _statement():  # noqa: ANN202
    """A statement for each line of an order, of a kind for each line number."""
    return F.when(F.col("l_linenumber") == 1, _say("LINE", _n("l_quantity"), _n("l_linenumber"), _n("l_discount"), _n("l_tax"))).when(F.col("l_linenumber") == 2, _say("RECT 0 0", _n("l_quantity"), _n("l_linenumber"))).when(F.col("l_linenumber") == 3, _say("CIRCLE 1 2", _n("l_quantity"))).when(F.col("l_linenumber") == 4, _say("TEXT 1 2", _quoted(F.col("l_returnflag")))).when(F.col("l_linenumber") == 5, F.lit("UNKNOWN 1 2")).otherwise(F.lit("VDCEXT 0 0 10 10"))


def text_to_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    made = text_files(rows, F.col("l_orderkey") % 100, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), _statement())
    found = files.elements(made)
    return found.groupBy(F.col("doc_id").cast("long").alias("doc"), "class_id", "element_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("parameters")).cast("long").alias("bytes"))


# --- numbers


def f32_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.unhex(F.array_join(F.transform("embedding", hex_f32), ""))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(points(packed, "f32")).alias("p"))
    return rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.min("p.x").alias("x_min"), F.max("p.x").alias("x_max"), F.min("p.y").alias("y_min"), F.max("p.y").alias("y_max"))


def _profile_points(spark: SparkSession, sf_dir: str, head: list[tuple[int, str]], packed) -> DataFrame:  # noqa: ANN001
    """Points of orders' lines by the declared descriptors of their file."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.lit(1).alias("k"), F.col("l_linenumber").alias("l")).alias("o"), F.lit(4).alias("c"), F.lit(1).alias("e"), packed.alias("h"))
    declared = rows.select("l_orderkey").distinct()
    for i, (element, value) in enumerate(head):
        rows = rows.unionByName(declared.select("l_orderkey", F.struct(F.lit(0).alias("k"), F.lit(i).alias("l")).alias("o"), F.lit(1).alias("c"), F.lit(element).alias("e"), F.lit(value).alias("h")))
    found = P.decoded(_framed(binary_files(rows, F.col("l_orderkey"), F.col("o"), F.col("c"), F.col("e"), F.col("h"))))
    each = found.select(F.col("doc_id").cast("long").alias("l_orderkey"), F.explode("points").alias("p"))
    return each.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("p.x").alias("x_min"), F.max("p.x").alias("x_max"), F.min("p.y").alias("y_min"), F.max("p.y").alias("y_max"))


def i16_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_points(spark, sf_dir, [(3, "0000"), (11, "0010")], F.concat(hex_signed(F.col("l_quantity") - 25, 2), hex_signed(F.col("l_linenumber"), 2)))


def i32_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_points(spark, sf_dir, [(3, "0000"), (11, "0020")], F.concat(hex_signed(F.col("l_partkey") * -1000, 4), hex_signed(F.col("l_suppkey"), 4)))


def f64_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_points(spark, sf_dir, [(3, "0001"), (12, "0040")], F.concat(hex_f64(F.col("l_extendedprice")), hex_f64(F.col("l_discount") - 0.05)))


def vdc_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = [F.col("o_custkey") % 65536, F.col("o_orderkey") % 65536, F.col("o_custkey") * 7 % 65536, F.col("o_orderkey") * 13 % 65536]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", D.vdc_extent(F.unhex(F.concat(*[hex_unsigned(c, 2) for c in corner]))).alias("x"))
    return rows.select("o_orderkey", *[F.col(f"x.{k}").alias(k) for k in ("x_min", "y_min", "x_max", "y_max")])


def circles_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.unhex(F.concat(*[hex_signed(c, 2) for c in (F.col("p_size"), F.col("p_partkey") % 100, F.col("p_size") - 3)]))
    e = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((F.lit(1), F.lit(2)), (F.col("p_size"), F.col("p_size") + 5), (F.lit(1) - F.col("p_size"), F.lit(7)))])
    rows = table(spark, sf_dir, "part").select("p_partkey", D.circle(b, F.lit(0), F.lit(16), F.lit(None)).alias("c"), D.ellipse(e).alias("e"))
    return rows.select("p_partkey", F.col("c.r").alias("r"), F.col("c.cx").alias("cx"), F.col("e.rx").alias("rx"), F.col("e.ry").alias("ry"))


def disjoint_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: F.struct(x["l_partkey"].cast("double").alias("x"), x["l_quantity"].alias("y")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pts.alias("p"))
    return rows.select("l_orderkey", F.posexplode(D.segments(F.col("p"))).alias("k", "s")).select("l_orderkey", F.col("k").cast("long").alias("k"), F.get("s", F.lit(0))["x"].alias("from_x"), F.get("s", F.lit(1))["x"].alias("to_x"))


def gdp_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with and without an identifier before their points."""
    b = F.unhex(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "0007").otherwise(""), hex_signed(F.col("l_quantity"), 2), hex_signed(F.col("l_linenumber"), 2)))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(points(D.gdp_payload(b, F.lit(0)), "i16")).alias("p"))
    return rows.groupBy("l_orderkey").agg(F.sum("p.x").alias("x_sum"), F.sum("p.y").alias("y_sum"))


# --- state


def profile_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    e = F.when(F.col("event_type") == "view", 3).when(F.col("event_type") == "click", 11).otherwise(12)
    value = F.when(e == 12, F.when(F.col("event_id") % 2 == 0, 32).otherwise(64)).when(e == 3, F.col("event_id") % 2).otherwise(F.col("event_id") % 40)
    made = binary_files(rows, F.col("user_id"), F.col("event_id"), F.lit(1), e, hex_unsigned(value, 2))
    return state.profile(files.framing.frame_files(made)).select(F.col("doc_id").cast("long").alias("user_id"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("vdc_type", "vdc_precision", "vdc_real_bits")])


def style_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks set the width, purchases the colour; views are lines."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase", "view"))
    kind = F.col("event_type")
    made = binary_files(rows, F.col("user_id"), F.col("event_id"), F.when(kind == "view", 4).otherwise(5), F.when(kind == "view", 1).when(kind == "click", 3).otherwise(4), F.when(kind == "view", hex_unsigned(F.col("event_id"), 4)).when(kind == "click", hex_f32((F.col("event_id") % 50 - 5).cast("double"))).otherwise(hex_unsigned(F.col("event_id") % 200, 1)))
    found = state.styled(files.framing.frame_files(made)).where("class_id = 4")
    return found.select(F.conv(F.hex("parameters"), 16, 10).cast("long").alias("event_id"), "stroke_width", F.coalesce(F.col("color_at").cast("long"), F.lit(-1)).alias("color_at"))


def color_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers set colours of their nation's table, one entry each; the last counts."""
    rows = table(spark, sf_dir, "customer")
    entry = F.concat(hex_unsigned(F.col("c_custkey") % 256, 1), *[hex_unsigned(F.col("c_custkey") * k % 256, 1) for k in (3, 5, 7)])
    made = binary_files(rows, F.col("c_nationkey"), F.col("c_custkey"), F.lit(5), F.lit(34), entry)
    found = state.color_table(files.framing.frame_files(made)).withColumn("color_at", F.col("color_index"))
    return found.select(F.col("doc_id").cast("long").alias("nation"), "color_index", D.color_hex(F.struct("r", "g", "b")).alias("color"))


def default_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 300 - 20).alias("i"))
    return rows.select("p_partkey", D.color_hex(D.default_color(F.greatest(F.lit(0), F.col("i")))).alias("color"))


def color_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", D.scale_to_byte(F.col("o_orderkey") * 37 % 65536, 16).cast("long").alias("byte"))


# --- scopes, hotspots, texts


def scope_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return scopes.owners(rows, step, "user_id", "event_id").select("user_id", "event_id", F.coalesce("owner", F.lit(-1)).alias("owner"))


def _order_statements(spark: SparkSession, sf_dir: str, region: bool) -> DataFrame:
    """An application structure for each order with a polygon for each line, in files of a hundred orders' remainder."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    at = lambda k, l: F.struct(F.lit(k).alias("k"), l.cast("long").alias("l"))  # noqa: E731, E741
    head = orders.select("o_orderkey", at(0, F.lit(0)).alias("o"), _say("BEGAPS", _quoted(F.concat(F.lit("O"), _n("o_orderkey")))).alias("s"))
    tail = orders.select("o_orderkey", at(9, F.lit(0)).alias("o"), F.lit("ENDAPS").alias("s"))
    points_ = lines.select(F.col("l_orderkey").alias("o_orderkey"), at(2, F.col("l_linenumber")).alias("o"), _say("POLYGON", _n("l_quantity"), _n("l_extendedprice"), _n("l_linenumber"), _n("l_discount")).alias("s"))
    out = head.unionByName(points_).unionByName(tail)
    if region:
        box = orders.where("o_orderkey % 3 = 0").select("o_orderkey", at(1, F.lit(0)).alias("o"), F.concat(F.lit('APD "region" "'), _say((F.col("o_custkey") % 100).cast("string"), "5", (F.col("o_custkey") % 100 + 10).cast("string"), "50"), F.lit('"')).alias("s"))
        name = orders.where("o_orderkey % 2 = 0").select("o_orderkey", at(1, F.lit(1)).alias("o"), _say('APD "name"', _quoted(F.col("o_orderpriority"))).alias("s"))
        out = out.unionByName(box).unionByName(name)
    return text_files(out, F.col("o_orderkey") % 100, F.struct("o_orderkey", "o"), F.col("s"))


def hotspots_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.hotspots(files.elements(_order_statements(spark, sf_dir, region=False)))
    return found.select(F.col("doc_id").cast("long").alias("doc"), F.col("index").cast("long").alias("index"), "source_tag", "x_min", "y_min", "x_max", "y_max")


def hotspots_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.hotspots(files.elements(_order_statements(spark, sf_dir, region=True)))
    return found.select(F.col("doc_id").cast("long").alias("doc"), "source_tag", "name", "x_min", "y_min", "x_max", "y_max", "raw_region_hex")


def text_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of turns, in pieces of up to 254 bytes: those of users are texts, all else is appended to them.

    Texts of metafiles are read if they are printable ASCII, so all other characters are escaped as in URLs.
    """
    rows = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", "role", F.url_encode("text").alias("whole"))
    cut = F.transform(F.sequence(F.lit(0), F.length("whole") - 1, F.lit(254)), lambda at: F.substring(F.col("whole"), at + 1, F.lit(254)))
    pieces = rows.select("conv_id", "turn", "role", F.posexplode(cut).alias("k", "said"))
    packed = F.concat(hex_unsigned(F.length("said"), 1), F.hex("said"))
    starts = (F.col("role") == "user") & (F.col("k") == 0)
    made = binary_files(pieces, F.col("conv_id"), F.struct(F.col("turn").cast("long").alias("t"), F.col("k").alias("k")), F.lit(4), F.when(starts, 5).otherwise(6), F.when(starts, F.concat(hex_f32(F.col("turn").cast("double")), F.lit("3f800000"), packed)).otherwise(packed))
    declared = F.unhex(F.lit("10620001" + "11820020"))
    found = P.primitives(files.framing.frame_files(made.select("doc_id", F.concat(declared, "content").alias("content"))))
    return found.where("kind = 'text'").select(F.col("doc_id").cast("long").alias("conv_id"), F.get("points", F.lit(0))["x"].cast("long").alias("turn"), F.url_decode("text").alias("said"))


# --- images and tiles


def raw_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cell arrays in clear text."""
    rows = table(spark, sf_dir, "part")
    made = text_files(rows, F.col("p_partkey") % 40, F.col("p_partkey"), _say("CELLARRAY 0 0 1 0 0 1", _n("p_size"), (F.col("p_partkey") % 7).cast("string"), "8", (F.col("p_partkey") % 256).cast("string"), _n("p_size")))
    found = extract_raw_images(files.elements(made))
    return found.select(F.col("doc_id").cast("long").alias("doc"), F.col("index").cast("long").alias("index"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.lower(F.hex("payload")).alias("payload"))


def tile_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", D.tile_grid(F.col("p_size"), F.col("p_partkey") % 90 + 10, F.lit(40)).alias("g"))
    return rows.select("p_partkey", F.col("g.cols").cast("long").alias("cols"), F.col("g.rows").cast("long").alias("rows"))


def _tile_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l"), F.concat(F.lit("COLORTILE 0 8 0 0 '' "), hex_unsigned(F.col("l_quantity"), 1), hex_unsigned(F.col("l_linenumber"), 1)).alias("s"))
    keys = lines.select("l_orderkey").distinct()
    begin = keys.select("l_orderkey", F.lit(0).cast("long").alias("l"), F.lit("BEGTILEARRAY 0 0 0 0 2 3 2 1 0 0 0 0 4 3").alias("s"))
    end = keys.select("l_orderkey", F.lit(99).cast("long").alias("l"), F.lit("ENDTILEARRAY").alias("s"))
    return text_files(begin.unionByName(lines).unionByName(end), F.col("l_orderkey") % 50, F.struct("l_orderkey", "l", "s"), F.col("s"))


def tile_arrays_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiles.tile_arrays(tiles.text_tiles(_tile_statements(spark, sf_dir)))
    return found.select(F.col("doc_id").cast("long").alias("doc"), F.col("array_index").cast("long").alias("array_index"), F.col("cols").cast("long").alias("cols"), F.size("tiles").cast("long").alias("n"))


def tile_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiles.placed(tiles.text_tiles(_tile_statements(spark, sf_dir)))
    return found.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("x"), F.sum("y").cast("long").alias("y"), F.sum(F.col("paste_w") * F.col("paste_h")).cast("long").alias("area"))


def tile_arrays_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l"), F.lit(4).alias("c"), F.lit(28).alias("e"), F.concat(F.lit("00000000000100"), hex_unsigned(F.col("l_quantity"), 1)).alias("h"))
    keys = lines.select("l_orderkey").distinct()
    header = "00" * 8 + "0002" + "0003" + "0002" + "0001" + "00" * 12 + "0004" + "0003"
    begin = keys.select("l_orderkey", F.lit(0).cast("long").alias("l"), F.lit(0).alias("c"), F.lit(19).alias("e"), F.lit(header).alias("h"))
    end = keys.select("l_orderkey", F.lit(99).cast("long").alias("l"), F.lit(0).alias("c"), F.lit(20).alias("e"), F.lit("").alias("h"))
    made = binary_files(begin.unionByName(lines).unionByName(end), F.col("l_orderkey") % 50, F.struct("l_orderkey", "l", "h"), F.col("c"), F.col("e"), F.col("h"))
    found = tiles.tile_arrays(tiles.binary_tiles(files.framing.frame_files(made)))
    return found.select(F.col("doc_id").cast("long").alias("doc"), F.col("array_index").cast("long").alias("array_index"), F.col("rows").cast("long").alias("rows"), F.size("tiles").cast("long").alias("n"))


def bitonal_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black pixels of packed bits: a bit for each flag of a line, by a decoder in Arrow batches."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.unhex(hex_unsigned(F.col("p_partkey") * 2654435761 % 65536, 2)).alias("payload"))

    def count(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            images = [I.bitonal(x, 13, 1, 0, 0, None) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int((i.pixels == 0).sum()) for i in images], pa.int64())], names=["p_partkey", "black"])

    return rows.mapInArrow(count, "p_partkey long, black long")


def trial_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", D.trial_widths(F.col("p_size"), (F.col("p_partkey") % 20).cast("int")).alias("w"))
    return rows.select("p_partkey", F.get("w", F.lit(0)).cast("long").alias("preferred"), F.size("w").cast("long").alias("n"))


def decode_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", D.capped_size(F.col("p_partkey") * 7, F.col("p_size").cast("long") * 3, 20_000).alias("s"))
    return rows.select("p_partkey", "s.width", "s.height")


def fax_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of parts' keys coded by T.6 and T.4 and decoded again: black pixels of both."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")

    def code(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        from glyphlake.functions import fax

        for batch in batches:
            out = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits = ((np.arange(40)[None, :] + key) // (np.arange(1, 6)[:, None] + size % 5) % 3 == 0).astype(np.uint8)
                a = fax.decode_t6(fax.encode_t6(bits), 40, 5)
                b = fax.decode_t4(fax.encode_t4(bits), 40, 5)
                out.append((int(bits.sum()), int(a.sum()), int((a != bits).sum() + (b != bits).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3))], names=["p_partkey", "black", "decoded", "wrong"])

    return rows.mapInArrow(code, "p_partkey long, black long, decoded long, wrong long")


# --- drawings


def _polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as polylines of whole coordinates, in binary files."""
    rows = table(spark, sf_dir, "lineitem")
    packed = F.concat(*[hex_signed(c, 2) for c in (F.col("l_quantity"), F.col("l_linenumber"), F.col("l_linenumber") * 2, F.col("l_quantity") + 1)])
    made = binary_files(rows, F.col("l_orderkey") % 200, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), F.lit(4), F.lit(1), packed)
    return made.select("doc_id", F.concat(F.unhex(F.lit("10620000" + "11620010")), "content").alias("content"))


def svg_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _framed(_polylines(spark, sf_dir))
    b = P.bounds(P.primitives(found), state.drawing_state(found))
    return b.select(F.col("doc_id").cast("long").alias("doc"), "x_min", "y_min", "x_max", "y_max")


def svg_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole drawings of polylines."""
    made = _polylines(spark, sf_dir)
    found = _framed(made)
    none = spark.createDataFrame([], f"doc_id string, total_width long, total_height long, overlays {raster.OVERLAYS}, href string")
    drawn = svg.compose(made, materialize(P.primitives(found), "primitives"), state.drawing_state(found), state.color_table(found), none)
    return drawn.select(F.col("doc_id").cast("long").alias("doc"), F.length("svg").cast("long").alias("chars"), F.md5("svg").alias("digest"))


def element_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshot.element_histogram(files.elements(_order_statements(spark, sf_dir, region=True)))
    return found.select(F.col("doc_id").cast("long").alias("doc"), F.col("class_id").cast("long").alias("class_id"), F.col("element_id").cast("long").alias("element_id"), "count")


def prefix_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.operators.diagnostics import prefix_census as census

    rows = table(spark, sf_dir, "part")
    head = F.concat(hex_unsigned(F.col("p_size") % 3, 2), F.lit("0000"), hex_unsigned(F.col("p_partkey") % 2, 2), F.lit("0000FF"))
    made = binary_files(rows, F.col("p_partkey") % 20, F.col("p_partkey"), F.lit(4), F.lit(29), head)
    return census(files.framing.frame_files(made)).select(*[F.col(c).cast("long").alias(c) for c in ("compression", "row_padding", "bit_order", "orientation", "count")])


def command_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of lines with their first word and how many numbers they hold."""
    made = text_files(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 100, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), _statement())
    found = cleartext.tokens(cleartext.split(made))
    return found.groupBy("command").agg(F.count("*").alias("n"), F.sum(F.size("numbers")).cast("long").alias("numbers"))


QUERIES = {
    f.__name__: f
    for f in (binary_framing, text_to_elements, f32_points, i16_points, i32_points, f64_points, vdc_extents, circles_ellipses, disjoint_segments, gdp_payloads, profile_last_wins, style_carry, color_tables, default_palette, color_scaling, scope_owner, hotspots_geometry, hotspots_region, text_append, raw_images, tile_grids, tile_arrays_text, tile_positions, tile_arrays_binary, bitonal_pixels, trial_widths, decode_sizes, fax_round_trip, svg_bounds, svg_polylines, element_histogram, prefix_census, command_kinds)
}

_LINE_POINTS = "SELECT l_orderkey, count(*) AS n, CAST(min({x}) AS DOUBLE) AS x_min, CAST(max({x}) AS DOUBLE) AS x_max, CAST(min({y}) AS DOUBLE) AS y_min, CAST(max({y}) AS DOUBLE) AS y_max FROM lineitem GROUP BY l_orderkey"
_SPOTS = """
    g AS (
      SELECT l_orderkey AS k, round_even(CAST(CAST(least(min(l_quantity), min(l_linenumber)) AS FLOAT) AS DOUBLE), 0) AS x_min, round_even(CAST(CAST(least(min(l_extendedprice), min(l_discount)) AS FLOAT) AS DOUBLE), 0) AS y_min,
             round_even(CAST(CAST(greatest(max(l_quantity), max(l_linenumber)) AS FLOAT) AS DOUBLE), 0) AS x_max, round_even(CAST(CAST(greatest(max(l_extendedprice), max(l_discount)) AS FLOAT) AS DOUBLE), 0) AS y_max
      FROM lineitem GROUP BY 1
    )"""

SQL = {
    "binary_framing": """
        SELECT event_id % 50 AS doc, row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id) - 1 AS seq, CAST(event_id % 9 AS INTEGER) AS class_id, CAST(event_id % 128 AS INTEGER) AS element_id,
          CAST(octet_length(encode(CASE WHEN event_id % 3 = 0 THEN event_type ELSE props END)) AS BIGINT) AS n, md5(CASE WHEN event_id % 3 = 0 THEN event_type ELSE props END) AS digest FROM events""",
    "text_to_elements": """
        WITH e AS (SELECT l_orderkey % 100 AS doc, CASE WHEN l_linenumber <= 4 THEN 4 ELSE 2 END AS class_id, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 11 WHEN 3 THEN 12 WHEN 4 THEN 5 ELSE 6 END AS element_id,
          CASE l_linenumber WHEN 1 THEN 16 WHEN 2 THEN 16 WHEN 3 THEN 12 WHEN 4 THEN 9 + length(l_returnflag) ELSE 8 END AS b FROM lineitem WHERE l_linenumber <> 5)
        SELECT doc, CAST(class_id AS INTEGER) AS class_id, CAST(element_id AS INTEGER) AS element_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM e GROUP BY ALL""",
    "f32_points": """
        WITH p AS (SELECT vec_id, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings))
        SELECT vec_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM p GROUP BY vec_id""",
    "i16_points": _LINE_POINTS.format(x="l_quantity - 25", y="l_linenumber"),
    "i32_points": _LINE_POINTS.format(x="l_partkey * -1000", y="l_suppkey"),
    "f64_points": _LINE_POINTS.format(x="l_extendedprice", y="l_discount - CAST(0.05 AS DOUBLE)"),
    "vdc_extents": """
        WITH u AS (SELECT o_orderkey AS k, o_custkey % 65536 AS a, o_orderkey % 65536 AS b, o_custkey * 7 % 65536 AS c, o_orderkey * 13 % 65536 AS d FROM orders),
        s AS (SELECT k, CASE WHEN a > 32767 THEN a - 65536 ELSE a END AS a, CASE WHEN b > 32767 THEN b - 65536 ELSE b END AS b, CASE WHEN c > 32767 THEN c - 65536 ELSE c END AS c, CASE WHEN d > 32767 THEN d - 65536 ELSE d END AS d FROM u)
        SELECT k AS o_orderkey, CASE WHEN a <> c AND b <> d THEN CAST(least(a, c) AS DOUBLE) END AS x_min, CASE WHEN a <> c AND b <> d THEN CAST(least(b, d) AS DOUBLE) END AS y_min,
          CASE WHEN a <> c AND b <> d THEN CAST(greatest(a, c) AS DOUBLE) END AS x_max, CASE WHEN a <> c AND b <> d THEN CAST(greatest(b, d) AS DOUBLE) END AS y_max FROM s""",
    "circles_ellipses": """
        SELECT p_partkey, CASE WHEN p_size > 3 THEN CAST(p_size - 3 AS DOUBLE) END AS r, CASE WHEN p_size > 3 THEN CAST(p_size AS DOUBLE) END AS cx,
          sqrt(CAST((p_size - 1) * (p_size - 1) + (p_size + 3) * (p_size + 3) AS DOUBLE)) AS rx, sqrt(CAST(p_size * p_size + 25 AS DOUBLE)) AS ry FROM part""",
    "disjoint_segments": """
        WITH o AS (SELECT l_orderkey, CAST(l_partkey AS DOUBLE) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i FROM lineitem)
        SELECT a.l_orderkey, a.i // 2 AS k, a.x AS from_x, b.x AS to_x FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND b.i = a.i + 1 WHERE a.i % 2 = 0""",
    "gdp_payloads": "SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS x_sum, CAST(sum(l_linenumber) AS DOUBLE) AS y_sum FROM lineitem GROUP BY l_orderkey",
    "profile_last_wins": """
        SELECT user_id, coalesce(CAST(arg_max(event_id % 2, event_id) FILTER (WHERE event_type = 'view') AS BIGINT), -1) AS vdc_type, coalesce(CAST(arg_max(event_id % 40, event_id) FILTER (WHERE event_type = 'click') AS BIGINT), -1) AS vdc_precision,
          coalesce(CAST(arg_max(CASE WHEN event_id % 2 = 0 THEN 32 ELSE 64 END, event_id) FILTER (WHERE event_type NOT IN ('view', 'click')) AS BIGINT), -1) AS vdc_real_bits FROM events GROUP BY user_id""",
    "style_carry": """
        WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'click' AND event_id % 50 > 5 THEN event_id % 50 - 5 END IGNORE NULLS) OVER w AS width, last_value(CASE WHEN event_type = 'purchase' THEN event_id % 200 END IGNORE NULLS) OVER w AS color
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_id, CAST(coalesce(width, 1) AS DOUBLE) AS stroke_width, coalesce(color, -1) AS color_at FROM e WHERE event_type = 'view'""",
    "color_tables": """
        WITH c AS (SELECT c_nationkey AS nation, c_custkey % 256 AS i, max(c_custkey) AS k FROM customer GROUP BY 1, 2)
        SELECT CAST(nation AS BIGINT) AS nation, i AS color_index, printf('#%02x%02x%02x', CAST(k * 3 % 256 AS INTEGER), CAST(k * 5 % 256 AS INTEGER), CAST(k * 7 % 256 AS INTEGER)) AS color FROM c""",
    "default_palette": """
        WITH i AS (SELECT p_partkey, greatest(0, p_partkey % 300 - 20) AS i FROM part),
        g AS (SELECT p_partkey, CAST(CASE i WHEN 0 THEN 0 WHEN 1 THEN 255 WHEN 2 THEN 0 WHEN 3 THEN 47 WHEN 4 THEN 64 WHEN 5 THEN 96 WHEN 6 THEN 128 WHEN 7 THEN 160 ELSE least(255, i) END AS INTEGER) AS g FROM i)
        SELECT p_partkey, printf('#%02x%02x%02x', g, g, g) AS color FROM g""",
    "color_scaling": "SELECT o_orderkey, CAST(round_even(CAST(o_orderkey * 37 % 65536 AS DOUBLE) / 65535 * 255.0, 0) AS BIGINT) AS byte FROM orders",
    "scope_owner": """
        WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        r AS (
          SELECT user_id, 0 AS i, CAST([] AS BIGINT[]) AS stack, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS owner FROM e WHERE i = 1
          UNION ALL
          SELECT e.user_id, CAST(e.i AS INTEGER), CASE e.event_type WHEN 'signup' THEN list_append(r.stack, e.event_id) WHEN 'error' THEN r.stack[:-2] ELSE r.stack END, e.event_id,
            CASE e.event_type WHEN 'signup' THEN e.event_id ELSE r.stack[-1] END
          FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
        )
        SELECT user_id, event_id, coalesce(owner, -1) AS owner FROM r WHERE i > 0""",
    "hotspots_geometry": f"""
        WITH {_SPOTS}, o AS (SELECT o_orderkey % 100 AS doc, o_orderkey, g.* FROM orders JOIN g ON k = o_orderkey WHERE x_min < x_max AND y_min < y_max)
        SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY o_orderkey) - 1 AS index, 'O' || o_orderkey AS source_tag, CAST(x_min AS BIGINT) AS x_min, CAST(y_min AS BIGINT) AS y_min, CAST(x_max AS BIGINT) AS x_max, CAST(y_max AS BIGINT) AS y_max FROM o""",
    "hotspots_region": f"""
        WITH {_SPOTS}, o AS (
          SELECT o_orderkey % 100 AS doc, 'O' || o_orderkey AS source_tag, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'O' || o_orderkey END AS name, o_orderkey % 3 = 0 AS region, o_custkey % 100 AS c, g.* FROM orders LEFT JOIN g ON k = o_orderkey
        ), b AS (
          SELECT doc, source_tag, name, CAST(CASE WHEN region THEN c ELSE x_min END AS BIGINT) AS x_min, CAST(CASE WHEN region THEN 5 ELSE y_min END AS BIGINT) AS y_min, CAST(CASE WHEN region THEN c + 10 ELSE x_max END AS BIGINT) AS x_max, CAST(CASE WHEN region THEN 50 ELSE y_max END AS BIGINT) AS y_max,
            CASE WHEN region THEN printf('%04x0005%04x0032', CAST(c AS INTEGER), CAST(c + 10 AS INTEGER)) ELSE '' END AS raw_region_hex FROM o
        )
        SELECT * FROM b WHERE x_min < x_max AND y_min < y_max""",
    "text_append": """
        WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations WHERE text <> '')
        SELECT conv_id, min(turn) AS turn, string_agg(text, '' ORDER BY turn) AS said FROM g WHERE g > 0 GROUP BY conv_id, g""",
    "raw_images": """
        SELECT p_partkey % 40 AS doc, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) - 1 AS index, CAST(greatest(1, p_size) AS BIGINT) AS width, greatest(1, p_partkey % 7) AS height,
          printf('%02x%02x', CAST(p_partkey % 256 AS INTEGER), CAST(least(255, p_size) AS INTEGER)) AS payload FROM part""",
    "tile_grids": """
        WITH d AS (SELECT p_partkey, p_size, unnest(range(1, p_size + 1)) AS r, CAST(p_partkey % 90 + 10 AS DOUBLE) / 40 AS aspect FROM part),
        e AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(CAST(p_size // r AS DOUBLE) / r - aspect), r) AS rank FROM d WHERE p_size % r = 0)
        SELECT p_partkey, CAST(p_size // r AS BIGINT) AS cols, CAST(r AS BIGINT) AS rows FROM e WHERE rank = 1""",
    "tile_arrays_text": """
        WITH o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT l_orderkey % 50 AS doc, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey) - 1 AS array_index, CAST(2 AS BIGINT) AS cols, n FROM o""",
    "tile_positions": """
        WITH t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM lineitem)
        SELECT l_orderkey % 50 AS doc, count(*) AS n, CAST(sum(i % 2 * 2) AS BIGINT) AS x, CAST(sum(i // 2) AS BIGINT) AS y, CAST(2 * count(*) AS BIGINT) AS area FROM t WHERE i < 6 GROUP BY 1""",
    "tile_arrays_binary": """
        WITH o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT l_orderkey % 50 AS doc, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey) - 1 AS array_index, CAST(3 AS BIGINT) AS rows, n FROM o""",
    "bitonal_pixels": "SELECT p_partkey, CAST(bit_count(p_partkey * 2654435761 % 65536 // 8) AS BIGINT) AS black FROM part",
    "trial_widths": """
        WITH w AS (SELECT p_partkey, p_size AS w, p_partkey % 20 AS p FROM part)
        SELECT p_partkey, CAST(CASE WHEN p > 8 AND w % p <> 0 THEN w + p // 2 WHEN p BETWEEN 1 AND 8 THEN w + p ELSE w END AS BIGINT) AS preferred, CAST(CASE WHEN p BETWEEN 1 AND 8 THEN 2 ELSE 1 END AS BIGINT) AS n FROM w""",
    "decode_sizes": """
        WITH s AS (SELECT p_partkey, p_partkey * 7 AS w, CAST(p_size AS BIGINT) * 3 AS h FROM part), f AS (SELECT *, sqrt(20000.0 / CAST(w * h AS DOUBLE)) AS f FROM s)
        SELECT p_partkey, CASE WHEN w * h <= 20000 THEN greatest(1, w) ELSE greatest(1, CAST(round_even(w * f, 0) AS BIGINT)) END AS width, CASE WHEN w * h <= 20000 THEN greatest(1, h) ELSE greatest(1, CAST(round_even(h * f, 0) AS BIGINT)) END AS height FROM f""",
    "fax_round_trip": """
        WITH b AS (SELECT p_partkey, CAST(sum(CASE WHEN ((x + p_partkey) // (y + p_size % 5)) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS black FROM part, range(0, 40) AS r(x), range(1, 6) AS s(y) GROUP BY 1)
        SELECT p_partkey, black, black AS decoded, CAST(0 AS BIGINT) AS wrong FROM b""",
    "svg_bounds": """
        SELECT l_orderkey % 200 AS doc, CAST(least(min(l_quantity), min(l_linenumber * 2)) AS DOUBLE) AS x_min, CAST(least(min(l_linenumber), min(l_quantity + 1)) AS DOUBLE) AS y_min,
          CAST(greatest(max(l_quantity), max(l_linenumber * 2)) AS DOUBLE) AS x_max, CAST(greatest(max(l_linenumber), max(l_quantity + 1)) AS DOUBLE) AS y_max FROM lineitem GROUP BY 1""",
    "svg_polylines": """
        WITH l AS (SELECT l_orderkey % 200 AS doc, * FROM lineitem),
        b AS (SELECT doc, least(min(l_quantity), min(l_linenumber * 2)) AS x0, least(min(l_linenumber), min(l_quantity + 1)) AS y0, greatest(max(l_quantity), max(l_linenumber * 2)) AS x1, greatest(max(l_linenumber), max(l_quantity + 1)) AS y1 FROM l GROUP BY 1),
        f AS (SELECT l.doc, string_agg(printf('    <polyline points="%.3f,%.3f %.3f,%.3f" stroke="#000000" stroke-width="1.000" />', CAST(l_quantity AS DOUBLE), CAST(y1 - (l_linenumber - y0) AS DOUBLE), CAST(l_linenumber * 2 AS DOUBLE), CAST(y1 - (l_quantity + 1 - y0) AS DOUBLE)), chr(10)
          ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS f FROM l JOIN b USING (doc) GROUP BY l.doc),
        s AS (SELECT doc, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || printf('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%.3f %.3f %.3f %.3f">', CAST(x0 AS DOUBLE), CAST(y0 AS DOUBLE), CAST(greatest(1, x1 - x0) AS DOUBLE), CAST(greatest(1, y1 - y0) AS DOUBLE)) || chr(10)
          || '  <g fill="none" stroke-linecap="round" stroke-linejoin="round">' || chr(10) || f || chr(10) || '  </g>' || chr(10) || '</svg>' || chr(10) AS s FROM b JOIN f USING (doc))
        SELECT doc, length(s) AS chars, md5(s) AS digest FROM s""",
    "element_histogram": """
        WITH e AS (
          SELECT o_orderkey % 100 AS doc, 0 AS class_id, unnest([21, 22]) AS element_id FROM orders UNION ALL
          SELECT o_orderkey % 100, 9, 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey % 100, 9, 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
          SELECT l_orderkey % 100, 4, 7 FROM lineitem)
        SELECT doc, CAST(class_id AS BIGINT) AS class_id, CAST(element_id AS BIGINT) AS element_id, count(*) AS count FROM e GROUP BY ALL""",
    "prefix_census": "SELECT CAST(p_size % 3 AS BIGINT) AS compression, CAST(0 AS BIGINT) AS row_padding, CAST(p_partkey % 2 AS BIGINT) AS bit_order, CAST(0 AS BIGINT) AS orientation, count(*) AS count FROM part GROUP BY ALL",
    "command_kinds": """
        WITH c AS (SELECT CASE l_linenumber WHEN 1 THEN 'LINE' WHEN 2 THEN 'RECT' WHEN 3 THEN 'CIRCLE' WHEN 4 THEN 'TEXT' WHEN 5 THEN 'UNKNOWN' ELSE 'VDCEXT' END AS command, CASE l_linenumber WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 4 END AS k FROM lineitem)
        SELECT command, count(*) AS n, CAST(sum(k) AS BIGINT) AS numbers FROM c GROUP BY command""",
}
