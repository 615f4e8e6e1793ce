"""Decoders of element parameters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphlake.functions.bytes import POINTS, bind, f32, f64, i16, i32, latin, part, points, printable, size, u8, u16, u32, unsigned

POINT = "struct<x:double,y:double>"
BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"


def cell_array(b: Column) -> Column:
    """``width, height, local_color_precision, cell_representation_mode, payload``.

    Sizes are known when the header of 20 bytes is there and neither is zero;
    only then does the payload begin after it.
    """
    full = size(b) >= 20
    sized = full & (u16(b, 12) > 0) & (u16(b, 14) > 0)
    return F.struct(
        F.when(sized, u16(b, 12)).cast("int").alias("width"),
        F.when(sized, u16(b, 14)).cast("int").alias("height"),
        F.when(full, u16(b, 16)).cast("int").alias("local_color_precision"),
        F.when(full, u16(b, 18)).cast("int").alias("cell_representation_mode"),
        F.when(sized, part(b, 20)).otherwise(b).alias("payload"),
    )


def cgm_text(b: Column) -> Column:
    """The text of the first length byte that reaches exactly to the end and is followed by printable ASCII."""
    n = size(b)
    at = F.when(n >= 2, F.sequence(F.greatest(F.lit(0), n - 256), n - 2)).otherwise(F.array().cast("array<int>"))
    first = F.get(F.filter(at, lambda i: (u8(b, i) == n - 1 - i) & printable(part(b, i + 1))), F.lit(0))
    return bind(first, lambda i: F.when(i.isNotNull(), latin(part(b, i + 1))))


def prefixed_ascii(b: Column) -> Column:
    """Printable text after its length; null if it is empty or cut."""
    n = u8(b, 0).cast("int")
    return F.when((n > 0) & (n + 1 <= size(b)) & printable(part(b, 1, n)), latin(part(b, 1, n)))


def application_property(b: Column) -> Column:
    """``key, value``: the value of the length of one byte or else two that fits, or all the rest."""
    n = u8(b, 0).cast("int")
    rest = part(b, n + 1)
    value = F.when(u8(rest, 0) + 1 == size(rest), part(rest, 1)).when(u16(rest, 0) + 2 == size(rest), part(rest, 2)).otherwise(rest)
    usable = (size(b) >= 3) & (n > 0) & (n + 1 < size(b)) & printable(part(b, 1, n))
    return F.when(usable, F.struct(latin(part(b, 1, n)).alias("key"), value.alias("value")))


def region_box(b: Column) -> Column:
    """The last eight bytes as a box, if it is not empty."""
    box = lambda t: F.struct(u16(t, 0).alias("x_min"), u16(t, 2).alias("y_min"), u16(t, 4).alias("x_max"), u16(t, 6).alias("y_max"))
    return F.when(size(b) >= 8, bind(box(F.substring(b, -8, 8)), lambda r: F.when((r["x_min"] < r["x_max"]) & (r["y_min"] < r["y_max"]), r)))


def flag(b: Column) -> Column:
    """Whether the first two bytes, or the only one, are not zero."""
    return F.when(size(b) >= 2, u16(b, 0) != 0).when(size(b) == 1, u8(b, 0) != 0)


def vdc_extent(b: Column) -> Column:
    """A box from four singles, else from four signed or else unsigned 16-bit numbers, if neither side is zero."""

    def box(values: list[Column]) -> Column:
        x1, y1, x2, y2 = (v.cast("double") for v in values)
        whole = F.struct(F.least(x1, x2).alias("x_min"), F.least(y1, y2).alias("y_min"), F.greatest(x1, x2).alias("x_max"), F.greatest(y1, y2).alias("y_max"))
        there = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
        return F.when(there & (x1 != x2) & (y1 != y2), whole)

    real = F.when(size(b) >= 16, box([f32(b, i) for i in (0, 4, 8, 12)]))
    return F.coalesce(real, F.when(size(b) >= 8, box([i16(b, i) for i in (0, 2, 4, 6)])), F.when(size(b) >= 8, box([u16(b, i) for i in (0, 2, 4, 6)])))


def profile_points(b: Column, kind: Column, precision: Column, real_bits: Column) -> Column:
    """Points as the descriptors tell; none without a type."""
    return (
        F.when((kind == 0) & (F.coalesce(precision, F.lit(16)) <= 16), points(b, "i16"))
        .when(kind == 0, points(b, "i32"))
        .when((kind == 1) & (real_bits == 64), points(b, "f64"))
        .when(kind == 1, points(b, "f32"))
        .otherwise(F.array().cast(POINTS))
    )


def _values(b: Column, n: int, kind: Column, precision: Column, real_bits: Column) -> Column:
    """n numbers from the start; whole numbers without a precision have 32 bits. Null if one is missing."""

    def take(width: int, read) -> Column:  # noqa: ANN001
        values = F.array(*[read(b, width * i).cast("double") for i in range(n)])
        return F.when((size(b) >= width * n) & F.forall(values, lambda v: v.isNotNull()), values)

    return F.when((kind == 0) & (precision <= 16), take(2, i16)).when(kind == 0, take(4, i32)).when((kind == 1) & (real_bits == 64), take(8, f64)).when(kind == 1, take(4, f32))


def xy(b: Column, kind: Column, precision: Column, real_bits: Column) -> Column:
    return bind(_values(b, 2, kind, precision, real_bits), lambda v: F.when(v.isNotNull(), F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))))


def circle(b: Column, kind: Column, precision: Column, real_bits: Column) -> Column:
    """``cx, cy, r`` with a positive radius."""
    whole = lambda v: F.struct(F.get(v, F.lit(0)).alias("cx"), F.get(v, F.lit(1)).alias("cy"), F.get(v, F.lit(2)).alias("r"))
    return bind(_values(b, 3, kind, precision, real_bits), lambda v: F.when(F.get(v, F.lit(2)) > 0, whole(v)))


def ellipse(pts: Column) -> Column:
    """``cx, cy, rx, ry`` from the centre and the ends of two conjugate diameters."""
    centre, a, b = (F.get(pts, F.lit(i)) for i in range(3))
    away = lambda p: F.sqrt(F.pow(p["x"] - centre["x"], F.lit(2.0)) + F.pow(p["y"] - centre["y"], F.lit(2.0)))
    return F.when((F.size(pts) >= 3) & (away(a) > 0) & (away(b) > 0), F.struct(centre["x"].alias("cx"), centre["y"].alias("cy"), away(a).alias("rx"), away(b).alias("ry")))


def segments(pts: Column) -> Column:
    """Points 2k and 2k + 1 as arrays of two."""
    n = F.floor(F.size(pts) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(pts, i * 2 + 1, F.lit(2)))).otherwise(F.array().cast(f"array<{POINTS}>"))


def gdp_payload(b: Column, kind: Column) -> Column:
    """Without the identifier of two bytes that the length gives away."""
    pair = F.when(kind == 1, 8).otherwise(4)
    return F.when((size(b) % pair == 2) & (size(b) > 2), part(b, 2)).otherwise(b)


def restricted_text(b: Column) -> Column:
    """``x, y, box_w, box_h, text``: unsigned numbers of two bytes, or else signed ones of four."""

    def layout(n: int) -> Column:
        read = u16 if n == 2 else i32
        w, h = read(b, 0).cast("double"), read(b, n).cast("double")
        whole = lambda t: F.struct(read(b, 2 * n).cast("double").alias("x"), read(b, 3 * n).cast("double").alias("y"), w.alias("box_w"), h.alias("box_h"), t.alias("text"))
        return bind(F.when(size(b) > 4 * n, cgm_text(part(b, 4 * n))), lambda t: F.when(t.isNotNull() & (w != 0) & (h != 0), whole(t)))

    return F.when(size(b) >= 10, F.coalesce(layout(2), layout(4)))


def scale_to_byte(v: Column, bits: int) -> Column:
    top = (1 << bits) - 1
    return F.greatest(F.lit(0), F.least(F.lit(255), v if bits <= 8 else F.bround(v.cast("double") / top * 255.0))).cast("int")


def color_table(b: Column) -> Column:
    """``array<struct<color_index, layout, r, g, b>>``: entries of each layout that the length allows.

    Layouts are components of one or two bytes after a start index of one or two;
    where they give the same index, the later layout counts.
    """
    entry = "array<struct<color_index:bigint,layout:int,r:int,g:int,b:int>>"

    def layout(rank: int, width: int, start: int) -> Column:
        n = (size(b) - start) / (3 * width)
        component = lambda at: u8(b, at).cast("int") if width == 1 else scale_to_byte(u16(b, at), 16)
        rows = F.transform(
            F.sequence(F.lit(0), n.cast("int") - 1),
            lambda i: F.struct((unsigned(b, 0, start) + i).alias("color_index"), F.lit(rank).alias("layout"), *[component(i * 3 * width + start + c * width).alias(name) for c, name in enumerate("rgb")]),
        )
        return F.when((size(b) >= 4) & (size(b) - start >= 3 * width) & ((size(b) - start) % (3 * width) == 0), rows.cast(entry)).otherwise(F.array().cast(entry))

    return F.concat(layout(0, 1, 1), layout(1, 1, 2), layout(2, 2, 1), layout(3, 2, 2))


def color_value_extent(b: Column) -> Column:
    """``array<int>`` of six: lowest red, green, blue, then highest."""
    return F.when(size(b) >= 12, F.array(*[u16(b, 2 * i) for i in range(6)])).when(size(b) >= 6, F.array(*[u8(b, i) for i in range(6)])).cast("array<int>")


# The first colours of the default palette; others are grey of their index.
DEFAULT_COLORS = {0: (0, 0, 0), 1: (255, 255, 255), 2: (0, 0, 0), 3: (47, 47, 47), 4: (64, 64, 64), 5: (96, 96, 96), 6: (128, 128, 128), 7: (160, 160, 160)}


def default_color(index: Column) -> Column:
    """``r, g, b`` of an index that no colour table sets."""
    grey = F.greatest(F.lit(0), F.least(F.lit(255), index)).cast("int")
    known = F.create_map(*[x for i, rgb in DEFAULT_COLORS.items() for x in (F.lit(i), F.struct(*[F.lit(v).alias(n) for v, n in zip(rgb, "rgb", strict=True)]))])
    return F.coalesce(F.try_element_at(known, F.least(index, F.lit(8)).cast("int")), F.struct(*[grey.alias(n) for n in "rgb"]))


def color_hex(rgb: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(rgb[n].cast("long")), 2, "0")) for n in "rgb"])


def tile_array_header(b: Column) -> Column:
    """``cols, rows, tile_width, tile_height, total_width, total_height, cell_path``, if all sizes are positive."""
    names = {"cols": 8, "rows": 10, "tile_width": 12, "tile_height": 14, "total_width": 28, "total_height": 30}
    whole = F.struct(*[u16(b, at).cast("int").alias(n) for n, at in names.items()], u32(b, 4).alias("cell_path"))
    return F.when((size(b) >= 32) & (F.least(*[u16(b, at) for at in names.values()]) > 0), whole)


def raster_prefix(b: Column) -> Column:
    """``compression, row_padding, bit_order, orientation, payload`` of a tile or raster element."""
    whole = F.struct(u16(b, 0).cast("int").alias("compression"), u16(b, 2).cast("int").alias("row_padding"), u16(b, 4).cast("int").alias("bit_order"), u8(b, 6).cast("int").alias("orientation"), part(b, 7).alias("payload"))
    return F.when(size(b) > 7, whole)


def to_int(v: Column, default: int = 1) -> Column:
    """A tolerant whole number."""
    return F.coalesce(v.try_cast("int"), F.lit(default))


def pixel_size(extent: Column) -> Column:
    """``width, height`` of an extent in whole units, if both are positive."""
    w, h = (F.bround(F.abs(extent[f"{a}_max"] - extent[f"{a}_min"])).cast("long") for a in "xy")
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


def capped_size(width: Column, height: Column, max_pixels: int) -> Column:
    """``width, height`` scaled down to at most so many pixels, about."""
    total = width.cast("double") * height
    scale = F.sqrt(F.lit(float(max_pixels)) / total)
    small = lambda v: F.greatest(F.lit(1), F.bround(v * scale)).cast("long")
    positive = (width > 0) & (height > 0)
    pick = lambda v: F.when(~positive, F.greatest(F.lit(1), v)).when(total <= max_pixels, v).otherwise(small(v)).cast("long")
    return F.struct(pick(width).alias("width"), pick(height).alias("height"))


def tile_grid(count: Column, total_w: Column, total_h: Column) -> Column:
    """``cols, rows`` of so many tiles, the divisor pair nearest to the aspect; ties to fewer rows."""
    aspect = F.when(total_h > 0, total_w.cast("double") / total_h).otherwise(total_w.cast("double"))
    divisors = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), count.cast("int"))), lambda r: count % r == 0)
    best = F.array_min(F.transform(divisors, lambda r: F.struct(F.abs((count / r) / r - aspect).alias("error"), r.alias("rows"))))
    return F.when(count <= 1, F.struct(F.lit(1).alias("cols"), F.lit(1).alias("rows"))).otherwise(bind(best, lambda x: F.struct((count / x["rows"]).cast("int").alias("cols"), x["rows"].cast("int").alias("rows"))))


def trial_widths(width: Column, row_padding: Column) -> Column:
    """Widths to try for a two-dimensionally coded tile; the first is preferred."""
    wide = F.array(width + F.floor(row_padding / 2).cast("int"))
    return F.when((row_padding > 8) & (width % row_padding != 0), wide).when((row_padding > 0) & (row_padding <= 8), F.array(width + row_padding, width)).otherwise(F.array(width))
