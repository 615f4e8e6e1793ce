"""Column expressions over big-endian binary values.

Positions are zero-based. A read past the end of its input is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def size(b: Column) -> Column:
    return F.octet_length(b)


def part(b: Column, at: int | Column, n: int | Column | None = None) -> Column:
    """Bytes from a position on, up to n of them."""
    start = F.lit(at) if isinstance(at, int) else at
    length = size(b) if n is None else F.lit(n) if isinstance(n, int) else n
    return F.substring(b, start + 1, F.greatest(length, F.lit(0)))


def unsigned(b: Column, at: int | Column, n: int) -> Column:
    """n bytes (up to 7) as a number."""
    return F.when(F.lit(at) + n <= size(b) if isinstance(at, int) else at + n <= size(b), F.conv(F.hex(part(b, at, n)), 16, 10).cast("long"))


def signed(b: Column, at: int | Column, n: int) -> Column:
    half, whole = 1 << (8 * n - 1), 1 << (8 * n)
    return bind(unsigned(b, at, n), lambda v: F.when(v >= half, v - whole).otherwise(v))


def u8(b: Column, at: int | Column) -> Column:
    return unsigned(b, at, 1)


def u16(b: Column, at: int | Column) -> Column:
    return unsigned(b, at, 2)


def u32(b: Column, at: int | Column) -> Column:
    return unsigned(b, at, 4)


def i16(b: Column, at: int | Column) -> Column:
    return signed(b, at, 2)


def i32(b: Column, at: int | Column) -> Column:
    return signed(b, at, 4)


def _two_to(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def f32(b: Column, at: int | Column) -> Column:
    """IEEE 754 single; null for infinities and NaN."""

    def value(v: Column) -> Column:
        e, m = F.shiftright(v, 23).bitwiseAND(F.lit(255)), v.bitwiseAND(F.lit(0x7FFFFF)).cast("double")
        size_ = F.when(e == 0, m * F.lit(2.0**-149)).otherwise((m / F.lit(2.0**23) + 1) * _two_to(e - 127))
        return F.when(e < 255, F.when(v >= 1 << 31, -size_).otherwise(size_))

    return bind(u32(b, at), value)


def f64(b: Column, at: int | Column) -> Column:
    """IEEE 754 double; null for infinities and NaN."""

    def value(v: Column) -> Column:
        hi, lo = v["hi"], v["lo"]
        e = F.shiftright(hi, 20).bitwiseAND(F.lit(2047))
        m = hi.bitwiseAND(F.lit(0xFFFFF)).cast("double") * F.lit(2.0**32) + lo.cast("double")
        # two steps keep subnormal values exact: m counts units of 2**-1074
        size_ = F.when(e == 0, m * F.lit(5e-324)).otherwise((m / F.lit(2.0**52) + 1) * _two_to(e - 1023))
        return F.when(e < 2047, F.when(hi >= 1 << 31, -size_).otherwise(size_))

    start = F.lit(at) if isinstance(at, int) else at
    return bind(F.struct(u32(b, start).alias("hi"), u32(b, start + 4).alias("lo")), value)


READERS = {"i16": (2, i16), "i32": (4, i32), "f32": (4, f32), "f64": (8, f64)}


def points(b: Column, kind: str) -> Column:
    """Pairs of coordinates as an array of points; pairs that are not finite are left out."""
    width, read = READERS[kind]
    n = F.floor(size(b) / (2 * width)).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda i: F.struct(read(b, i * 2 * width).cast("double").alias("x"), read(b, i * 2 * width + width).cast("double").alias("y")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def latin(b: Column) -> Column:
    """Bytes as characters of the same numbers; decoding as ASCII would fail on others."""
    return F.decode(b, "ISO-8859-1")


def printable(b: Column) -> Column:
    """Whether all bytes are printable ASCII; true for none."""
    return latin(b).rlike("^[\\x20-\\x7E]*$")


# --- hexadecimal text of numbers, for building binary values


def hex_unsigned(v: Column, n: int) -> Column:
    """v as n bytes, clamped to what they hold."""
    return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit((1 << (8 * n)) - 1), v.cast("long")))), 2 * n, "0")


def hex_signed(v: Column, n: int) -> Column:
    return F.right(F.lpad(F.hex(v.cast("long")), 16, "0"), F.lit(2 * n))


def _exponent(a: Column, least: int) -> Column:
    """floor(log2(a)) of a positive double, at least ``least``."""

    def fix(e: Column) -> Column:
        return F.when(_two_to(e) > a, e - 1).when(_two_to(e + 1) <= a, e + 1).otherwise(e)

    return F.greatest(F.lit(least), bind(F.floor(F.log2(a)).cast("long"), fix))


def hex_f32(v: Column) -> Column:
    """The single nearest to v as 8 hexadecimal digits; too large values become infinite."""

    def bits(x: Column) -> Column:
        a = F.abs(x)
        normal = bind(_exponent(a, -126), lambda e: F.when(a < F.lit(2.0**-126), (a * F.lit(2.0**149)).cast("long")).otherwise((e + 127) * (1 << 23) + ((a / _two_to(e) - 1) * F.lit(2.0**23)).cast("long")))
        size_ = F.when(a == 0, F.lit(0).cast("long")).when(a == F.lit(float("inf")), F.lit(0x7F800000).cast("long")).when(F.isnan(x), F.lit(0x7FC00000).cast("long")).otherwise(normal)
        # a negative zero is below nothing, but shown with its sign
        return F.when(x.cast("string").startswith("-"), size_ + (1 << 31)).otherwise(size_)

    return F.lpad(F.hex(bind(v.cast("float").cast("double"), bits)), 8, "0")


def hex_f64(v: Column) -> Column:
    """A finite double as 16 hexadecimal digits."""

    def bits(a: Column) -> Column:
        return bind(
            _exponent(a, -1022),
            lambda e: F.when(a < F.lit(2.0**-1022), (a / F.lit(5e-324)).cast("long")).otherwise((e + 1023) * (1 << 52) + ((a / _two_to(e) - 1) * F.lit(2.0**52)).cast("long")),
        )

    size_ = F.when(v == 0, F.lit(0).cast("long")).otherwise(bind(F.abs(v.cast("double")), bits))
    digits = F.lpad(F.hex(size_), 16, "0")
    head = F.conv(F.substring(digits, 1, 1), 16, 10).cast("int")
    return F.when(v < 0, F.concat(F.hex((head + 8).cast("long")), F.substring(digits, 2, 15))).otherwise(digits)
