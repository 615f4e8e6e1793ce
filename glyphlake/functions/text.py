"""Column expressions over text: statements, numbers, quoted strings, numbers as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of characters up to 255, as a character class.
WS = "\\t-\\r\\x1c-\\x20\\x85\\xa0"
#: Stands for a statement's end in joined tokens; no character up to 255.
_END = "\ue000"
_TOKENS = "[^;\"']++|\"[^\"]*+\"?+|'[^']*+'?+|;"
NUMBER = "[-+]?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{WS}]+|[{WS}]+$", "")


def words(s: Column) -> Column:
    return F.array_remove(F.split(s, f"[{WS}]+"), "")


def without_stray_quotes(s: Column) -> Column:
    """A quote that stands where a command begins becomes a blank."""
    return F.regexp_replace(s, f"(^|;)[{WS}]*[\"'](?=[A-Za-z])", "$1 ")


def pieces(s: Column) -> Column:
    """Text between semicolons outside of quotes, as it is; an open quote holds the rest."""
    tokens = F.transform(F.regexp_extract_all(s, F.lit(_TOKENS), F.lit(0)), lambda t: F.when(t == ";", F.lit(_END)).otherwise(t))
    return F.split(F.array_join(tokens, ""), _END)


def statements(rows: DataFrame, key: str, text: Column, offsets: bool = True) -> DataFrame:
    """``key, seq, offset, statement``: the statements of each text that are not blank, and where they begin.

    The offset is that of the first character after the semicolon before: a
    running sum over the rows of the pieces, so long texts cost no more than in
    proportion. Without ``offsets`` there is no shuffle.
    """
    each = rows.select(key, F.posexplode(pieces(text)).alias("seq", "piece")).withColumn("seq", F.col("seq").cast("long"))
    if offsets:
        before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("offset", F.coalesce(F.sum(F.length("piece") + 1).over(before), F.lit(0)).cast("long"))
    return each.withColumn("statement", strip(F.col("piece"))).where("statement <> ''").drop("piece")


def numbers(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def strings(s: Column) -> Column:
    """Contents of quoted runs, without their quotes."""
    return F.transform(F.regexp_extract_all(s, F.lit("\"([^\"]*)\"|'([^']*)'"), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def ascii_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^\\x00-\\x7F]", "")


def _even(h: Column) -> Column:
    return F.left(h, F.length(h) - F.length(h) % 2)


def hex_payload(s: Column) -> Column:
    """The binary payload written in a statement, as hexadecimal text of even length; empty if none.

    All runs of hexadecimal digits after '' (or else "", or else of the whole
    statement); where these are fewer than two digits, whole words of digits, or
    else long runs.
    """
    tail = F.when(F.instr(s, "''") > 0, F.substring(s, F.instr(s, "''") + 2, F.length(s))).when(F.instr(s, '""') > 0, F.substring(s, F.instr(s, '""') + 2, F.length(s))).otherwise(s)
    runs = _even(F.array_join(F.regexp_extract_all(tail, F.lit("[0-9A-Fa-f]+"), F.lit(0)), ""))
    bare = F.transform(words(s), lambda w: F.regexp_replace(w, "^['\",()]+|['\",()]+$", ""))
    whole = F.array_join(F.filter(bare, lambda w: w.rlike("^(?:[0-9A-Fa-f]{2}){2,}$")), "")
    long_runs = _even(F.array_join(F.regexp_extract_all(s, F.lit("[0-9A-Fa-f]{32,}"), F.lit(0)), ""))
    return F.coalesce(F.nullif(runs, F.lit("")), F.nullif(whole, F.lit("")), long_runs)


def before_payload(s: Column) -> Column:
    """The part of a statement before its payload marker."""
    return F.substring_index(F.substring_index(s, "''", 1), '""', 1)


def fixed3(x: Column) -> Column:
    """Three decimals, ties to even."""
    return F.call_function("format_number", x.cast("double"), F.lit("0.000"))


def round3(x: Column) -> Column:
    return fixed3(x).cast("double")


def rounded(x: Column) -> Column:
    """To a whole number, ties to even."""
    return F.bround(x.cast("double")).cast("long")


def escaped(s: Column) -> Column:
    """Text for XML, with both quotes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s
