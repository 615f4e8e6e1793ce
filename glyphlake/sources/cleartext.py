"""Clear-text metafiles as elements, without leaving the JVM.

Each statement becomes the class, id and parameter bytes that the same element
has in a binary metafile, so all that follows reads one kind of table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import text as T
from glyphlake.functions.bytes import bind, hex_f32, hex_unsigned, latin

# Commands by what they become.
POINT_LISTS = {
    1: ("LINE", "POLYLINE"),
    2: ("DISJOINTPOLYLINE", "DISJTLINE", "DJPOLYLINE"),
    3: ("POLYMARKER", "MARKER"),
    7: ("POLYGON",),
    8: ("POLYGONSET",),
}
REALS = {
    11: (4, ("RECT", "RECTANGLE")),
    12: (3, ("CIRCLE",)),
    13: (6, ("ARC3PT", "CIRCULARARC3POINT", "CIRCULARARC3PT")),
    14: (6, ("ARC3PTCLOSE", "CIRCULARARC3POINTCLOSE", "CIRCULARARC3PTCLOSE")),
    15: (6, ("ARCCENTRE", "ARCCTR", "CIRCULARARCCENTRE")),
    16: (6, ("ARCCENTRECLOSE", "ARCCTRCLOSE", "CIRCULARARCCENTRECLOSE")),
    17: (6, ("ELLIPSE",)),
    18: (10, ("ELLIPTICALARC", "ELLIPARC")),
    19: (10, ("ELLIPTICALARCCLOSE", "ELLIPARCCLOSE")),
}
BOXES = {(2, 6): ("VDCEXT", "VDCEXTENT"), (3, 5): ("CLIPRECT", "CLIPRECTANGLE")}
SWITCHES = {(3, 6): ("CLIPIND", "CLIPINDICATOR", "CLIP"), (3, 4): ("TRANSPARENCY", "TRANSPARENCYMODE", "TRANSPMODE")}
COLOR_EXTENT = ("COLRVALUEEXT", "COLORVALUEEXTENT", "COLOURVALUEEXTENT")
RESTRICTED = ("RESTRICTEDTEXT", "RESTRTEXT")
GDP = ("GDP", "GENERALISEDDRAWINGPRIMITIVE")
LINE_COLOR = ("LINECOLR", "LINECOLOR", "LINECOLOUR")
COLOR_TABLE = ("COLRTABLE", "COLORTABLE", "COLOURTABLE")
BEGIN_APS = ("BEGAPS", "BEGINAPS", "BEGINAPPLICATIONSTRUCTURE")
END_APS = ("ENDAPS", "ENDAPPLICATIONSTRUCTURE")
APD = ("APD", "APPLICATIONDATA")
BITONAL_TILES = ("BITONALTILE", "MONOCHROMETILE")
INDEX_TILES = ("INDEXCOLORTILE", "INDEXCOLOURTILE")
COLOR_TILES = ("COLORTILE", "COLOURTILE", "DIRECTCOLORTILE", "DIRECTCOLOURTILE")
TILES = (*BITONAL_TILES, *INDEX_TILES, *COLOR_TILES)

SIZE = "struct<width:bigint,height:bigint>"


def split(files: DataFrame) -> DataFrame:
    """``doc_id, seq, offset, statement``: statements after stray quotes have been set right.

    ``seq`` is the place among the statements of the file; offsets are those of
    characters of the text set right.
    """
    named = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    rows = T.statements(named, "doc_id", T.without_stray_quotes(latin(F.col("content"))))
    clean = F.regexp_replace("statement", f"^[{T.WS}]*(?:[\"'][{T.WS}]*)*", "")
    return rows.select("doc_id", "seq", "offset", clean.alias("statement")).where(F.size(T.words(F.col("statement"))) > 0)


def command_of(statement: Column) -> Column:
    """The first word, in upper case."""
    return F.upper(F.get(T.words(statement), F.lit(0)))


def tokens(statements: DataFrame) -> DataFrame:
    """Statements with ``command`` (if they don't have it), ``words``, ``numbers`` and ``strings``. Numbers are read from the whole statement."""
    s = F.col("statement")
    named = statements if "command" in statements.columns else statements.withColumn("command", command_of(s))
    return named.withColumns({"words": T.words(s), "numbers": T.numbers(s), "strings": T.strings(s)})


def _number(i: int | Column) -> Column:
    return F.get("numbers", F.lit(i) if isinstance(i, int) else i)


def _whole(i: int) -> Column:
    return F.bround(_number(i))


def _u16s(values: list[Column]) -> Column:
    return F.concat(*[hex_unsigned(v, 2) for v in values])


def _f32s(values: Column) -> Column:
    return F.array_join(F.transform(values, hex_f32), "")


def _ascii(s: Column) -> Column:
    return F.hex(F.left(T.ascii_only(s), F.lit(255)))


def _counted(s: Column) -> Column:
    """Length byte and text of up to 255 ASCII characters."""
    return bind(_ascii(s), lambda h: F.concat(hex_unsigned(F.length(h) / 2, 1), h))


def _switch() -> Column:
    word = F.upper(F.get("words", F.lit(1)))
    by_number = F.when(_whole(0) == 0, "00").when(F.size("numbers") > 0, "01")
    return F.when(word.isin("ON", "TRUE"), "01").when(word.isin("OFF", "FALSE"), "00").otherwise(by_number)


def _component(v: Column) -> Column:
    """A colour component: a share of 255 if it lies within 0 and 1."""
    return hex_unsigned(F.bround(F.when((v >= 0) & (v <= 1), v * 255.0).otherwise(v)), 1)


def _property() -> Column:
    quoted = F.size("strings") >= 2
    bare = F.array_remove(F.transform(F.slice("words", F.lit(2), F.greatest(F.lit(0), F.size("words") - 1)), lambda w: F.regexp_replace(w, "^[,()]+|[,()]+$", "")), "")
    key = F.when(quoted, F.get("strings", F.lit(0))).when(F.size(bare) >= 2, F.get(bare, F.lit(0)))
    value = F.when(quoted, F.get("strings", F.lit(1))).when(F.size(bare) >= 2, F.array_join(F.slice(bare, F.lit(2), F.greatest(F.lit(0), F.size(bare) - 1)), " "))
    name = F.lower(T.strip(key))

    def packed(v: Column) -> Column:
        box = T.numbers(v)
        region = F.concat(*[hex_unsigned(F.bround(F.get(box, F.lit(i))), 2) for i in range(4)])
        return F.when((name == "region") & (F.size(box) >= 4), region).otherwise(F.hex(T.ascii_only(v)))

    length = lambda h: F.when(F.length(h) <= 510, hex_unsigned(F.length(h) / 2, 1)).otherwise(hex_unsigned(F.length(h) / 2, 2))
    return F.when(key.isNotNull(), bind(packed(value), lambda h: F.concat(_counted(name), length(h), h)))


def mapping() -> dict[tuple[int, int], tuple[Column, Column]]:
    """Class and id to (condition, parameters in hexadecimal) of each kind of statement."""
    command, n, quoted = F.col("command"), F.size("numbers"), F.size("strings") > 0
    last = F.get("strings", F.size("strings") - 1)
    even = F.slice("numbers", F.lit(1), n - n % 2)
    out: dict[tuple[int, int], tuple[Column, Column]] = {}
    for i, names in POINT_LISTS.items():
        out[4, i] = command.isin(*names), _f32s(even)
    for i, (k, names) in REALS.items():
        out[4, i] = command.isin(*names) & (n >= k), _f32s(F.slice("numbers", 1, k))
    for key, names in BOXES.items():
        out[key] = command.isin(*names) & (n >= 4), _u16s([_whole(i) for i in range(4)])
    for key, names in SWITCHES.items():
        out[key] = command.isin(*names) & _switch().isNotNull(), _switch()
    out[1, 10] = command.isin(*COLOR_EXTENT) & (n >= 6), _u16s([_whole(i) for i in range(6)])
    out[4, 5] = (command == "TEXT") & (n >= 2) & quoted, F.concat(hex_f32(_number(0)), hex_f32(_number(1)), _counted(last))
    out[4, 6] = (command == "APPENDTEXT") & quoted, _counted(last)
    out[4, 29] = command.isin(*RESTRICTED) & (n >= 4) & quoted, F.concat(_u16s([_whole(i) for i in range(4)]), _counted(last))
    out[4, 10] = command.isin(*GDP), _f32s(F.col("numbers"))
    pixels = F.array_join(F.transform(F.slice("numbers", F.lit(10), F.greatest(F.lit(0), n - 9)), lambda v: hex_unsigned(F.bround(v), 1)), "")
    cells = _u16s([*[_whole(i) for i in range(6)], F.greatest(F.lit(1.0), _whole(6)), F.greatest(F.lit(1.0), _whole(7)), _whole(8), F.lit(0)])
    out[4, 9] = (command == "CELLARRAY") & (n >= 9), F.concat(cells, pixels)
    out[5, 4] = command.isin(*LINE_COLOR) & (n > 0), hex_unsigned(_whole(0), 1)
    triplets = F.slice("numbers", F.lit(2), F.greatest(F.lit(0), n - 1 - (n - 1) % 3))
    out[5, 34] = command.isin(*COLOR_TABLE) & (n >= 4), F.concat(hex_unsigned(_whole(0), 1), F.array_join(F.transform(triplets, _component), ""))
    out[0, 21] = command.isin(*BEGIN_APS), _counted(F.coalesce(F.get("strings", F.lit(0)), F.lit("")))
    out[0, 22] = command.isin(*END_APS), F.lit("")
    out[9, 1] = command.isin(*APD) & _property().isNotNull(), _property()
    return out


def tile_size(numbers: Column) -> Column:
    """``width, height`` of what BEGTILEARRAY opens: the last two numbers of 14, else the seventh and eighth; null where unknown."""
    n = F.size(numbers)
    whole = lambda i: F.bround(F.get(numbers, F.lit(i) if isinstance(i, int) else i))
    pick = lambda a, b: F.struct(a.cast("long").alias("width"), b.cast("long").alias("height"))
    total = (n >= 14) & (whole(n - 2) > 0) & (whole(n - 1) > 0)
    tile = (n >= 8) & (whole(6) > 0) & (whole(7) > 0)
    return F.when(total, pick(whole(n - 2), whole(n - 1))).when(tile, pick(whole(6), whole(7))).otherwise(F.lit(None).cast(SIZE))


def _tile_as_cells(made: Callable[[Column], Column]) -> Column:
    """made(parameters) of a tile as a cell array of its array's ``size``; null if it has no payload."""
    command, statement = F.col("command"), F.col("statement")
    depth = F.when(command.isin(*INDEX_TILES), 8).when(command.isin(*COLOR_TILES), 24).otherwise(1)
    cell = lambda head: _u16s([F.coalesce("size.width", F.lit(1)), F.coalesce("size.height", F.lit(1)), F.coalesce(F.bround(F.get(head, F.lit(1))), depth), F.coalesce(F.bround(F.get(head, F.lit(4))), F.lit(0))])
    head = T.numbers(T.before_payload(statement))
    return bind(T.hex_payload(statement), lambda payload: F.when(payload != "", made(F.concat(F.lit("00" * 12), bind(head, cell), payload))))


def elements(files: DataFrame) -> DataFrame:
    """``doc_id, seq, class_id, element_id, parameters, offset, error`` of clear-text files (``doc_id, content``)."""
    rows = split(files).withColumn("command", command_of(F.col("statement")))
    command = F.col("command")
    # sizes hold from one BEGTILEARRAY to the end of its array; a struct around them keeps "unknown" from being skipped
    opened = F.when(command == "BEGTILEARRAY", F.struct(bind(T.numbers(F.col("statement")), tile_size).alias("size"))).when(command == "ENDTILEARRAY", F.struct(F.lit(None).cast(SIZE).alias("size")))
    so_far = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # by the partitions and the order of the offsets, so it needs no shuffle or sort of its own
    rows = tokens(rows.withColumn("size", F.last(opened, ignorenulls=True).over(so_far)["size"]))
    kinds = mapping()
    element = lambda key, hex_: F.array(F.struct(F.lit(key[0]).alias("class_id"), F.lit(key[1]).alias("element_id"), hex_.alias("hex")))
    choice = reduce(lambda c, k: c.when(kinds[k][0], element(k, kinds[k][1])), kinds, F.when(command.isin(*TILES), _tile_as_cells(lambda hex_: element((4, 9), hex_))))
    # exploded, not filtered: a filter would evaluate the choice a second time
    found = rows.select("doc_id", "seq", "offset", F.explode_outer(choice).alias("e")).where("e.class_id is not null")
    return found.select("doc_id", "seq", "e.class_id", "e.element_id", F.unhex("e.hex").alias("parameters"), "offset", F.lit(None).cast("string").alias("error"))
