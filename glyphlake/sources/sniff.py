"""Telling clear-text metafiles from binary ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphlake.functions.bytes import latin, part, size

HEAD_BYTES = 512

# Words of which a clear-text metafile holds at least one in its head.
KEYWORDS = ("BEGMF", "LINE", "POLYGON", "TEXT", "TRANSPARENCY", "TRANSPARENCYMODE", "CLIPRECT", "CLIPIND", "COLRVALUEEXT", "COLORVALUEEXTENT", "CELLARRAY", "BEGTILEARRAY", "BITONALTILE", "COLORTILE", "COLOURTILE", "DIRECTCOLORTILE", "DIRECTCOLOURTILE", "INDEXCOLORTILE", "INDEXCOLOURTILE", "MONOCHROMETILE", "APD", "BEGAPS", "ENDAPS")


def is_clear_text(content: Column) -> Column:
    """Decided by the first bytes: ASCII, few control characters, a semicolon and a keyword. False for null and empty."""
    head = latin(part(content, 0, HEAD_BYTES))
    control = F.length(head) - F.length(F.regexp_replace(head, "[\\x00-\\x08\\x0e-\\x1f]", ""))
    few = control <= F.greatest(F.lit(4), F.floor(F.length(head) / 20))
    text = (size(content) > 0) & ~head.contains("\x00") & few & head.rlike("^[\\x00-\\x7f]*$") & head.contains(";") & F.upper(head).rlike("|".join(KEYWORDS))
    return F.coalesce(text, F.lit(False))
