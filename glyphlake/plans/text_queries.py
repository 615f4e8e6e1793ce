"""Queries that run the text and byte operators on tables as they are, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import text as T
from glyphlake.functions.bytes import bind
from glyphlake.operators import diagnostics
from glyphlake.plans.synth import table
from glyphlake.sources.sniff import is_clear_text

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}]"
_PIECES = r"""regexp_extract_all(html, '(?:[^;"'']|"[^"]*"?|''[^'']*''?)+')"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.statements(table(spark, sf_dir, "pages"), "page_id", F.col("html"))


def split_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("statements"), F.sum(F.length("statement")).alias("chars"))


def statement_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("page_id", F.col("offset").alias("begins"), F.length("statement").cast("long").alias("chars"))


def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).groupBy(F.get(T.words(F.col("statement")), F.lit(0)).alias("word")).agg(F.count("*").alias("n"))


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "pages").select("page_id", T.numbers(F.col("html")).alias("v"))
    return numbers.select("page_id", F.size("v").cast("long").alias("n"), F.array_min("v").alias("lowest"), F.array_max("v").alias("highest"))


def quoted_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = table(spark, sf_dir, "pages").select("page_id", T.strings(F.col("html")).alias("v"))
    return strings.select("page_id", F.size("v").cast("long").alias("n"), F.length(F.array_join("v", "")).cast("long").alias("chars"))


def hex_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("COLORTILE 2 8 '' "), F.hex("props")).alias("s"))
    return said.select("event_id", F.md5(F.unhex(T.hex_payload(F.col("s")))).alias("digest"))


def sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", is_clear_text(F.col("html").cast("binary")).alias("is_text"))
    return pages


def escaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.escaped(F.col("text"))).alias("digest"))


def fixed_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three decimals of prices over an odd divisor, which leaves no ties."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.fixed3(F.col("o_totalprice") / 7).alias("shown"), T.rounded(F.col("o_totalprice") / 8).alias("whole"))


def payload_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("payload"))
    top = F.array_join(F.transform("top_bytes", lambda x: F.concat_ws(":", x["byte"], x["count"])), " ")
    return diagnostics.analyze(rows, ["page_id"]).select("page_id", F.col("length").cast("long").alias("n"), "ascii_ratio", "entropy_bits_per_byte", top.alias("top"), "likely_binary_payload")


def ascii_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", diagnostics.ascii_runs(F.translate("props", '"', "\x01").cast("binary")).alias("r"))
    return rows.select("event_id", F.size("r").cast("long").alias("runs"), F.aggregate("r", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("bytes"))


def head_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", diagnostics.head_words(F.col("props").cast("binary")).alias("w"))
    return rows.select("event_id", F.size("w").cast("long").alias("n"), F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x).alias("total"))


def leading_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.unhex(F.concat(F.expr("repeat('FF', p_size)"), F.lit("00FF")))
    return table(spark, sf_dir, "part").select("p_partkey", bind(payload, lambda b: diagnostics.leading_run(b)).cast("long").alias("run"))


QUERIES = {f.__name__: f for f in (split_statements, statement_offsets, first_words, number_tokens, quoted_strings, hex_payloads, sniffed, escaped_text, fixed_decimals, payload_spread, ascii_runs, head_words, leading_runs)}

_STRIPPED = rf"""regexp_replace(regexp_replace(x, '^{_SPACE}+', ''), '{_SPACE}+$', '')"""
_NUMBERS = r"regexp_extract_all(html, '[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?')"
_HEAD = "substr(html, 1, 512)"
_WORDS = "LINE|POLYGON|TEXT|TRANSPARENCY|CLIPRECT|CLIPIND|COLRVALUEEXT|COLORVALUEEXTENT|CELLARRAY|BEGTILEARRAY|COLORTILE|COLOURTILE|BITONALTILE|MONOCHROMETILE|APD|BEGAPS|ENDAPS|BEGMF"

SQL = {
    "split_statements": rf"""
        WITH s AS (SELECT page_id, {_STRIPPED} AS s FROM (SELECT page_id, unnest({_PIECES}) AS x FROM pages))
        SELECT page_id, count(*) AS statements, CAST(sum(length(s)) AS BIGINT) AS chars FROM s WHERE s <> '' GROUP BY page_id""",
    "statement_offsets": rf"""
        WITH t AS (
          SELECT page_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i
          FROM (SELECT page_id, regexp_extract_all(html, '[^;"'']+|"[^"]*"?|''[^'']*''?|;') AS tokens FROM pages)
        ), g AS (
          SELECT *, sum(CASE WHEN tok = ';' THEN 1 ELSE 0 END) OVER w AS grp, sum(length(tok)) OVER w - length(tok) AS skipped
          FROM t WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)
        ), s AS (
          SELECT page_id, grp, min(skipped) AS begins, string_agg(tok, '' ORDER BY i) AS x FROM g WHERE tok <> ';' GROUP BY page_id, grp
        )
        SELECT page_id, CAST(begins AS BIGINT) AS begins, length({_STRIPPED}) AS chars FROM s WHERE {_STRIPPED} <> ''""",
    "first_words": rf"""
        WITH s AS (SELECT {_STRIPPED} AS s FROM (SELECT unnest({_PIECES}) AS x FROM pages))
        SELECT regexp_extract(s, '^[^\t-\r\x1c-\x20\x{{85}}\x{{a0}}]+') AS word, count(*) AS n FROM s WHERE s <> '' GROUP BY 1""",
    "number_tokens": f"""
        WITH v AS (SELECT page_id, list_transform({_NUMBERS}, lambda x: CAST(x AS DOUBLE)) AS v FROM pages)
        SELECT page_id, len(v) AS n, list_min(v) AS lowest, list_max(v) AS highest FROM v""",
    "quoted_strings": """
        WITH v AS (SELECT page_id, regexp_extract_all(html, '"[^"]*"|''[^'']*''') AS v FROM pages)
        SELECT page_id, len(v) AS n, CAST(coalesce(list_sum(list_transform(v, lambda x: length(x) - 2)), 0) AS BIGINT) AS chars FROM v""",
    "hex_payloads": "SELECT event_id, md5(props) AS digest FROM events",
    "sniffed": rf"""
        SELECT page_id, NOT regexp_matches({_HEAD}, '[^\x00-\x7f]') AND contains({_HEAD}, ';') AND regexp_matches(upper({_HEAD}), '{_WORDS}')
          AND length({_HEAD}) - length(regexp_replace({_HEAD}, '[\x01-\x08\x0e-\x1f]', '', 'g')) <= greatest(4, length({_HEAD}) // 20) AS is_text
        FROM pages""",
    "escaped_text": """
        SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM conversations""",
    "fixed_decimals": "SELECT o_orderkey, printf('%.3f', o_totalprice / 7) AS shown, CAST(round_even(o_totalprice / 8, 0) AS BIGINT) AS whole FROM orders",
    "payload_spread": """
        WITH b AS (SELECT page_id, hex(encode(html)) AS h FROM pages),
        e AS (SELECT page_id, unnest(range(0, length(h) // 2)) AS i, h FROM b),
        c AS (SELECT page_id, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS x, count(*) AS n, min(i) AS first FROM e GROUP BY 1, 2),
        r AS (SELECT *, sum(n) OVER (PARTITION BY page_id) AS total, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS rank FROM c)
        SELECT page_id, CAST(max(total) AS BIGINT) AS n,
          round(CAST(sum(CASE WHEN x BETWEEN '20' AND '7E' THEN n ELSE 0 END) AS DOUBLE) / max(total), 4) AS ascii_ratio,
          round(-sum(n / total * log2(n / total)), 4) AS entropy_bits_per_byte,
          string_agg('0x' || lower(x) || ':' || n, ' ' ORDER BY rank) FILTER (WHERE rank <= 8) AS top,
          CAST(sum(CASE WHEN x BETWEEN '20' AND '7E' THEN n ELSE 0 END) AS DOUBLE) / max(total) < 0.45 AND -sum(n / total * log2(n / total)) > 6.5 AS likely_binary_payload
        FROM r GROUP BY page_id""",
    "ascii_runs": r"""
        WITH r AS (SELECT event_id, regexp_extract_all(replace(props, '"', chr(1)), '[\x20-\x7E]{4,}')[1:8] AS r FROM events)
        SELECT event_id, len(r) AS runs, CAST(coalesce(list_sum(list_transform(r, lambda x: length(x))), 0) AS BIGINT) AS bytes FROM r""",
    "head_words": """
        WITH h AS (SELECT event_id, hex(encode(props)) AS h, least(64, octet_length(encode(props)) - 1) AS m FROM events),
        w AS (SELECT event_id, list_transform(range(0, greatest(0, (m + 1) // 2)), lambda i: CAST('0x' || substr(h, CAST(4 * i + 1 AS BIGINT), 4) AS BIGINT)) AS w FROM h)
        SELECT event_id, len(w) AS n, CAST(coalesce(list_sum(w), 0) AS BIGINT) AS total FROM w""",
    "leading_runs": "SELECT p_partkey, CAST(p_size AS BIGINT) AS run FROM part",
}
