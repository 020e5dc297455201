"""What registered queries share: tables, and SQL fragments of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL it is checked against."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: White space as in ``functions.text``, in the syntax of RE2.
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


#: Fixed windows of documents: doc_id, window, char_start, char_end, display_text.
WINDOWS_SQL = f"""
windows AS (
  SELECT doc_id, w AS "window", off + lead_n AS char_start, off + lead_n + length(kept) AS char_end, kept AS display_text FROM (
    SELECT doc_id, w, off, length(regexp_extract(part, '^[{WS}]*')) AS lead_n, {sql_strip('part')} AS kept FROM (
      SELECT doc_id, w, 1400 * w AS off, substring(text, CAST(1400 * w + 1 AS BIGINT), 1600) AS part FROM (
        SELECT doc_id, text, unnest(range(0, 1 + CAST(ceil(greatest(length(text) - 1600, 0) / 1400.0) AS BIGINT))) AS w FROM documents WHERE length(text) > 0))) WHERE kept <> '')
"""
