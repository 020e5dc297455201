"""Checks as queries: each rule gives the rows that break it, so nothing comes out where all hold."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """A frozen file is not what it was."""


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, key) of all rules; a rule's first column is its key."""
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("rule"), F.col(df.columns[0]).cast("string").alias("key")) for name, df in rules.items()])


def not_allowed(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.filter(F.col(column).isNull() | ~F.col(column).isin(allowed))


def without_match(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows that nothing on the other side answers to."""
    return rows.join(other.select(*on), on, "left_anti").select(*rows.columns)


def repeated(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """The first key of each group that should have been one row."""
    return rows.groupBy(*by).agg(F.min(key).alias(key), F.count("*").alias("n")).filter("n > 1").select(key, "n")


def wrong_pattern(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    return rows.filter(F.col(column).isNull() | ~F.rlike(F.col(column), F.lit(f"^(?:{pattern})$")))


def unmatched_quotes(evidence: DataFrame, sections: DataFrame, on: list[str], quote: str = "quote", text: str = "text") -> DataFrame:
    """Quotes that no variant of their section holds, white space aside."""
    from ..functions.text import collapse_whitespace

    keyed = evidence.withColumn("__row", F.xxhash64(*evidence.columns))
    held = keyed.join(sections.select(*on, text), on).filter(F.contains(collapse_whitespace(F.col(text)), collapse_whitespace(F.col(quote))))
    return keyed.join(held.select("__row").distinct(), "__row", "left_anti").drop("__row")


def not_contained(rows: DataFrame, inner: str, outer: str) -> DataFrame:
    """Rows whose one array has members that the other lacks."""
    return rows.filter(F.size(F.array_except(inner, outer)) > 0)


def asymmetric_groups(rows: DataFrame, group: str, language: str, shared: list[str], languages: tuple[str, ...] = ("en", "vi")) -> DataFrame:
    """Parallel groups that don't have one row of each language, or whose shared fields differ."""
    same = F.count_distinct(F.to_json(F.struct(*shared)))
    found = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(language)).alias("langs"), same.alias("kinds"))
    return found.filter((F.col("langs") != F.array(*[F.lit(x) for x in sorted(languages)])) | (F.col("kinds") > 1)).select(group)


def chunk_violations(chunks: DataFrame, docs: DataFrame, name: str, most: int, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """Chunks that are too long, are not the slice that they say, have another configuration's id, or leave a gap in the numbering."""
    both = chunks.join(docs.select(id_col, text_col), id_col)
    number = F.regexp_extract("chunk_id", r":(\d+)$", 1).cast("int")
    gaps = chunks.groupBy(id_col).agg(F.count("*").alias("n"), F.max(number).alias("top"), F.count_distinct("chunk_id").alias("ids")).filter("top <> n - 1 or ids <> n").select(id_col)
    return violations({
        "too_long": chunks.filter(F.col("char_end") - F.col("char_start") > most).select("chunk_id"),
        "not_a_slice": both.filter(F.substring(F.col(text_col), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("display_text")).select("chunk_id"),
        "wrong_id": chunks.filter(~F.startswith("chunk_id", F.concat(F.col(id_col).cast("string"), F.lit(f":{name}:")))).select("chunk_id"),
        "gap": gaps,
    })


def frozen(contents: dict[str, bytes], snapshot: dict[str, str]) -> None:
    """Raises unless every file of the snapshot is there with its SHA-256."""
    bad = [p for p, h in snapshot.items() if p not in contents or hashlib.sha256(contents[p]).hexdigest() != h]
    if bad:
        raise IntegrityError(f"changed or missing: {bad}")


def differing(old: dict, new: dict) -> list[str]:
    """Settings in which a run that is to be resumed differs."""
    return sorted(k for k in old.keys() | new.keys() if old.get(k) != new.get(k))
