"""What an evaluation reads and writes: question files, runs, settings, and its tables as CSV and JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import latest

RECORD_KEY, JUDGEMENT_KEY = ["case_id", "arm", "mode"], ["case_id", "arm", "answer_sha256", "judge_prompt_version"]
CSV_COLUMNS = ("case_id", "arm", "language", "answerable", "result", "expected_sources", "citations", "section_hit_5", "evidence_hit_5", "latency_total_ms")


class SettingsError(ValueError):
    """A setting that is not what it has to be."""


def build_cases(blueprint: DataFrame, wording: DataFrame, key: str = "blueprint_id") -> DataFrame:
    """Questions from their plan and their wording; a plan without wording, or either of them twice, raises."""
    n = wording.groupBy(key).agg(F.count("*").alias("__n"))
    twice = blueprint.groupBy(key).agg(F.count("*").alias("__m"))
    checked = blueprint.join(n, key, "left").join(twice, key)
    bad = F.coalesce(F.col("__n"), F.lit(0)) != 1
    once = F.when(bad | (F.col("__m") != 1), F.raise_error(F.concat(F.lit("not exactly one wording for "), F.col(key)))).otherwise(F.col(key))
    extra = [c for c in wording.columns if c != key]
    rows = checked.withColumn(key, once).drop("__n", "__m").join(wording, key, "left")
    return rows.withColumn("question_chars", F.length("question")) if "question" in extra else rows


def unplanned(blueprint: DataFrame, wording: DataFrame, key: str = "blueprint_id") -> DataFrame:
    """Wordings that no plan asks for."""
    return wording.join(blueprint.select(key), key, "left_anti")


def load_run(records: DataFrame, judgements: DataFrame) -> DataFrame:
    """The latest record of each case with its latest judgement, where there is one. A record's answer is matched by its hash."""
    rows = latest(records, RECORD_KEY)
    verdicts = latest(judgements, JUDGEMENT_KEY).select("case_id", "arm", "answer_sha256", F.col("status").alias("judge_status"), "verdict")
    return rows.withColumn("answer_sha256", F.sha2("answer", 256)).join(verdicts, ["case_id", "arm", "answer_sha256"], "left")


def select_cases(cases: DataFrame, split: str, ids: list[str] | None = None) -> DataFrame:
    """Cases of a split, or of those the named ones; an unknown id, or one of another split, raises before anything runs."""
    if ids is None:
        return cases.filter(F.col("split") == split)
    found = {r["id"]: r["split"] for r in cases.filter(F.col("id").isin(ids)).select("id", "split").collect()}
    unknown, other = [i for i in ids if i not in found], [i for i in ids if found.get(i, split) != split]
    if unknown or other:
        raise SettingsError(f"unknown cases {unknown}, cases of another split {other}")
    return cases.filter(F.col("id").isin(ids))


def remaining(cases: DataFrame, records: DataFrame, arm: str, mode: str) -> DataFrame:
    """Cases that a resumed run still has to do: those without a good record; failed ones are tried again."""
    done = latest(records, RECORD_KEY).filter((F.col("status") == "ok") & (F.col("arm") == arm) & (F.col("mode") == mode))
    return cases.join(done.select(F.col("case_id").alias("id")), "id", "left_anti")


def flag(env: Mapping[str, str], name: str, default: bool) -> bool:
    value = env.get(name, "").strip().lower()
    if not value:
        return default
    if value in ("1", "true", "yes", "on"):
        return True
    if value in ("0", "false", "no", "off"):
        return False
    raise SettingsError(f"{name} is neither true nor false: {value!r}")


def number(env: Mapping[str, str], name: str, default: int, low: int, high: int) -> int:
    value = env.get(name, "").strip()
    try:
        n = int(value) if value else default
    except ValueError as e:
        raise SettingsError(f"{name} is no number: {value!r}") from e
    if not low <= n <= high:
        raise SettingsError(f"{name} is not in {low}..{high}: {n}")
    return n


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = CSV_COLUMNS) -> None:
    """A header and fixed columns, arrays joined by semicolons; columns that the rows lack stay empty."""
    kinds = dict(rows.dtypes)
    out = [(F.array_join(c, ";") if kinds[c].startswith("array") else F.col(c)).cast("string").alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*out).write.mode("overwrite").option("header", True).csv(path)


def summary_json(rows: DataFrame) -> DataFrame:
    """One JSON document for each row, nulls kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def check_resumable(old: dict, new: dict) -> None:
    """Raises where a run that is to be resumed has other settings than before."""
    from ..operators.validation import differing

    if bad := differing(old, new):
        raise SettingsError(f"a resumed run keeps its settings; these differ: {bad}")
