"""Queries of comparing two arms, of judging, and of the checks before and after runs, over rows made from the tables.

Each labelled document is a case that both arms have answered; a number of the document and the arm decides how well.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import experiment as X
from ..operators import judging as J
from ..sources import store
from .base import WINDOWS_SQL, query, table

_HITS = [(f"{level}{of}_hit_{k}", least + k) for level, of, least in (("source", "", 4), ("source", "_strict", 3), ("section", "", 3), ("section", "_strict", 2), ("evidence", "", 1)) for k in X.HIT_KS]
#: Columns of the rows, in SQL that both engines read; k is from 0 to 10, s is 0 in arm A and 1 in arm B.
_COLUMNS = {
    "label": "CASE WHEN answerable THEN CASE WHEN k < 5 THEN 'correct' WHEN k < 7 THEN 'partially_correct' WHEN k < 9 THEN 'incorrect' WHEN k < 10 THEN 'false_refusal' END WHEN k < 8 THEN 'correct_refusal' ELSE 'hallucination' END",
    **{name: f"CASE WHEN answerable THEN CASE WHEN k < {limit} THEN 1 ELSE 0 END END" for name, limit in _HITS},
    "section_mrr": "CASE WHEN answerable THEN CASE k % 4 WHEN 0 THEN 1.0D WHEN 1 THEN 0.5D WHEN 2 THEN 0.25D ELSE 0.0D END END",
    "section_strict_mrr": "CASE WHEN answerable THEN CASE k % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 0.5D ELSE 0.0D END END",
    "grounded": "CASE WHEN answerable AND k < 9 THEN k % 4 <> 0 END",
    "answered": "answerable AND k < 9",
    "support_rate": "CASE WHEN answerable AND k < 9 THEN CASE WHEN k % 3 = 0 THEN 0.5D WHEN k % 7 <> 1 THEN 1.0D END END",
    "section_precision": "CASE WHEN answerable AND k < 9 THEN CASE WHEN k % 5 = 1 THEN 0.5D ELSE 1.0D END END",
    "latency_retrieve_ms": "CAST(case_id % 50 + s AS DOUBLE)", "latency_generate_ms": "CASE WHEN k < 10 THEN CAST(case_id % 900 + 7 * s AS DOUBLE) END",
    "latency_embed_query_ms": "CAST(case_id % 13 AS DOUBLE)", "latency_total_ms": "CAST(case_id % 700 + 3 * s AS DOUBLE)",
    "prompt_tokens": "CASE WHEN k < 10 THEN n_chars + s END", "output_tokens": "CASE WHEN k < 10 THEN case_id % 40 END",
}
_BASE = "SELECT *, (case_id * 7 + s * (case_id % 5)) % 11 AS k FROM (SELECT doc_id AS case_id, lang AS language, doc_id % 3 = 0 AS parallel, quality = 1 AS answerable, n_chars, arm, CASE WHEN arm = 'A' THEN 0 ELSE 1 END AS s FROM cases)"
ROWS_SQL = f"""cases AS (SELECT d.doc_id, lang, quality, n_chars, arm FROM labels l JOIN documents d ON d.doc_id = l.doc_id, (SELECT unnest(['A', 'B']) AS arm)),
rows_ AS (SELECT *, {', '.join(f'{re.sub(r"([0-9][.][0-9]+)D", r"CAST(\1 AS DOUBLE)", v)} AS {n}' for n, v in _COLUMNS.items())} FROM ({_BASE}))"""


def _rows(spark, d):
    return _answered(table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id"))


def _answered(cases):
    """Rows of both arms for cases (doc_id, quality, lang, n_chars)."""
    cases = cases.withColumn("arm", F.explode(F.array(F.lit("A"), F.lit("B"))))
    base = cases.selectExpr("doc_id AS case_id", "lang AS language", "doc_id % 3 = 0 AS parallel", "quality = 1 AS answerable", "n_chars", "arm", "CASE WHEN arm = 'A' THEN 0 ELSE 1 END AS s")
    return base.selectExpr("*", "(case_id * 7 + s * (case_id % 5)) % 11 AS k").selectExpr("*", *[f"{v} AS {n}" for n, v in _COLUMNS.items()])


def _metric_sql(name: str) -> str:
    if name.startswith("mrr"):
        return "section_strict_mrr" if name.endswith("strict") else "section_mrr"
    if "_hit@" in name:
        head, strict, _ = name.partition(":strict")
        return head.replace("_hit@", "_strict_hit_" if strict else "_hit_")
    label = {"accuracy": ("answerable", "label = 'correct'"), "lenient_accuracy": ("answerable", "label IN ('correct', 'partially_correct')"), "false_refusal": ("answerable", "label = 'false_refusal'"), "correct_refusal": ("NOT answerable", "label = 'correct_refusal'"), "hallucination": ("NOT answerable", "label = 'hallucination'")}
    if name in label:
        return f"CASE WHEN {label[name][0]} THEN CAST({label[name][1]} AS INT) END"
    return {"groundedness": "CAST(grounded AS INT)", "citation_support_rate": "support_rate", "citation_section_precision": "section_precision", "tokens_prompt": "prompt_tokens", "tokens_output": "output_tokens", "tokens_total": "prompt_tokens + output_tokens"}.get(name, name)


_NAMES = [f"{level}_hit@{k}{mark}" for level in X.LEVELS for k in X.HIT_KS for mark in ("", ":strict")] + [f"evidence_hit@{k}" for k in X.HIT_KS] + [
    "mrr", "mrr:strict", "accuracy", "lenient_accuracy", "false_refusal", "groundedness", "correct_refusal", "hallucination", "citation_support_rate", "citation_section_precision",
    "latency_retrieve_ms", "latency_generate_ms", "latency_embed_query_ms", "latency_total_ms", "tokens_prompt", "tokens_output", "tokens_total"]


def _kind_sql(name: str) -> str:
    return X.DESCRIPTIVE if name in ("latency_embed_query_ms", "latency_total_ms") else X.CONTINUOUS if name.startswith(("mrr", "citation", "latency", "tokens")) else X.BINARY


_PAIRS = f"""{ROWS_SQL}, vals AS ({' UNION ALL '.join(f"SELECT arm, case_id, language, parallel, '{n}' AS metric, '{_kind_sql(n)}' AS kind, CAST({_metric_sql(n)} AS DOUBLE) AS v FROM rows_" for n in _NAMES)}),
paired AS (SELECT metric, kind, case_id, language, parallel, max(v) FILTER (arm = 'A') AS a, max(v) FILTER (arm = 'B') AS b FROM vals GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL),
cut AS (SELECT 'overall' AS slice, * FROM paired UNION ALL SELECT language, * FROM paired WHERE language IN ('en', 'vi') UNION ALL SELECT 'parallel', * FROM paired WHERE parallel),
sums AS (SELECT slice, metric, kind, count(*) AS n, CASE WHEN kind = 'descriptive' THEN median(a) ELSE avg(a) END AS a, CASE WHEN kind = 'descriptive' THEN median(b) ELSE avg(b) END AS b,
  CASE WHEN kind = 'binary' THEN count(*) FILTER (a <> 0 AND b = 0) END AS a_only, CASE WHEN kind = 'binary' THEN count(*) FILTER (a = 0 AND b <> 0) END AS b_only FROM cut GROUP BY slice, metric, kind)"""


@query(f"WITH {_PAIRS} SELECT slice, metric, kind, n, round(a, 6) AS a, round(b, 6) AS b, CASE WHEN kind <> 'descriptive' THEN round(b - a, 6) END AS delta, a_only, b_only FROM sums")
def compare_arms(spark, d):
    """All 32 metrics on all slices: means or medians of both arms, differences, discordant counts."""
    found = X.summaries(X.pairs(X.check_eligible(_rows(spark, d))))
    return found.select("slice", "metric", "kind", "n", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta")], "a_only", "b_only")


@query(f"""WITH {_PAIRS}, l AS (SELECT slice, metric AS lenient, CASE WHEN metric = 'lenient_accuracy' THEN 'accuracy' ELSE metric || ':strict' END AS strict, a, b FROM sums)
SELECT l.slice, lenient, strict, round(l.a, 6) AS a_lenient, round(s.a, 6) AS a_strict, round(l.b, 6) AS b_lenient, round(s.b, 6) AS b_strict, l.a IS DISTINCT FROM s.a OR l.b IS DISTINCT FROM s.b AS differs FROM l JOIN sums s ON s.slice = l.slice AND s.metric = l.strict""")
def strict_lenient_rows(spark, d):
    found = X.strict_and_lenient(X.summaries(X.pairs(_rows(spark, d))))
    return found.select("slice", "lenient", "strict", *[F.round(c, 6).alias(c) for c in ("a_lenient", "a_strict", "b_lenient", "b_strict")], "differs")


@query()
def compare_all_metrics(spark, d):
    """All metrics and slices of the labelled documents as cases, with intervals, tests and wordings."""
    return X.compare_all(_rows(spark, d))


@query(f"WITH {ROWS_SQL} SELECT case_id, arm, section_precision, support_rate FROM rows_ WHERE label = 'correct' AND answerable AND answered AND (section_precision IS DISTINCT FROM 1.0 OR (support_rate IS NOT NULL AND support_rate <> 1.0))")
def citation_defect_rows(spark, d):
    return X.citation_defects(_rows(spark, d))


@query(f"""WITH {ROWS_SQL}, f AS (SELECT case_id, arm, CASE WHEN label = 'false_refusal' THEN 'refusal' ELSE 'generation' END AS stage FROM rows_ WHERE label IN ('incorrect', 'partially_correct', 'false_refusal'))
SELECT case_id, arm, stage AS rule_stage, CASE WHEN case_id % 10 = 0 THEN 'ranking' ELSE stage END AS stage, CASE WHEN case_id % 10 = 0 THEN 'read by hand' END AS override_reason FROM f""")
def failure_overrides(spark, d):
    failures = _rows(spark, d).filter("label in ('incorrect', 'partially_correct', 'false_refusal')").select("case_id", "arm", F.when(F.col("label") == "false_refusal", "refusal").otherwise("generation").alias("stage"))
    overrides = failures.filter("case_id % 10 = 0").select("case_id", "arm", F.lit("ranking").alias("stage"), F.lit("read by hand").alias("reason"))
    return X.apply_overrides(failures, overrides).select("case_id", "arm", "rule_stage", "stage", "override_reason")


@query(f"""WITH {ROWS_SQL}, r AS (SELECT case_id AS record_id, arm, k, answerable, label IS NULL OR label IN ('false_refusal', 'correct_refusal') AS refused FROM rows_ WHERE arm = 'A')
SELECT record_id, chk AS "check", CASE WHEN chk IS NULL THEN 'none' WHEN k % 3 = 0 THEN 'pending' WHEN k % 5 = 1 THEN 'stale' ELSE 'cached' END AS state
FROM (SELECT *, CASE WHEN k = 9 THEN NULL WHEN answerable THEN CASE WHEN NOT refused THEN 'answer' END WHEN refused AND k % 2 = 0 THEN NULL ELSE 'refusal' END AS chk FROM r)""")
def judge_plan(spark, d):
    """Which records need a judge, and for which a judgement of the same answer, model and prompt is there."""
    refused = F.col("label").isNull() | F.col("label").isin("false_refusal", "correct_refusal")
    records = _rows(spark, d).filter("arm = 'A'").select(F.col("case_id").alias("record_id"), "k", "answerable", refused.alias("insufficient"), (F.col("k") != 9).alias("ok"), (F.col("k") % 2 == 1).alias("note"), F.lit(0).alias("citations"), F.sha2(F.col("case_id").cast("string"), 256).alias("answer_hash"))
    given = records.filter("k % 3 <> 0").select("record_id", F.when(F.col("k") % 5 == 1, "another").otherwise(F.col("answer_hash")).alias("answer_hash"), F.lit("judge-1").alias("model"), F.lit("v2").alias("prompt_version"))
    return J.judge_plan(records, given, "judge-1", "v2")


@query(f"""WITH {ROWS_SQL}, m AS (SELECT arm, unnest(['generate', 'total']) AS stage, unnest([latency_retrieve_ms, latency_total_ms]) AS ms FROM rows_ WHERE k % 4 <> 0)
SELECT arm, stage, count(*) AS n, round(avg(ms), 6) AS mean, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS max FROM m GROUP BY arm, stage""")
def judge_latency(spark, d):
    lines = _rows(spark, d).select("arm", F.col("latency_retrieve_ms").alias("generate_ms"), F.col("latency_total_ms").alias("total_ms"), F.when(F.col("k") % 4 != 0, F.col("k")).alias("retry_count"))
    return J.judge_latency(lines, "arm").withColumn("mean", F.round("mean", 6))


@query("""SELECT lang, count(*) AS calls, CAST(sum(ceil((length(text) + n_chars) / 4.0) + 120) AS BIGINT) AS prompt_tokens, CAST(count(*) * 200 AS BIGINT) AS output_tokens,
round((sum(ceil((length(text) + n_chars) / 4.0) + 120) * 0.3::DOUBLE + count(*) * 200 * 2.5::DOUBLE) / 1000000, 4) AS cost_usd, CAST(ceil(count(*) / 90.0) AS BIGINT) AS minutes FROM documents GROUP BY lang""")
def run_estimate(spark, d):
    cases = table(spark, d, "documents").select("lang", F.col("text").alias("question"), F.col("n_chars").alias("passages_chars"))
    return J.estimate_run(cases, 200, 120, 0.3, 2.5, 90, "lang").withColumn("cost_usd", F.round("cost_usd", 4))


_TARGETS = "t AS (SELECT doc_id AS target_id, CASE WHEN doc_id % 4 = 0 THEN -doc_id ELSE doc_id END AS source_id, 700 AS s0, 2300 AS s1 FROM documents WHERE n_chars > 2300)"


@query(f"""WITH {WINDOWS_SQL}, {_TARGETS} SELECT target_id, source_id, 'body' AS heading_path, CASE WHEN max(d.doc_id) IS NOT NULL THEN count(*) FILTER (char_start IS NOT NULL AND greatest(s0, char_start) < least(s1, char_end)) END AS n_chunks
FROM t LEFT JOIN documents d ON d.doc_id = t.source_id LEFT JOIN windows w ON w.doc_id = t.source_id GROUP BY target_id, source_id""")
def blueprint_coverage(spark, d):
    """How many chunks overlap each planned section; null where the plan names no section that is there."""
    docs = table(spark, d, "documents")
    long = docs.filter("n_chars > 2300")
    targets = long.select(F.col("doc_id").alias("target_id"), F.when(F.col("doc_id") % 4 == 0, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("source_id"), F.lit("body").alias("heading_path"))
    sections = docs.select(F.col("doc_id").alias("source_id"), F.lit("body").alias("heading_path"), F.lit(700).alias("char_start"), F.lit(2300).alias("char_end"))
    return J.coverage_of_targets(targets, sections, C.fixed_windows(docs).withColumnRenamed("doc_id", "source_id"))


@query(f"WITH {WINDOWS_SQL}, {_TARGETS} SELECT target_id, source_id FROM t WHERE source_id < 0 OR source_id NOT IN (SELECT doc_id FROM windows) OR target_id = 0 AND FALSE")
def blueprint_gate(spark, d):
    return J.uncovered(blueprint_coverage(spark, d)).select("target_id", "source_id")


@query("""WITH e AS (SELECT source, CASE WHEN doc_id % 97 = 0 THEN 'v3' ELSE 'v2' END AS prompt_version, lang AS model FROM documents),
c AS (SELECT source, count(DISTINCT prompt_version) AS p, count(DISTINCT model) AS m FROM e GROUP BY source)
SELECT source, 'prompt_version' AS "column", p AS n_values FROM c WHERE p > 1 UNION ALL SELECT source, 'model', m FROM c WHERE m > 1""")
def prompt_version_agreement(spark, d):
    """Runs (here: sources) whose records have more than one prompt version or model."""
    rows = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 97 == 0, "v3").otherwise("v2").alias("prompt_version"), F.col("lang").alias("model"))
    return J.disagreeing(rows, ["source"], ["prompt_version", "model"])


@query(f"WITH {ROWS_SQL} SELECT case_id, arm FROM rows_ WHERE (k > 8) = (k <> 10)")
def gate_disagreements(spark, d):
    return J.gate_disagreements(_rows(spark, d).select("case_id", "arm", (F.col("k") > 8).alias("gate_fired"), (F.col("k") != 10).alias("llm_called"))).select("case_id", "arm")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS n_chars, [lang, source] AS tags, CAST(3 + (doc_id % 7 <> 0)::INT AS INT) AS n_fields FROM documents")
def metadata_roundtrip(spark, d):
    """Rows through flat metadata and back: nulls left out, lists as JSON."""
    row = F.struct("doc_id", "lang", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("n_chars"), F.array("lang", "source").alias("tags"))
    flat = table(spark, d, "documents").select(J.to_metadata(row, ("tags",), ("doc_id", "lang", "n_chars", "tags")).alias("m"))
    return flat.select(J.from_metadata(F.col("m"), {"doc_id": "bigint", "lang": "string", "n_chars": "bigint", "tags": "array<string>"}).alias("r"), F.size("m").alias("n_fields")).select("r.*", "n_fields")


@query("SELECT lang, round_even(count(*) / 2.0, 0)::DOUBLE AS half, median(n_chars) AS middle FROM documents GROUP BY lang")
def half_even_and_median(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(X.half_even(F.count("*") / F.lit(2.0)).alias("half"), F.median("n_chars").alias("middle"))


@query("SELECT source, list_transform(list_sort(list(DISTINCT doc_id % 12)), lambda x: 'S' || x) AS slots FROM documents GROUP BY source")
def slots_in_order(spark, d):
    slots = table(spark, d, "documents").select("source", F.concat(F.lit("S"), (F.col("doc_id") % 12).cast("string")).alias("slot"))
    ordered = F.array_sort(F.collect_set(F.struct(X.slot_number(F.col("slot")).alias("n"), "slot")))
    return slots.groupBy("source").agg(F.transform(ordered, lambda x: x["slot"]).alias("slots"))


@query(f"WITH {ROWS_SQL} SELECT case_id, arm, 'first' AS mode, label FROM rows_ WHERE arm = 'A' UNION ALL SELECT case_id, arm, 'second', NULL FROM rows_ WHERE arm = 'B'")
def union_of_runs(spark, d):
    rows = _rows(spark, d)
    return X.union_of_runs([rows.filter("arm = 'A'").select("case_id", "arm", F.lit("first").alias("mode"), "label"), rows.filter("arm = 'B'").select("case_id", "arm", F.lit("second").alias("mode"))])


@query("SELECT item_id, 'Rate: ' || text || ' | - P1: ' || left(text, 10) || ' | [1] ' || upper(left(text, 5)) || chr(10) || chr(10) || '[2] {{question}} | end' AS prompt FROM benchmark WHERE NOT contains(text, '{{')")
def judge_prompts(spark, d):
    points = F.array(F.struct(F.lit("P1").alias("id"), F.substring("text", 1, 10).alias("point")))
    made = J.judge_prompt(F.lit("Rate: {{question}} | {{points}} | {{passages}} | end"), F.col("text"), F.lit(""), points, F.array(T.simple_upper(F.substring("text", 1, 5)), F.lit("{{question}}")))
    return table(spark, d, "benchmark").filter(~F.contains("text", F.lit("{{"))).select("item_id", made.alias("prompt"))


@query("SELECT sha256('hash-16|DOCUMENT|' || text) AS key, 16 AS dim, 1.0::DOUBLE AS norm FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def embedding_cache_put(spark, d):
    """Rows that a cache without any entry gets for the documents' texts, from the offline embedder."""
    docs = table(spark, d, "documents").filter("text is not null").withColumn("seq", F.monotonically_increasing_id())
    empty = spark.createDataFrame([], "key string, vector array<float>")
    _, misses = store.split_by_cache(docs.select("text", "seq"), empty, "hash-16", "DOCUMENT")
    made = J.embed_missing(misses, "hash-16", "DOCUMENT", J.hash_embedder())
    return made.select("key", F.size("vector").alias("dim"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)), 4).alias("norm"))


@query("SELECT doc_id, lang, CAST(n_chars AS INT) AS n_chars, CAST(NULL AS VARCHAR) AS note FROM documents")
def projected_records(spark, d):
    return J.projected(table(spark, d, "documents").select("n_chars", "doc_id", "lang"), {"doc_id": "bigint", "lang": "string", "n_chars": "int", "note": "string"})
