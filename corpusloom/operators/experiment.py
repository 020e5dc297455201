"""Two arms of an experiment, compared: metrics as columns, pairs by case, slices, and what the comparison lists beside them.

A row is one case of one arm with flat columns; a metric is an expression on them that is null where it does not apply. All
metrics and slices are unpivoted at once, so a comparison is one aggregate over (slice, metric, case), however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import statistics as S

BINARY, CONTINUOUS, DESCRIPTIVE = "binary", "continuous", "descriptive"
LEVELS, HIT_KS = ("source", "section"), (1, 3, 5)


@dataclass(frozen=True)
class Metric:
    kind: str
    value: Column
    note: str = ""


def _share(true: Column, where: Column) -> Column:
    return F.when(where & true.isNotNull(), true.cast("double"))


def metrics() -> dict[str, Metric]:
    """All metrics by name: hits by level, rank and strictness, evidence, reciprocal ranks, answers, citations, latency, tokens."""
    hits = {f"{level}_hit@{k}{mark}": Metric(BINARY, F.col(f"{level}{of}_hit_{k}")) for level in LEVELS for k in HIT_KS for mark, of in (("", ""), (":strict", "_strict"))}
    evidence = {f"evidence_hit@{k}": Metric(BINARY, F.col(f"evidence_hit_{k}")) for k in HIT_KS}
    ranks = {"mrr": Metric(CONTINUOUS, F.col("section_mrr")), "mrr:strict": Metric(CONTINUOUS, F.col("section_strict_mrr"))}
    yes, no, label = F.col("answerable"), ~F.col("answerable"), F.col("label")
    answers = {
        "accuracy": Metric(BINARY, _share(label == "correct", yes), "answerable, labelled in both arms"),
        "lenient_accuracy": Metric(BINARY, _share(label.isin("correct", "partially_correct"), yes), "correct or partially_correct"),
        "false_refusal": Metric(BINARY, _share(label == "false_refusal", yes), "lower is better"),
        "groundedness": Metric(BINARY, F.col("grounded").cast("double"), "answer-checked records judged in both arms"),
        "correct_refusal": Metric(BINARY, _share(label == "correct_refusal", no), "corpus-insufficient cases"),
        "hallucination": Metric(BINARY, _share(label == "hallucination", no), "corpus-insufficient; lower is better"),
        "citation_support_rate": Metric(CONTINUOUS, F.col("support_rate"), "judge; answered in both arms"),
        "citation_section_precision": Metric(CONTINUOUS, F.col("section_precision"), "span check; answered in both"),
    }
    called = "LLM called in both arms"
    costs = {
        "latency_retrieve_ms": Metric(CONTINUOUS, F.col("latency_retrieve_ms")), "latency_generate_ms": Metric(CONTINUOUS, F.col("latency_generate_ms"), called),
        "latency_embed_query_ms": Metric(DESCRIPTIVE, F.col("latency_embed_query_ms"), "not comparable: query embeddings may be cache hits"), "latency_total_ms": Metric(DESCRIPTIVE, F.col("latency_total_ms"), "not comparable: includes embed_query"),
        "tokens_prompt": Metric(CONTINUOUS, F.col("prompt_tokens"), called), "tokens_output": Metric(CONTINUOUS, F.col("output_tokens"), called), "tokens_total": Metric(CONTINUOUS, F.col("prompt_tokens") + F.col("output_tokens"), called),
    }
    return hits | evidence | ranks | answers | costs


def slices() -> dict[str, Column]:
    """Which cases a comparison is repeated on."""
    return {"overall": F.lit(True), "en": F.col("language") == "en", "vi": F.col("language") == "vi", "parallel": F.col("parallel")}


def check_eligible(rows: DataFrame) -> DataFrame:
    """Rows, of which those of cases without an answer in the corpus have no retrieval metric; one that has raises."""
    has = F.coalesce(*[F.col(f"{level}_hit_{k}") for level in LEVELS for k in HIT_KS], F.col("section_mrr")).isNotNull()
    bad = ~F.col("answerable") & has
    return rows.filter(F.when(bad, F.raise_error(F.concat(F.lit("retrieval metrics of a case without an answer: "), F.col("case_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))


def pairs(rows: DataFrame, chosen: dict[str, Metric] | None = None, parts: dict[str, Column] | None = None) -> DataFrame:
    """(slice, metric, case_id, a, b) of the cases where both arms have a value."""
    values = F.array(*[F.struct(F.lit(name).alias("metric"), m.value.cast("double").alias("value")) for name, m in (chosen or metrics()).items()])
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in (parts or slices()).items()]))
    flat = rows.select("arm", "case_id", F.explode(names).alias("slice"), values.alias("values")).select("arm", "case_id", "slice", F.inline("values")).filter("value is not null")
    arm = lambda name: F.max(F.when(F.col("arm") == name, F.col("value")))
    return flat.groupBy("slice", "metric", "case_id").agg(arm("A").alias("a"), arm("B").alias("b")).filter("a is not null and b is not null")


def summaries(found: DataFrame, chosen: dict[str, Metric] | None = None) -> DataFrame:
    """(slice, metric, kind, n, a, b, delta, a_only, b_only) of pairs: means and their difference, medians where a metric only describes."""
    kinds = F.create_map(*[x for name, m in (chosen or metrics()).items() for x in (F.lit(name), F.lit(m.kind))])
    sums = found.groupBy("slice", "metric").agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.median("a").alias("median_a"), F.median("b").alias("median_b"),
        F.count_if((F.col("a") != 0) & (F.col("b") == 0)).alias("a_only"), F.count_if((F.col("a") == 0) & (F.col("b") != 0)).alias("b_only"))
    kind = kinds[F.col("metric")]
    pick = lambda of: F.when(kind == DESCRIPTIVE, F.col(f"median_{of}")).otherwise(F.col(f"mean_{of}"))
    only = lambda c: F.when(kind == BINARY, F.col(c)).alias(c)
    return sums.select("slice", "metric", kind.alias("kind"), "n", pick("a").alias("a"), pick("b").alias("b"), F.when(kind != DESCRIPTIVE, pick("b") - pick("a")).alias("delta"), only("a_only"), only("b_only"))


def compare_all(rows: DataFrame, resamples: int = 10_000) -> DataFrame:
    """Summaries of all slices and metrics with intervals, exact tests and wordings; a (slice, metric) is one small group's work."""
    known, found = metrics(), stored(pairs(rows).withColumn("key", F.concat_ws("|", "slice", "metric")), "pairs")
    tested = None
    for kind in (BINARY, CONTINUOUS):
        one = S.compare(found.filter(F.col("metric").isin([n for n, m in known.items() if m.kind == kind])).select("key", "case_id", "a", "b"), kind, "key", resamples)
        tested = one if tested is None else tested.union(one)
    both = summaries(found).withColumn("key", F.concat_ws("|", "slice", "metric"))
    note = F.create_map(*[x for name, m in known.items() for x in (F.lit(name), F.lit(m.note))])[F.col("metric")]
    words = F.coalesce("wording", F.concat(F.lit("not tested ("), note, F.lit(")")))
    return both.join(tested.select("key", "low", "high", "p", "wording"), "key", "left").select("slice", "metric", "kind", "n", "a", "b", "delta", "a_only", "b_only", "low", "high", "p", words.alias("wording"))


def strict_and_lenient(compared: DataFrame) -> DataFrame:
    """(slice, lenient, strict, a_lenient, a_strict, b_lenient, b_strict, differs): metrics beside their strict forms."""
    names = [(f"{level}_hit@{k}", f"{level}_hit@{k}:strict") for level in LEVELS for k in HIT_KS] + [("mrr", "mrr:strict"), ("lenient_accuracy", "accuracy")]
    strict_of = F.create_map(*[F.lit(x) for pair in names for x in pair])
    one = compared.select("slice", F.col("metric").alias("lenient"), strict_of[F.col("metric")].alias("strict"), F.col("a").alias("a_lenient"), F.col("b").alias("b_lenient")).filter("strict is not null")
    other = compared.select("slice", F.col("metric").alias("strict"), F.col("a").alias("a_strict"), F.col("b").alias("b_strict"))
    return one.join(other, ["slice", "strict"]).select("slice", "lenient", "strict", "a_lenient", "a_strict", "b_lenient", "b_strict", (~F.equal_null("a_lenient", "a_strict") | ~F.equal_null("b_lenient", "b_strict")).alias("differs"))


def citation_defects(rows: DataFrame) -> DataFrame:
    """Correct answers whose citations are not all in their sections, or not all supported where that was judged."""
    sound = F.equal_null("section_precision", F.lit(1.0)) & F.coalesce(F.col("support_rate") == 1.0, F.lit(True))
    return rows.filter((F.col("label") == "correct") & F.col("answerable") & F.col("answered") & ~sound).select("case_id", "arm", "section_precision", "support_rate")


def chunk_facts(retrieved: DataFrame, spans: DataFrame, quotes: DataFrame, case: list[str]) -> DataFrame:
    """(case, rank, source_id, hits_source, hits_section, n_quotes): what each retrieved chunk has of its case's spans and quotes."""
    from ..functions.text import collapse_whitespace
    from .evaluation import overlaps

    key = [*case, "rank"]
    on = [c for c in case if c in spans.columns]
    sources = spans.select(*on, "source_id", F.col("char_start").alias("s0"), F.col("char_end").alias("s1"))
    hits = retrieved.join(sources, [*on, "source_id"], "left").groupBy(*key, "source_id").agg(F.max(F.col("s0").isNotNull()).alias("hits_source"), F.max(F.col("s0").isNotNull() & overlaps(F.col("char_start"), F.col("char_end"), F.col("s0"), F.col("s1"))).alias("hits_section"))
    inside = retrieved.join(quotes.select(*on, collapse_whitespace(F.col("quote")).alias("quote")).distinct(), on).filter(F.contains(collapse_whitespace(F.col("text")), F.col("quote")))
    counted = inside.groupBy(*key).agg(F.count("*").alias("n_quotes"))
    return hits.join(counted, key, "left").na.fill(0, ["n_quotes"])


def apply_overrides(failures: DataFrame, overrides: DataFrame, key: tuple[str, ...] = ("case_id", "arm")) -> DataFrame:
    """Failures with the stages and reasons of overrides; an override of what is no failure raises."""
    of = list(key)
    unknown = overrides.join(failures.select(*of), of, "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"overrides for records that are not failures: {sorted(tuple(r[k] for k in of) for r in unknown)}")
    new = overrides.select(*of, F.col("stage").alias("new_stage"), F.col("reason").alias("override_reason"))
    return failures.join(new, of, "left").withColumn("rule_stage", F.col("stage")).withColumn("stage", F.coalesce("new_stage", "stage")).drop("new_stage")


def with_twins(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Rows whose group has another key as well; groups are counted before rows meet them."""
    many = rows.groupBy(group).agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low <> high").select(group)
    return rows.join(many, group, "left_semi")


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounded to the nearest, ties to the even digit, as reports are."""
    return F.bround(value, digits)


def slot_number(slot: Column) -> Column:
    """Orders slots by their numbers (S2 before S10)."""
    return F.substring(slot, 2, 20).cast("int")


def union_of_runs(runs: list[DataFrame]) -> DataFrame:
    """Rows of all runs in the order of reports; a column that a run lacks is null. Of a record in several runs each stays."""
    from functools import reduce

    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), runs).orderBy("case_id", "arm", "mode")
