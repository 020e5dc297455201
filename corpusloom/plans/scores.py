"""Queries of scores: spans, hits, evidence, answers, citations, failures, over an evaluation made from the tables.

Cases are benchmark items that some document holds; of those documents the first is the expected source, the others are
alternates. Two arms rank the passages of those documents and of a few others in an order fixed by a hash, so hits and misses
of every kind occur. Answers are made from labels: quality says whether a case is answerable, toxic whether it was refused.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import evaluation as E
from ..sources.shared import stored
from .base import WINDOWS_SQL, query, sql_collapse, table

SPANS_SQL = """
spans AS (SELECT item_id, 'S1' AS slot, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY item_id) THEN 'expected' ELSE 'alternate' END AS role, doc_id,
  instr(d.text, b.text) - 1 AS char_start, instr(d.text, b.text) - 1 + length(b.text) AS char_end FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')
"""
FIXTURE_SQL = f"""{WINDOWS_SQL}, {SPANS_SQL},
cand AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, doc_id FROM spans UNION ALL SELECT item_id, item_id + k AS doc_id FROM (SELECT DISTINCT item_id FROM spans), (SELECT unnest(range(0, 4)) AS k))),
ordered AS (SELECT arm, item_id, doc_id, char_start, char_end, display_text AS text, row_number() OVER (PARTITION BY arm, item_id ORDER BY md5(arm || ':' || item_id || ':' || doc_id || ':' || "window")) AS rank
  FROM cand JOIN windows USING (doc_id), (SELECT unnest(['A', 'B']) AS arm)),
retrieved AS (SELECT * FROM ordered WHERE rank <= 5)
"""


def _spans(spark, d):
    found = E.passage_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))
    role = F.when(F.col("doc_id") == F.min("doc_id").over(W.partitionBy("item_id")), "expected").otherwise("alternate")
    return found.select("item_id", F.lit("S1").alias("slot"), role.alias("role"), F.col("doc_id").alias("source_id"), "char_start", "char_end")


def _retrieved(spark, d, spans):
    near = spans.select("item_id").distinct().select("item_id", F.explode(F.sequence(F.col("item_id"), F.col("item_id") + 3)).alias("doc_id"))
    cand = spans.select("item_id", F.col("source_id").alias("doc_id")).union(near).distinct()
    windows = C.fixed_windows(table(spark, d, "documents").join(cand.select("doc_id").distinct(), "doc_id", "left_semi"))
    arms = cand.join(windows, "doc_id").select("*", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("arm"))
    order = F.md5(F.concat_ws(":", "arm", F.col("item_id").cast("string"), F.col("doc_id").cast("string"), F.col("window").cast("string")))
    ranked = arms.withColumn("rank", F.row_number().over(W.partitionBy("arm", "item_id").orderBy(order))).filter("rank <= 5")
    place = F.struct(F.col("doc_id").alias("source_id"), "char_start", "char_end")
    none = F.slice(F.array(place), 1, 0)
    return ranked.select("arm", "item_id", "rank", F.col("doc_id").alias("source_id"), "char_start", "char_end", F.col("display_text").alias("text"), none.alias("duplicates"))


@query(f"WITH {SPANS_SQL} SELECT item_id, slot, role, doc_id AS source_id, CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end FROM spans")
def expected_spans(spark, d):
    return _spans(spark, d)


_HIT = "bool_or(rank <= {k} AND {test})"
_SECTION = "(s.doc_id IS NOT NULL AND greatest(r.char_start, s.char_start) < least(r.char_end, s.char_end))"


def _score_sql(extra_joins: str = "") -> str:
    cols = []
    for name, test in (("source", "TRUE"), ("source_strict", "role = 'expected'"), ("section", _SECTION), ("section_strict", f"role = 'expected' AND {_SECTION}")):
        cols += [f"CAST(coalesce(bool_or(rank <= {k} AND {test}), FALSE) AS INT) AS {name}_hit_{k}" for k in (1, 3, 5)]
        cols.append(f"coalesce(1.0::DOUBLE / min(rank) FILTER ({test}), 0) AS {name}_mrr")
    cols += [f"CAST(coalesce(bool_or({t}), FALSE) AS INT)::DOUBLE AS {n}_slot_fraction" for n, t in (("source", "s.doc_id IS NOT NULL"), ("section", _SECTION))]
    return f"SELECT a.arm, a.item_id, {', '.join(cols)} FROM (SELECT DISTINCT arm, item_id FROM retrieved) a LEFT JOIN retrieved r USING (arm, item_id) LEFT JOIN spans s ON s.item_id = a.item_id AND s.doc_id = r.doc_id GROUP BY a.arm, a.item_id"


_SCORE_SQL = _score_sql().replace("rank <= ", "s.doc_id IS NOT NULL AND rank <= ").replace("min(rank) FILTER (TRUE)", "min(rank) FILTER (s.doc_id IS NOT NULL)")


@query(f"WITH {FIXTURE_SQL} {_SCORE_SQL}")
def retrieval_scores(spark, d):
    """Hits at 1, 3 and 5 by source and section, lenient and strict, slot fractions and reciprocal ranks of each case and arm."""
    spans = _spans(spark, d)
    scores = E.retrieval_scores(_retrieved(spark, d, spans), spans, ["arm", "item_id"])
    return scores.select(*[c for c in scores.columns if "bare" not in c])


@query(f"WITH {FIXTURE_SQL}, sc AS ({_SCORE_SQL}) SELECT arm, count(*) AS n, " + ", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in ("source_hit_1", "source_hit_5", "section_hit_1", "section_hit_3", "section_hit_5", "section_strict_hit_5", "section_mrr", "section_strict_mrr")) + " FROM sc GROUP BY arm")
def retrieval_summary(spark, d):
    names = ("source_hit_1", "source_hit_5", "section_hit_1", "section_hit_3", "section_hit_5", "section_strict_hit_5", "section_mrr", "section_strict_mrr")
    return retrieval_scores(spark, d).groupBy("arm").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names])


_COPIES = """
copies AS (SELECT d.doc_id, o.doc_id AS other FROM documents d JOIN documents o ON d.text = o.text AND d.doc_id <> o.doc_id)
"""


@query(f"""WITH {FIXTURE_SQL}, {_COPIES}, places AS (SELECT arm, item_id, rank, doc_id, char_start, char_end, TRUE AS own FROM retrieved UNION ALL SELECT arm, item_id, rank, other, char_start, char_end, FALSE FROM retrieved JOIN copies USING (doc_id)),
h AS (SELECT r.arm, r.item_id, min(rank) FILTER ({_SECTION}) AS first, min(rank) FILTER (own AND {_SECTION}) AS bare FROM places r JOIN spans s ON s.item_id = r.item_id AND s.doc_id = r.doc_id GROUP BY r.arm, r.item_id)
SELECT arm, item_id, CAST(first AS INT) AS first, CAST(bare AS INT) AS bare, first IS DISTINCT FROM bare AS changed FROM h WHERE first IS NOT NULL""")
def duplicate_rule_changes(spark, d):
    """First section hits of cases, and whether they move when the copies that a chunk stands for count too."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("c"))
    spans = _spans(spark, d)
    got = _retrieved(spark, d, spans).drop("duplicates")
    case = ["arm", "item_id", "rank"]
    # copies outside a case's expected sources can't change its hits, so contents meet inside a case alone
    expected = spans.select("item_id", F.col("source_id").alias("doc_id")).distinct().join(docs, "doc_id").select("item_id", "c", F.col("doc_id").alias("other"))
    mine = got.select(*case, F.col("source_id").alias("doc_id")).join(docs, "doc_id")
    copies = mine.join(expected, ["item_id", "c"]).filter("doc_id <> other").groupBy(*case).agg(F.collect_list("other").alias("others"))
    place = lambda o: F.struct(o.alias("source_id"), F.col("char_start").alias("char_start"), F.col("char_end").alias("char_end"))
    rows = got.join(copies, case, "left").withColumn("duplicates", F.transform(F.coalesce("others", F.array().cast("array<bigint>")), place))
    hits = E.chunk_hits(rows, spans, ["arm", "item_id"]).groupBy("arm", "item_id").agg(F.min(F.when(F.col("section"), F.col("rank"))).alias("first"), F.min(F.when(F.col("section_bare"), F.col("rank"))).alias("bare"))
    return hits.filter("first is not null").withColumn("changed", ~F.equal_null("first", "bare"))


_QUOTES_SQL = f"""quotes AS (SELECT item_id, p AS point, {sql_collapse('q')} AS q FROM (SELECT item_id, unnest(range(0, len(qs))) AS p, unnest(qs) AS q FROM (SELECT item_id, list_filter(string_split(text, '. '), lambda x: length(x) > 20) AS qs FROM benchmark))),
texts AS (SELECT arm, item_id, rank, doc_id, char_start, char_end, {sql_collapse('text')} AS t FROM retrieved),
inside AS (SELECT DISTINCT r.arm, r.item_id, r.rank FROM retrieved r JOIN spans s ON s.item_id = r.item_id AND s.doc_id = r.doc_id AND role = 'expected' AND {_SECTION}),
found AS (SELECT a.arm, q.item_id, q.point, min(t.rank) AS first, min(t.rank) FILTER (i.rank IS NOT NULL) AS first_in, min(t.rank) FILTER (t.rank IS NOT NULL AND i.rank IS NULL) AS first_out
  FROM (SELECT DISTINCT arm, item_id FROM retrieved) a JOIN quotes q USING (item_id) LEFT JOIN texts t ON t.arm = a.arm AND t.item_id = a.item_id AND contains(t.t, q.q) LEFT JOIN inside i ON i.arm = t.arm AND i.item_id = t.item_id AND i.rank = t.rank GROUP BY a.arm, q.item_id, q.point)"""


@query(f"WITH {FIXTURE_SQL}, {_QUOTES_SQL} SELECT arm, item_id, " + ", ".join(f"min(coalesce(first <= {k}, FALSE)::INT) AS evidence_hit_{k}, max(coalesce(first <= {k}, FALSE)::INT) AS any_hit_{k}" for k in (1, 3, 5)) + ", min((first_out IS NOT NULL AND first_in IS NULL)::INT) AS alternate_only FROM found GROUP BY arm, item_id")
def evidence_hit(spark, d):
    """Whether every point, or any, has its quote whole in one of the first chunks, and whether only alternates had them."""
    spans = _spans(spark, d)
    quotes = table(spark, d, "benchmark").select("item_id", F.posexplode(F.filter(F.split("text", r"\. "), lambda x: F.length(x) > 20)).alias("point", "quote")).withColumn("required", F.lit(True))
    return E.evidence_scores(_retrieved(spark, d, spans), quotes, spans, ["arm", "item_id"])


# --- answers ---------------------------------------------------------------------------------------------------

ANSWERS_SQL = """
base AS (SELECT doc_id, lang, source, quality = 1 AS answerable, toxic = 1 AS insufficient, doc_id % 2 = 1 AS note, CAST(doc_id % 3 AS INT) AS citations, doc_id % 13 <> 0 AS judged, doc_id % 11 = 0 AS contradicts, doc_id % 4 = 0 AS presents, doc_id % 5 <> 0 AS clean,
  list_transform(range(0, 1 + doc_id % 3), lambda i: CASE (doc_id + i) % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'partial' ELSE 'yes' END) AS coverage FROM labels JOIN documents USING (doc_id)),
checked AS (SELECT *, CASE WHEN answerable THEN CASE WHEN NOT insufficient THEN 'answer' END WHEN insufficient AND NOT note AND citations = 0 THEN NULL ELSE 'refusal' END AS "check" FROM base),
answers AS (SELECT *, CASE
    WHEN NOT answerable THEN CASE WHEN insufficient AND NOT note AND citations = 0 THEN 'correct_refusal' WHEN NOT judged THEN NULL WHEN presents THEN 'hallucination' ELSE 'correct_refusal' END
    WHEN insufficient THEN 'false_refusal' WHEN NOT judged THEN NULL WHEN contradicts THEN 'incorrect'
    WHEN len(list_filter(coverage, lambda c: c <> 'yes')) = 0 THEN 'correct' WHEN len(list_filter(coverage, lambda c: c <> 'no')) > 0 THEN 'partially_correct' ELSE 'incorrect' END AS label,
  CASE WHEN judged AND "check" = 'answer' THEN clean END AS grounded,
  CASE WHEN judged AND "check" = 'answer' THEN (len(list_filter(coverage, lambda c: c = 'yes')) + 0.5::DOUBLE * len(list_filter(coverage, lambda c: c = 'partial'))) / len(coverage) END AS points_covered FROM checked)
"""


def _answers(spark, d):
    i = F.col("doc_id")
    cover = F.transform(F.sequence(F.lit(0).cast("long"), i % 3), lambda k: F.when((i + k) % 4 == 0, "no").when((i + k) % 4 == 1, "partial").otherwise("yes"))
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").select(
        "doc_id", "lang", "source", (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("insufficient"), (i % 2 == 1).alias("note"), (i % 3).cast("int").alias("citations"),
        (i % 13 != 0).alias("judged"), (i % 11 == 0).alias("contradicts"), (i % 4 == 0).alias("presents"), (i % 5 != 0).alias("clean"), cover.alias("coverage"))
    c = F.col
    rows = rows.withColumn("check", E.judge_check(F.lit(True), c("answerable"), c("insufficient"), c("note"), c("citations")))
    rows = rows.withColumn("label", E.result_label(c("answerable"), c("insufficient"), c("note"), c("citations"), c("coverage"), c("contradicts"), c("presents"), c("judged")))
    judged = c("judged") & (c("check") == "answer")
    return rows.withColumn("grounded", F.when(judged, c("clean"))).withColumn("points_covered", F.when(judged, E.points_covered(c("coverage"))))


@query(f'WITH {ANSWERS_SQL} SELECT doc_id, "check", label, grounded, round(points_covered, 6) AS points_covered FROM answers')
def answer_labels(spark, d):
    return _answers(spark, d).select("doc_id", "check", "label", "grounded", F.round("points_covered", 6).alias("points_covered"))


_ABLE, _NOT, _JUDGED = "label IS NOT NULL AND answerable", "label IS NOT NULL AND NOT answerable", "label IS NOT NULL AND answerable AND \"check\" = 'answer'"
_RATE = "round(count(*) FILTER ({a} AND {t})::DOUBLE / nullif(count(*) FILTER ({a}), 0), 6) AS {n}"
_SUMMARY_SQL = ", ".join([
    "count(*) AS records", "count(*) FILTER (label IS NULL) AS unlabelled", *[f"count(*) FILTER (label = '{x}') AS {x}" for x in E.LABELS],
    _RATE.format(a=_ABLE, t="label = 'correct'", n="accuracy"), _RATE.format(a=_ABLE, t="label IN ('correct', 'partially_correct')", n="lenient_accuracy"), _RATE.format(a=_JUDGED, t="grounded", n="groundedness"),
    f"round(avg(points_covered) FILTER ({_JUDGED}), 6) AS points_covered_mean", _RATE.format(a=_NOT, t="label = 'correct_refusal'", n="correct_refusal_rate"),
    _RATE.format(a=_NOT, t="label = 'hallucination'", n="hallucination_rate"), _RATE.format(a=_ABLE, t="label = 'false_refusal'", n="false_refusal_rate")])


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {ANSWERS_SQL} SELECT lang, {_SUMMARY_SQL} FROM answers GROUP BY lang")
def answer_summary(spark, d):
    return _rounded(E.summarize_answers(_answers(spark, d), "lang"))


@query(f"WITH {ANSWERS_SQL} SELECT lang, source, {_SUMMARY_SQL} FROM answers GROUP BY GROUPING SETS ((), (lang), (source))")
def breakdown_grouping_sets(spark, d):
    """The whole summary over all, by language and by source in one pass."""
    rows = _answers(spark, d)
    return _rounded(rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(*E.answer_metrics(lambda *n: F.col("label").isin(*n))))


_CITED_SQL = f"""cited AS (SELECT r.arm, r.item_id, r.rank, bool_or(s.doc_id IS NOT NULL) AS source_ok, coalesce(bool_or({_SECTION}), FALSE) AS section_ok FROM retrieved r LEFT JOIN spans s ON s.item_id = r.item_id AND s.doc_id = r.doc_id WHERE r.rank <= r.item_id % 3 GROUP BY r.arm, r.item_id, r.rank),
classes AS (SELECT a.arm, a.item_id, count(c.rank) AS n, CASE WHEN count(c.rank) = 0 THEN 'citation_missing' WHEN bool_or(section_ok) THEN 'correct_evidence' WHEN bool_or(source_ok) THEN 'correct_source_wrong_evidence' ELSE 'unsupported_citation' END AS class,
  round(avg(section_ok::INT::DOUBLE), 6) AS section_precision, round(avg(source_ok::INT::DOUBLE), 6) AS source_precision FROM (SELECT DISTINCT arm, item_id FROM retrieved) a LEFT JOIN cited c USING (arm, item_id) GROUP BY a.arm, a.item_id)"""


def _classes(spark, d):
    spans = _spans(spark, d)
    got = _retrieved(spark, d, spans)
    hits = E.chunk_hits(got, spans, ["arm", "item_id"]).groupBy("arm", "item_id", "rank").agg(F.max("source").alias("source_ok"), F.max("section").alias("section_ok"))
    cited = got.filter("rank <= item_id % 3").select("arm", "item_id", "rank").join(hits, ["arm", "item_id", "rank"], "left").na.fill(False, ["source_ok", "section_ok"])
    per = got.select("arm", "item_id").distinct().join(cited, ["arm", "item_id"], "left").groupBy("arm", "item_id").agg(
        F.count("rank").alias("n"), F.max("section_ok").alias("e"), F.max("source_ok").alias("s"), F.round(F.avg(F.col("section_ok").cast("double")), 6).alias("section_precision"), F.round(F.avg(F.col("source_ok").cast("double")), 6).alias("source_precision"))
    return per.select("arm", "item_id", "n", E.citation_class(F.col("n"), F.col("e"), F.col("s")).alias("class"), "section_precision", "source_precision")


@query(f"WITH {FIXTURE_SQL}, {_CITED_SQL} SELECT * FROM classes")
def citation_classes(spark, d):
    return _classes(spark, d)


@query(f"WITH {FIXTURE_SQL}, {_CITED_SQL} SELECT arm, count(*) AS answered, round(avg((n > 0)::INT::DOUBLE), 6) AS presence_rate, round(avg(section_precision), 6) AS section_precision, round(avg(source_precision), 6) AS source_precision, " + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in E.CITATION_CLASSES) + " FROM classes GROUP BY arm")
def citation_summary(spark, d):
    return _classes(spark, d).groupBy("arm").agg(
        F.count("*").alias("answered"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("presence_rate"), F.round(F.avg("section_precision"), 6).alias("section_precision"), F.round(F.avg("source_precision"), 6).alias("source_precision"),
        *[F.count_if(F.col("class") == c).alias(c) for c in E.CITATION_CLASSES])


_FAIL_SQL = f"""WITH {FIXTURE_SQL}, {ANSWERS_SQL}, sc AS ({_SCORE_SQL}), {_QUOTES_SQL}, ev AS (SELECT arm, item_id, min(coalesce(first <= 5, FALSE)::INT) AS evidence_hit_5 FROM found GROUP BY arm, item_id),
hitting AS (SELECT r.arm, r.item_id, count(DISTINCT r.rank) AS n_hit, min(r.rank) AS first_rank FROM retrieved r JOIN spans s ON s.item_id = r.item_id AND s.doc_id = r.doc_id AND {_SECTION} GROUP BY r.arm, r.item_id),
failed AS (SELECT sc.arm, sc.item_id, label, CASE WHEN label IS NULL OR (label IN ('correct', 'correct_refusal') AND section_hit_5 = 1) THEN NULL WHEN section_hit_5 = 0 THEN 'retrieval_miss' WHEN label = 'false_refusal' AND sc.item_id % 2 = 0 THEN 'refusal'
  WHEN evidence_hit_5 = 0 OR (n_hit = 1 AND sc.item_id % 5 = 0) THEN 'chunking' WHEN first_rank >= 3 AND sc.item_id % 3 = 0 THEN 'ranking' WHEN label IN ('false_refusal', 'hallucination') THEN 'refusal' WHEN label IN ('partially_correct', 'incorrect') THEN 'generation' ELSE 'citation' END AS stage
  FROM sc JOIN answers ON answers.doc_id = sc.item_id LEFT JOIN ev ON ev.arm = sc.arm AND ev.item_id = sc.item_id LEFT JOIN hitting h ON h.arm = sc.arm AND h.item_id = sc.item_id)"""


def _failures(spark, d):
    spans = _spans(spark, d)
    got, case = _retrieved(spark, d, spans), ["arm", "item_id"]
    quotes = table(spark, d, "benchmark").select("item_id", F.posexplode(F.filter(F.split("text", r"\. "), lambda x: F.length(x) > 20)).alias("point", "quote")).withColumn("required", F.lit(True))
    hits = E.chunk_hits(got, spans, case).filter("section").groupBy(*case).agg(F.count_distinct("rank").alias("n_hit"), F.min("rank").alias("first_rank"))
    labels = _answers(spark, d).select(F.col("doc_id").alias("item_id"), "label")
    rows = E.retrieval_scores(got, spans, case).join(labels, "item_id").join(E.evidence_scores(got, quotes, spans, case), case, "left").join(hits, case, "left")
    c = F.col
    stage = E.failure_stage(c("label"), c("section_hit_5"), c("evidence_hit_5"), c("item_id") % 2 == 0, c("n_hit"), c("item_id") % 5 == 0, c("first_rank"), c("item_id") % 3 == 0)
    return rows.select("arm", "item_id", "label", stage.alias("stage"), E.secondary_stages(stage, c("section_hit_5"), c("evidence_hit_5")).alias("secondary"))


@query(f"{_FAIL_SQL} SELECT * FROM failed WHERE stage IS NOT NULL")
def failure_classification(spark, d):
    return _failures(spark, d).filter("stage is not null").drop("secondary")


@query(f"{_FAIL_SQL} SELECT f.arm, f.item_id, f.stage, CASE WHEN sc.section_hit_5 = 1 AND ev.evidence_hit_5 = 0 AND f.stage <> 'chunking' THEN ['chunking'] ELSE []::VARCHAR[] END AS secondary FROM failed f JOIN sc USING (arm, item_id) LEFT JOIN ev USING (arm, item_id) WHERE f.stage IS NOT NULL")
def failure_secondary_stages(spark, d):
    """What a failure shows besides its first stage."""
    return _failures(spark, d).filter("stage is not null").select("arm", "item_id", "stage", "secondary")


@query(f"{_FAIL_SQL} SELECT stage, count(*) FILTER (arm = 'A') AS a, count(*) FILTER (arm = 'B') AS b FROM failed WHERE stage IS NOT NULL GROUP BY stage")
def failure_counts(spark, d):
    return _failures(spark, d).filter("stage is not null").groupBy("stage").agg(F.count_if(F.col("arm") == "A").alias("a"), F.count_if(F.col("arm") == "B").alias("b"))


#: Records of every item in two arms: some failed, some of retrieval alone, some without spans or a split of their own.
_RECORDS_SQL = """records AS (SELECT arm, item_id, CASE WHEN item_id % 17 = 3 THEN 'error' ELSE 'ok' END AS status, CASE WHEN item_id % 4 = 0 THEN 'retrieval' ELSE 'full' END AS mode, item_id % 5 <> 1 AS answerable,
  item_id % 7 = 2 AS insufficient, item_id % 3 <> 0 AS judged, CASE WHEN item_id % 3 = 0 THEN 'dev' END AS split FROM benchmark, (SELECT unnest(['A', 'B']) AS arm))"""
_BUNDLE_SQL = f"""c2 AS (SELECT *, (item_id + rank) % 3 = 1 AS supported FROM cited),
g AS (SELECT arm, item_id, count(*) AS n, bool_or(section_ok) AS e, bool_or(source_ok) AS s, bool_or(supported) AS u, avg(section_ok::INT::DOUBLE) AS pe, avg(source_ok::INT::DOUBLE) AS ps, avg(supported::INT::DOUBLE) AS pu FROM c2 GROUP BY arm, item_id),
b AS (SELECT r.*, coalesce(n, 0) AS n, coalesce(e, FALSE) AS e, coalesce(s, FALSE) AS s, coalesce(u, FALSE) AS u, pe, ps, pu FROM records r LEFT JOIN g USING (arm, item_id)),
bundle AS (SELECT arm, item_id, NOT insufficient AS answered, CASE WHEN insufficient THEN n END AS related_citation_count, CASE WHEN NOT insufficient THEN n END AS citation_count, CASE WHEN NOT insufficient THEN n > 0 END AS citation_present,
  CASE WHEN NOT insufficient AND answerable THEN round(ps, 6) END AS source_precision, CASE WHEN NOT insufficient AND answerable THEN round(pe, 6) END AS section_precision, CASE WHEN NOT insufficient AND answerable AND judged THEN round(pu, 6) END AS support_rate,
  CASE WHEN NOT insufficient AND answerable THEN CASE WHEN n = 0 THEN 'citation_missing' WHEN e THEN 'correct_evidence' WHEN s THEN 'correct_source_wrong_evidence' ELSE 'unsupported_citation' END END AS auto_class,
  CASE WHEN NOT insufficient AND answerable AND judged THEN CASE WHEN n = 0 THEN 'citation_missing' WHEN u THEN 'correct_evidence' WHEN s THEN 'correct_source_wrong_evidence' ELSE 'unsupported_citation' END END AS judge_class FROM b)"""


def _records(spark, d):
    i = F.col("item_id")
    return table(spark, d, "benchmark").select(
        F.explode(F.array(F.lit("A"), F.lit("B"))).alias("arm"), "item_id", F.when(i % 17 == 3, "error").otherwise("ok").alias("status"), F.when(i % 4 == 0, "retrieval").otherwise("full").alias("mode"),
        (i % 5 != 1).alias("answerable"), (i % 7 == 2).alias("insufficient"), (i % 3 != 0).alias("judged"), F.when(i % 3 == 0, "dev").alias("split"))


def _bundle(spark, d, spans, got):
    hits = E.chunk_hits(got, spans, ["arm", "item_id"]).groupBy("arm", "item_id", "rank").agg(F.max("source").alias("source_ok"), F.max("section").alias("section_ok"))
    cited = got.filter("rank <= item_id % 3").select("arm", "item_id", "rank").join(hits, ["arm", "item_id", "rank"], "left").na.fill(False, ["source_ok", "section_ok"])
    return _rounded(E.citation_scores(_records(spark, d), cited.withColumn("supported", (F.col("item_id") + F.col("rank")) % 3 == 1), ["arm", "item_id"]))


@query(f"WITH {FIXTURE_SQL}, {_CITED_SQL}, {_RECORDS_SQL}, {_BUNDLE_SQL} SELECT * FROM bundle")
def citation_scores(spark, d):
    """Presence, precision, support, and the class of each answer's citations by places and by the judge."""
    spans = stored(_spans(spark, d), "spans")
    return _bundle(spark, d, spans, _retrieved(spark, d, spans))


@query(f"""WITH {FIXTURE_SQL}, {_CITED_SQL}, {_RECORDS_SQL}, {_BUNDLE_SQL}, {ANSWERS_SQL}, sc AS ({_SCORE_SQL}), known AS (SELECT DISTINCT item_id FROM spans WHERE item_id % 6 <> 0),
r2 AS (SELECT r.*, r.status = 'ok' AND r.answerable AND k.item_id IS NULL AS lacking FROM records r LEFT JOIN known k USING (item_id))
SELECT r.arm, r.item_id, r.status, r.mode, coalesce(r.split, 'eval') AS split, CASE WHEN r.status = 'ok' AND r.answerable AND NOT r.lacking THEN sc.section_hit_5 END AS section_hit_5,
  CASE WHEN r.status = 'ok' AND r.mode = 'full' THEN a.label END AS label, CASE WHEN r.status = 'ok' AND r.mode = 'full' AND NOT r.lacking THEN b.auto_class END AS auto_class, r.lacking AS spans_unavailable
FROM r2 r LEFT JOIN sc ON sc.arm = r.arm AND sc.item_id = r.item_id LEFT JOIN answers a ON a.doc_id = r.item_id LEFT JOIN bundle b ON b.arm = r.arm AND b.item_id = r.item_id""")
def scored_rows(spark, d):
    """A row for each record, with what can be scored where a case has no expected spans (here every sixth)."""
    spans = stored(_spans(spark, d), "spans")
    got, case = stored(_retrieved(spark, d, spans), "retrieved"), ["arm", "item_id"]
    arms = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("arm")
    answers = _answers(spark, d).select(arms, F.col("doc_id").alias("item_id"), "label", "check", "grounded", "points_covered")
    records = _records(spark, d).select("arm", "item_id", "status", "mode", "answerable", "split", F.lit("eval").alias("run_split"))
    rows = E.scored_rows(records, spans.filter("item_id % 6 <> 0"), E.retrieval_scores(got, spans, case), answers, _bundle(spark, d, spans, got), case)
    return rows.select("arm", "item_id", "status", "mode", "split", "retrieval.section_hit_5", "answer.label", "citation.auto_class", "spans_unavailable")
