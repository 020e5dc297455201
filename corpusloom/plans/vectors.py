"""Queries over vectors: search, deduplication, the gate, and two arms compared. Every fiftieth vector is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ann as A
from ..operators import retrieval as R
from ..operators import statistics as S
from ..sources.shared import shared_folder, stored
from .base import query, sql_collapse, table

_PAIRS = """
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS q_label, c.label AS label,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score,
  round(list_cosine_similarity(CAST(q.embedding[1:32] AS DOUBLE[]), CAST(c.embedding[1:32] AS DOUBLE[])), 6) AS half FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0)
"""


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0")


@query(f"""WITH {_PAIRS} SELECT query_id, id, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored) WHERE r <= 5""")
def vector_topk_raw(spark, d):
    return R.top_k(_queries(spark, d), table(spark, d, "embeddings"), R.K)


@query("""SELECT CAST(count(*) FILTER (vec_id % 50 = 0) AS BIGINT) AS n_queries, CAST(count(*) FILTER (vec_id % 50 = 0) * least(5, count(*)) AS BIGINT) AS n_true, true AS reached, true AS exact_with_all_cells FROM embeddings""")
def ann_recall(spark, d):
    """Hits of the inverted file (five eighths of its cells probed: these vectors have hardly any clusters) against those of all rows: whether recall at 5 reaches 0.9, and 1 with all cells."""
    rows = table(spark, d, "embeddings")
    path = shared_folder(spark)
    cells = A.build(rows, path, cells=32)["cells"]
    exact = stored(R.top_k(_queries(spark, d), rows, R.K), "exact")
    some, all_ = (A.recall(A.search(spark, path, _queries(spark, d), R.K, probes=n, space="cosine"), exact) for n in (-(-5 * cells // 8), cells))
    return some.crossJoin(F.broadcast(all_.select(F.col("n_found").alias("all_found")))).select("n_queries", "n_true", (10 * F.col("n_found") >= 9 * F.col("n_true")).alias("reached"), (F.col("all_found") == F.col("n_true")).alias("exact_with_all_cells"))


_HITS = f"""{_PAIRS},
col AS (SELECT s.*, sha256({sql_collapse('text')}) AS passage_hash FROM scored s JOIN documents ON doc_id = id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM col) WHERE r <= 15),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, passage_hash ORDER BY score DESC, id) AS nth, list(id) OVER (PARTITION BY query_id, passage_hash ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS same FROM top),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, sum(len(same) - 1) OVER (PARTITION BY query_id) AS dropped FROM kept WHERE nth = 1),
final AS (SELECT query_id, id, score, passage_hash, CAST(rank AS INT) AS rank, same[2:] AS duplicate_ids, CAST(dropped AS BIGINT) AS duplicates_dropped FROM firsts WHERE rank <= 5)
"""


def _hits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    collection = table(spark, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    found = R.top_k(_queries(spark, d), collection, R.K + R.OVER_FETCH).drop("rank")
    # passages are hashed after the search: those of the few hits, once each
    near = docs.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    passages = near.select(F.col("doc_id").alias("id"), F.sha2(T.collapse_whitespace(F.col("text")), 256).alias("passage_hash"))
    return R.dedup_hits(found.join(passages, "id"), "passage_hash")


@query(f"WITH {_HITS} SELECT query_id, id, score, rank, passage_hash, duplicate_ids, duplicates_dropped, max(score) OVER (PARTITION BY query_id) < 0.75 AS gated FROM final")
def retrieve_topk_dedup(spark, d):
    """The whole search: over-fetch, drop repeated passages, rank anew, cut, and say whether the gate would close."""
    from pyspark.sql import Window as W

    top1 = F.max("score").over(W.partitionBy("query_id"))
    return _hits(spark, d).select("query_id", "id", "score", "rank", "passage_hash", "duplicate_ids", "duplicates_dropped", R.gate(top1, 0.75).alias("gated"))


_TOP1 = f"""WITH {_PAIRS}, others AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored WHERE id <> query_id), top1 AS (SELECT query_id, q_label, score AS top1_score FROM others WHERE r = 1)"""


def _top1(spark, d):
    found = R.top_k(_queries(spark, d), table(spark, d, "embeddings"), 1, skip_self=True)
    return found.join(_queries(spark, d).select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id").select("query_id", "q_label", F.col("score").alias("top1_score"))


@query(f"{_TOP1} SELECT query_id, top1_score, top1_score < 0.3 AS gated FROM top1")
def gate_decision(spark, d):
    return _top1(spark, d).select("query_id", "top1_score", R.gate(F.col("top1_score"), 0.3).alias("gated"))


@query(f"""{_TOP1}, t AS (SELECT round(min(top1_score) FILTER (q_label < 5) - 0.05, 4) AS threshold FROM top1)
SELECT threshold, count(*) FILTER (top1_score < threshold) AS n_gated, count(*) FILTER (q_label < 5 AND top1_score < threshold) AS n_gated_answerable FROM top1, t GROUP BY threshold""")
def gate_threshold_tuning(spark, d):
    return R.tuned_threshold(_top1(spark, d), F.col("q_label") < 5)


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE id <> query_id),
f AS (SELECT query_id, q_label, min(rank) FILTER (label = q_label AND rank <= 5) AS first FROM r GROUP BY query_id, q_label)
SELECT q_label AS label, count(*) AS n, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg((first = 1)::INT::DOUBLE), 6) AS hit_1 FROM (SELECT query_id, q_label, coalesce(first, 0) AS z, first FROM f) GROUP BY q_label""")
def vector_mrr_by_label(spark, d):
    rank = _first_ranks(spark, d, "embedding")
    return rank.groupBy(F.col("q_label").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.col("first") == 1).cast("int").cast("double")), 6).alias("hit_1"))


def _first_ranks(spark, d, vector):
    """(query_id, q_label, first): the rank among five of the first other vector with the query's label."""
    from pyspark.sql.functions import slice as part

    cut = lambda df: df.select("vec_id", "label", (part("embedding", 1, 32) if vector == "half" else F.col("embedding")).alias("embedding"))
    rows, asked = cut(table(spark, d, "embeddings")), cut(_queries(spark, d))
    hits = R.top_k(asked, rows, R.K, skip_self=True).join(rows.select(F.col("vec_id").alias("id"), "label"), "id")
    both = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")).join(hits, "query_id", "left")
    return both.groupBy("query_id", "q_label").agg(F.min(F.when(F.col("label") == F.col("q_label"), F.col("rank"))).alias("first"))


_ARMS = f"""WITH {_PAIRS}, ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE id <> query_id),
rb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY half DESC, id) AS rank FROM scored WHERE id <> query_id),
fa AS (SELECT query_id, q_label, min(rank) FILTER (label = q_label AND rank <= 5) AS first FROM ra GROUP BY query_id, q_label),
fb AS (SELECT query_id, min(rank) FILTER (label = q_label AND rank <= 5) AS first FROM rb GROUP BY query_id),
pairs AS (SELECT query_id, q_label, coalesce((fa.first = 1)::INT, 0) AS a, coalesce((fb.first = 1)::INT, 0) AS b, coalesce(1.0::DOUBLE / fa.first, 0) AS rr_a, coalesce(1.0::DOUBLE / fb.first, 0) AS rr_b FROM fa JOIN fb USING (query_id))"""


def _arms(spark, d):
    hit, rr = lambda c: F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)), lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    a, b = _first_ranks(spark, d, "embedding").withColumnRenamed("first", "fa"), _first_ranks(spark, d, "half").select("query_id", F.col("first").alias("fb"))
    return a.join(b, "query_id").select("query_id", "q_label", hit("fa").alias("a"), hit("fb").alias("b"), rr("fa").alias("rr_a"), rr("fb").alias("rr_b"))


@query(f"{_ARMS} SELECT query_id, a, b, round(rr_b - rr_a, 6) AS rr_diff, CASE WHEN a = b THEN 'same' WHEN a > b THEN 'A_only' ELSE 'B_only' END AS outcome FROM pairs")
def paired_arms_diff(spark, d):
    outcome = F.when(F.col("a") == F.col("b"), "same").when(F.col("a") > F.col("b"), "A_only").otherwise("B_only")
    return _arms(spark, d).select("query_id", "a", "b", F.round(F.col("rr_b") - F.col("rr_a"), 6).alias("rr_diff"), outcome.alias("outcome"))


@query(f"{_ARMS} SELECT q_label % 2 AS slice, count(*) AS n, count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 1 AND b = 0) AS a_only, count(*) FILTER (a = 0 AND b = 1) AS b_only, count(*) FILTER (a = 0 AND b = 0) AS neither FROM pairs GROUP BY q_label % 2")
def mcnemar_counts(spark, d):
    return S.mcnemar_counts(_arms(spark, d).withColumn("slice", F.col("q_label") % 2), "slice")


@query(f"{_ARMS} SELECT query_id, list_filter([CASE WHEN a <> b THEN 'hit_1 ' || a || ' -> ' || b END, CASE WHEN rr_a <> rr_b THEN 'mrr differs' END], lambda x: x IS NOT NULL) AS reasons FROM pairs WHERE a <> b OR rr_a <> rr_b")
def discordant_cases(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("a") != F.col("b"), F.concat(F.lit("hit_1 "), F.col("a").cast("string"), F.lit(" -> "), F.col("b").cast("string"))), F.when(F.col("rr_a") != F.col("rr_b"), F.lit("mrr differs"))))
    return _arms(spark, d).select("query_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


@query(f"""{_ARMS}, dd AS (SELECT q_label % 2 AS slice, round(rr_b - rr_a, 12) AS d FROM pairs), nz AS (SELECT *, rank() OVER (PARTITION BY slice ORDER BY abs(d)) + (count(*) OVER (PARTITION BY slice, abs(d)) - 1) / 2.0 AS r FROM dd WHERE d <> 0),
s AS (SELECT slice, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM nz GROUP BY slice)
SELECT z.slice, z.zeros, coalesce(n, 0) AS n, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus FROM (SELECT slice, count(*) FILTER (d = 0) AS zeros FROM dd GROUP BY slice) z LEFT JOIN s USING (slice)""")
def wilcoxon_ranks(spark, d):
    return S.signed_ranks(_arms(spark, d).select((F.col("q_label") % 2).alias("slice"), F.col("rr_a").alias("a"), F.col("rr_b").alias("b")), "slice")


@query()
def bootstrap_ci(spark, d):
    """Interval, test and wording for hit at 1."""
    pairs = _arms(spark, d).select(F.lit("hit_1").alias("metric"), F.col("query_id").alias("case_id"), "a", "b")
    return S.compare(pairs, "binary")


@query()
def compare_metrics(spark, d):
    pairs = _arms(spark, d).select(F.lit("mrr").alias("metric"), F.col("query_id").alias("case_id"), F.col("rr_a").alias("a"), F.col("rr_b").alias("b"))
    return S.compare(pairs, "continuous")


@query(f"WITH {_HITS} SELECT query_id, CAST(count(*) - count(DISTINCT passage_hash) AS BIGINT) AS repeats, count(*) FILTER (label <> q_label) AS off_target, count(*) FILTER (len(duplicate_ids) > 0) AS with_copies FROM (SELECT f.*, t.label, t.q_label FROM final f JOIN top t USING (query_id, id)) GROUP BY query_id")
def failure_mode_signals(spark, d):
    e = table(spark, d, "embeddings")
    hits = _hits(spark, d).join(e.select(F.col("vec_id").alias("id"), "label"), "id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    return hits.groupBy("query_id").agg((F.count("*") - F.count_distinct("passage_hash")).alias("repeats"), F.count_if(F.col("label") != F.col("q_label")).alias("off_target"), F.count_if(F.size("duplicate_ids") > 0).alias("with_copies"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, round(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x)[1] / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS first FROM embeddings")
def l2_normalize(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(R.l2_norm(v), 6).alias("norm"), F.round(R.l2_normalized(v)[0], 6).alias("first"))

