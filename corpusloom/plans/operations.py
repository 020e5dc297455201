"""Queries of running an evaluation: records, resuming, budgets, latency, agreement, sampling, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import experiment as X
from ..operators import judging as J
from ..operators import statistics as S
from ..operators import validation as V
from ..sources import records as L
from ..sources import store
from ..sources.shared import shared_folder
from ..streaming import throttle
from .base import query, table


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_record_per_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), "event_id", "value")
    return store.latest(rows, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending_anti_join(spark, d):
    return store.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("""WITH k AS (SELECT doc_id AS seq, text, sha256('m|doc|' || text) AS key FROM documents), cached AS (SELECT DISTINCT key FROM k WHERE seq IN (SELECT doc_id FROM labels))
SELECT key, min(seq) AS seq FROM k WHERE key NOT IN (SELECT key FROM cached) GROUP BY key""")
def embedding_cache_misses(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text")
    known = docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("seq")), "seq", "left_semi")
    cache = known.select(T.cache_key(F.lit("m"), F.lit("doc"), F.col("text")).alias("key")).distinct().withColumn("vector", F.array(F.lit(0.0)))
    return store.split_by_cache(docs, cache, "m", "doc")[1].select("key", "seq")


_SUMMARY = "count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max"


@query(f"SELECT event_type, {_SUMMARY} FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_summary(spark, d):
    return E.latency_summary(table(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@query(f"SELECT event_type, CAST(props->>'$.k' AS INT) < 50 AS clean, {_SUMMARY} FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def latency_clean_split(spark, d):
    rows = table(spark, d, "events").withColumn("clean", F.get_json_object("props", "$.k").cast("int") < 50)
    return E.latency_summary(rows, "value", "event_type", "clean").withColumn("mean", F.round("mean", 6))


@query("""SELECT event_id, count(*) OVER w AS calls, round(sum(value) OVER w, 6) AS amount FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""")
def throttle_window_usage(spark, d):
    return throttle.usage(table(spark, d, "events"), "user_id", "ts", "value").select("event_id", "calls", "amount")


@query("""WITH t AS (SELECT conv_id, turn, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS cost FROM conversations)
SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS spent FROM t) WHERE spent <= 300""")
def budget_cutoff(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.estimated_tokens(F.col("text")).cast("long").alias("cost"))
    return throttle.within_budget(rows, ["turn"], "cost", 300, "conv_id").select("conv_id", "turn", "spent")


@query("""WITH v AS (SELECT unnest([0, 1]) AS l), g AS (SELECT a.l AS quality, b.l AS toxic FROM v a, v b)
SELECT quality, toxic, (SELECT count(*) FROM labels l WHERE l.quality = g.quality AND l.toxic = g.toxic) AS n FROM g""")
def confusion_matrix(spark, d):
    return S.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic)::DOUBLE AS same, count(*) FILTER (quality = 1)::DOUBLE AS q1, count(*) FILTER (toxic = 1)::DOUBLE AS t1 FROM labels),
p AS (SELECT n, same / n AS po, (q1 * t1 + (n - q1) * (n - t1)) / (n * n) AS pe FROM t)
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM p""")
def kappa_agreement(spark, d):
    return S.agreement(table(spark, d, "labels"), "quality", "toxic").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("""WITH s AS (SELECT quality, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality, lang),
t AS (SELECT least(sum(n), greatest(count(*), CAST(round_even(sum(n) * 0.15, 0) AS BIGINT))) AS target FROM s),
turns AS (SELECT quality, lang, n, unnest(range(1, n + 1)) AS turn FROM s), placed AS (SELECT *, row_number() OVER (ORDER BY turn, lang, quality) AS place FROM turns)
SELECT quality, lang, n, count(*) FILTER (place <= (SELECT target FROM t)) AS take FROM placed GROUP BY quality, lang, n""")
def stratified_allocation(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return S.allocation(rows.groupBy("lang", "quality").agg(F.count("*").alias("n")), 0.15).select("quality", "lang", "n", "take")


@query("""WITH d AS (SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)), s AS (SELECT quality, lang, count(*) AS n FROM d GROUP BY quality, lang),
t AS (SELECT least(sum(n), greatest(count(*), CAST(round_even(sum(n) * 0.15, 0) AS BIGINT))) AS target FROM s),
turns AS (SELECT quality, lang, unnest(range(1, n + 1)) AS turn FROM s), placed AS (SELECT *, row_number() OVER (ORDER BY turn, lang, quality) AS place FROM turns),
takes AS (SELECT quality, lang, count(*) FILTER (place <= (SELECT target FROM t)) AS take FROM placed GROUP BY quality, lang),
o AS (SELECT *, row_number() OVER (PARTITION BY quality, lang ORDER BY md5('pick:' || doc_id), doc_id) AS nth FROM d)
SELECT o.doc_id, o.quality, o.lang FROM o JOIN takes USING (quality, lang) WHERE nth <= take""")
def stratified_pick(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "quality", "lang")
    return S.stratified_pick(rows, ["lang", "quality"], "doc_id", 0.15)


@query("SELECT event_id, user_id, event_type, value FROM events")
def record_lines_roundtrip(spark, d):
    """Events as a log of JSON lines, read back by the library's own data source in ranges."""
    L.register(spark)
    path = f"{shared_folder(spark)}/log"
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    return spark.read.format("record_lines").schema("event_id long, user_id long, event_type string, value double").option("rangeBytes", 1 << 20).load(path)


@query("""SELECT 'short_text' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE length(text) < 20
UNION ALL SELECT 'unknown_language', CAST(doc_id AS VARCHAR) FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT 'wrong_length', CAST(doc_id AS VARCHAR) FROM documents WHERE length(text) <> n_chars
UNION ALL SELECT 'unlabelled', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'repeated_text', CAST(min(doc_id) AS VARCHAR) FROM documents GROUP BY text HAVING count(*) > 1""")
def validation_violations(spark, d):
    """A row for each broken rule and key; none where all hold."""
    docs = table(spark, d, "documents")
    return V.violations({
        "short_text": docs.filter(F.length("text") < 20).select("doc_id"),
        "unknown_language": V.not_allowed(docs, "lang", ["en", "fr", "de"]).select("doc_id"),
        "wrong_length": docs.filter(F.length("text") != F.col("n_chars")).select("doc_id"),
        "unlabelled": V.without_match(docs.select("doc_id"), table(spark, d, "labels"), ["doc_id"]),
        "repeated_text": V.repeated(docs, ["text"], "doc_id").select("doc_id"),
    })


@query("""WITH h AS (SELECT doc_id, sha256(text) AS c FROM documents), l AS (SELECT c FROM h WHERE doc_id IN (SELECT doc_id FROM labels)), u AS (SELECT c FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT c FROM l INTERSECT SELECT c FROM u""")
def split_overlap(spark, d):
    """Contents that stand on both sides of a split that should be disjoint."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("c"))
    labels = table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").select("c").intersect(docs.join(labels, "doc_id", "left_anti").select("c"))


@query("""SELECT quality, toxic, count(*) AS n, round(sum(length(text)) / 1000.0::DOUBLE, 3) AS kchars FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (quality), (toxic), (quality, toxic))""")
def label_grouping_sets(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.length("text").alias("n_text")), "doc_id")
    return rows.groupingSets([[], ["quality"], ["toxic"], ["quality", "toxic"]], "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.sum("n_text") / F.lit(1000.0), 3).alias("kchars"))


_STAGES_SQL = """rec AS (SELECT event_id, user_id, event_type, value AS retrieve, CASE WHEN CAST(props->>'$.k' AS INT) % 7 <> 0 THEN CAST(props->>'$.k' AS DOUBLE) END AS generate, CAST(props->>'$.k' AS INT) < 50 AS clean FROM events),
stages AS (SELECT event_id, clean, 'retrieve' AS stage, retrieve AS ms FROM rec UNION ALL SELECT event_id, clean, 'generate', generate FROM rec UNION ALL SELECT event_id, clean, 'total', retrieve + generate FROM rec)"""


def _stages(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    rec = table(spark, d, "events").select("event_id", F.col("value").alias("retrieve"), F.when(k % 7 != 0, k.cast("double")).alias("generate"), (k < 50).alias("clean")).withColumn("total", F.col("retrieve") + F.col("generate"))
    return rec.unpivot(["event_id", "clean"], ["retrieve", "generate", "total"], "stage", "ms")


@query(f"WITH {_STAGES_SQL} SELECT clean, stage, count(*) AS n, round(avg(ms), 6) AS mean, round(quantile_disc(ms, 0.5), 6) AS p50, round(quantile_disc(ms, 0.95), 6) AS p95, round(max(ms), 6) AS max FROM stages WHERE ms IS NOT NULL GROUP BY clean, stage")
def latency_by_stage(spark, d):
    """Latency of each stage, null stages left out, clean records apart from retried ones."""
    found = E.latency_summary(_stages(spark, d), "ms", "clean", "stage")
    return found.select("clean", "stage", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "max")])


@query("""SELECT user_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds,
round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_rate FROM events GROUP BY user_id""")
def run_tally(spark, d):
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("errors"), F.count_distinct("event_type").alias("kinds"), F.round(E.rate(F.count_if(bad), F.count("*")), 6).alias("error_rate"))


@query("""WITH p AS (SELECT * FROM (VALUES ('user', 0.3::DOUBLE, 2.5::DOUBLE), ('assistant', 0.1, 0.4), ('system', NULL, 1.0)) AS t(model, i, o)),
t AS (SELECT role, conv_id, CAST(sum(greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT))) AS BIGINT) AS tokens, count(*) AS calls FROM conversations GROUP BY role, conv_id)
SELECT conv_id, role, tokens, calls, round((tokens * i + calls * o) / 1000000, 9) AS usd, i IS NULL OR o IS NULL AS unpriced FROM t LEFT JOIN p ON model = role""")
def cost_by_model(spark, d):
    """Tokens and list price of each model's calls; without a price there is no cost."""
    prices = spark.createDataFrame([("user", 0.3, 2.5), ("assistant", 0.1, 0.4), ("system", None, 1.0)], "model string, i double, o double")
    sums = table(spark, d, "conversations").groupBy("role", "conv_id").agg(F.sum(T.estimated_tokens(F.col("text")).cast("long")).alias("tokens"), F.count("*").alias("calls"))
    both = sums.join(F.broadcast(prices), F.col("model") == F.col("role"), "left")
    return both.select("conv_id", "role", "tokens", "calls", F.round(E.cost_usd(F.col("tokens"), F.col("calls"), F.lit(0), F.col("i"), F.col("o")), 9).alias("usd"), (F.col("i").isNull() | F.col("o").isNull()).alias("unpriced"))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.doc_id <> d.doc_id)")
def parallel_subset(spark, d):
    """Rows that have a twin in their group."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("g"))
    return X.with_twins(docs, "g", "doc_id").select("doc_id")


@query("""SELECT doc_id, l.doc_id IS NULL AS only_left, d.doc_id IS NULL AS only_right FROM documents d FULL OUTER JOIN (SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 10000000) l USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id IS NULL""")
def sheet_key_mismatches(spark, d):
    """Ids of a sheet and of its key that do not answer to each other."""
    right = table(spark, d, "labels").filter("quality = 1").select("doc_id").union(spark.createDataFrame([(10000000,)], "doc_id long"))
    return J.mismatched(table(spark, d, "documents"), right, "doc_id")


@query("SELECT doc_id, coalesce(o.toxic, l.toxic) AS toxic, o.toxic IS NOT NULL AS overridden FROM labels l LEFT JOIN (SELECT doc_id, 1 - toxic AS toxic FROM labels WHERE doc_id % 17 = 0) o USING (doc_id)")
def overrides_applied(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("stage"))
    owner = labels.filter("doc_id % 17 = 0").select("doc_id", (1 - F.col("stage")).alias("stage"), F.lit("read by hand").alias("reason"))
    return X.apply_overrides(labels, owner, ("doc_id",)).select("doc_id", F.col("stage").alias("toxic"), F.col("override_reason").isNotNull().alias("overridden"))


@query("""WITH r AS (SELECT event_id, ts, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) AS n, count(before) AS followed, min(event_id) AS first_id, max(event_id) AS last_id FROM r GROUP BY user_id""")
def record_sequences(spark, d):
    from pyspark.sql import Window as W

    rows = table(spark, d, "events").withColumn("before", F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count("before").alias("followed"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query()
def answer_flow(spark, d):
    """Questions through the gate, a model and citation resolution; the model here is a fixed function of the prompt."""
    from .answering import answer_frame
    from .vectors import _hits

    found = _hits(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select("query_id", "rank", "score", "text")
    asked = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("What does passage "), F.col("vec_id").cast("string"), F.lit(" say?")).alias("question"))
    reply = '{"insufficient": false, "answer": "It says this [1] and that [9].", "cited_passages": [2], "missing_information": ""}'
    return answer_frame(asked, found, 0.5, lambda prompt: reply)
