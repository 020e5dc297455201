"""The registered queries of the operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    found = quality.apply_policy(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


OP2_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
win AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r),
top AS (SELECT r, max(c) AS n FROM (SELECT r, word, count(*) AS c FROM (SELECT r, unnest(words) AS word FROM w) GROUP BY r, word) GROUP BY r),
li AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, coalesce(top.n, 0)::BIGINT AS top_word,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower
  FROM w JOIN li USING (r) LEFT JOIN rep USING (r) LEFT JOIN top USING (r)),
b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (2 * word_chars < 5 * n_words)::BIGINT + 32 * (word_chars > 14 * n_words)::BIGINT
    + 64 * (n_words >= 20 AND 100 * top_word > 30 * n_words)::BIGINT + 128 * (10 * n_upper > 3 * (n_upper + n_lower))::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.formatted(chat.link_quotes(_table(spark, sf_dir, "conversations")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import surrogates

    found = surrogates.pseudonymise(_table(spark, sf_dir, "documents"), key=b"registered query", kinds_as="kinds")
    return found.select("doc_id", "text", "kinds", F.size("kinds").alias("n_replaced"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    found = linededup.dedup_lines(_table(spark, sf_dir, "documents"), count_as="n_removed")
    return found.select("doc_id", "text", "n_removed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rejected")


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pfor

    folder = pfor.encode_corpus(_table(spark, sf_dir, "documents"))
    return pfor.read_token_files(spark, folder)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    found = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, repeats=2)
    return found.documents.select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][rk % 3 + 1] AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
v AS (
  SELECT *, (1.5 * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, rk, least(cap::DOUBLE, weight * (SELECT arg_min(level, (cap / weight, rk)) FROM v WHERE cap > weight * level)) AS target FROM v),
once AS (
  SELECT d.r, d.size, t.source_size, t.rk, t.target, (sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.turn, d.r) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT r, size, rk, target, start + unnest([0, source_size]) AS start FROM once),
p AS (
  SELECT r, rk, target, start AS a, least(start + size, greatest(floor(target)::BIGINT, start)) AS b FROM q
  UNION ALL SELECT r, rk, target, greatest(start, least(floor(target)::BIGINT, start + size)), start + size FROM q),
o AS (SELECT r, b - a AS words, sum(b - a) OVER (ORDER BY b / target, rk, b) - (b - a) AS ahead FROM p WHERE b > a AND target > 0),
k AS (SELECT r, sum(greatest(0, least(words, (SELECT floor(1.5 * any_value(total)) FROM w)::BIGINT - ahead)))::BIGINT AS taken FROM o GROUP BY r)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON d.r = k.r
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(_table(spark, sf_dir, "embeddings"), k=8)[0]


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import phrases

    return phrases.collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, words, i, unnest(range(1, least(5, len(words) - i + 1) + 1)) AS m FROM s),
f AS (SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 100),
k AS (SELECT lang, phrase, a, m, ws, unnest(range(1, m)) AS k FROM c),
x AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM k JOIN n USING (lang) JOIN f AS l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f AS r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS longer ON longer.lang = c.lang AND longer.m > c.m AND longer.a >= c.a AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ')),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN o USING (lang, phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= 2000
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op6_licenses": op6_licenses,
    "op7_surrogates": op7_surrogates,
    "op5_decontamination": op5_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op10_token_blocks": op10_token_blocks,
    "op11_mixing": op11_mixing,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}
ORACLES = {"op2_quality": OP2_SQL, "op11_mixing": OP11_SQL, "op13_collocations": OP13_SQL}
