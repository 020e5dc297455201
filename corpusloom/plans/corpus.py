"""Queries over documents: text functions, chunking, sections, duplicates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import code_aware_markers, code_aware_uncited, resolved_citations
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import markdown as M
from ..operators import plugins as P
from ..operators.ranges import Ranges, steps
from ..sources import html as H
from ..sources.shared import stored
from .base import WINDOWS_SQL, WS, query, sql_collapse, sql_strip, table


@query(f"WITH {WINDOWS_SQL} SELECT doc_id, CAST(\"window\" AS INT) AS \"window\", CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end, sha256(display_text) AS content_hash FROM windows")
def chunk_fixed_1600_200(spark, d):
    w = C.fixed_windows(table(spark, d, "documents"))
    return w.select("doc_id", "window", "char_start", "char_end", F.sha2("display_text", 256).alias("content_hash"))


@query(f"WITH {WINDOWS_SQL} SELECT doc_id, CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end, sha256(display_text) AS content_hash FROM windows")
def chunk_lateral(spark, d):
    """Chunks by a table function in SQL: SELECT ... FROM documents, LATERAL window_chunk(text)."""
    P.register(spark)
    found = spark.sql("SELECT d.doc_id, c.* FROM {docs} AS d, LATERAL window_chunk(d.text) AS c", docs=table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "char_start", "char_end", F.sha2("display_text", 256).alias("content_hash"))


CHUNKS_SQL = f"""{WINDOWS_SQL},
hashed AS (SELECT *, sha256(display_text) AS content_hash FROM windows),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY "window") AS nth FROM hashed) WHERE nth = 1),
chunks AS (SELECT doc_id, char_start, char_end, display_text, content_hash, row_number() OVER (PARTITION BY doc_id ORDER BY "window") - 1 AS idx FROM firsts)
"""


def _chunks(spark, d):
    return C.number_chunks(C.fixed_windows(table(spark, d, "documents")), "fixed-1600")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, printf('%d:fixed-1600:%04d', doc_id, idx) AS chunk_id, CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end, content_hash FROM chunks")
def chunk_ids_dedup(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk_id", "char_start", "char_end", "content_hash")


@query(f"""WITH {CHUNKS_SQL} SELECT source, count(*) AS total_chunks, CAST(min(char_end - char_start) AS INT) AS size_min,
CAST(quantile_disc(char_end - char_start, 0.5) AS INT) AS size_p50, CAST(quantile_disc(char_end - char_start, 0.9) AS INT) AS size_p90,
CAST(max(char_end - char_start) AS INT) AS size_max, count(*) FILTER (char_end - char_start < 400) AS small_chunks FROM chunks JOIN documents USING (doc_id) GROUP BY source""")
def chunk_stats_by_source(spark, d):
    chunks = _chunks(spark, d).select("doc_id", "char_start", "char_end").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return C.chunk_stats(chunks, ["source"], F.col("char_end") - F.col("char_start"))


#: A page for each source: its title, then a section for each document in the order of ids.
SECTIONS_SQL = """
parts AS (SELECT doc_id, source, lang, length('## ' || lang || chr(10) || chr(10) || text || chr(10)) AS n FROM documents),
placed AS (SELECT doc_id, source, lang, n, length('# ' || source || chr(10)) + sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS char_start FROM parts),
spans AS (SELECT source, doc_id, source || ' > ' || lang AS heading_path, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY char_start) AS INT) AS variant,
  CAST(count(*) OVER (PARTITION BY source, lang) AS INT) AS variant_count, CAST(char_start AS BIGINT) AS char_start,
  CAST(coalesce(lead(char_start) OVER (PARTITION BY source ORDER BY char_start), char_start + n) AS BIGINT) AS char_end FROM placed)
"""


def _section_spans(spark, d):
    """Sections of each source's page: places by running sums over ranges of (source, doc_id), so no source is gathered."""
    docs = table(spark, d, "documents")
    n = (F.length("text") + F.length("lang") + F.lit(6)).cast("long")
    path = F.concat_ws(" > ", "source", "lang")
    placed = Ranges(docs.select("doc_id", "source", "lang", n.alias("n")), ["source"], ["doc_id"]).running_sum("n", "up_to").done()
    placed = placed.select("doc_id", "source", "lang", "n", (F.length("source") + 3 + F.col("up_to") - F.col("n")).cast("long").alias("char_start"))
    ended = Ranges(placed, ["source"], ["char_start"]).next("char_start", "following").done()
    numbered = Ranges(ended.withColumn("one", F.lit(1)), ["source", "lang"], ["char_start"]).running_sum("one", "variant").total("one", "variant_count").done()
    return numbered.select("source", "doc_id", path.alias("heading_path"), F.col("variant").cast("int").alias("variant"), F.col("variant_count").cast("int").alias("variant_count"), "char_start", F.coalesce("following", F.col("char_start") + F.col("n")).alias("char_end"))


@query(f"WITH {SECTIONS_SQL} SELECT * FROM spans")
def section_spans_synth(spark, d):
    return _section_spans(spark, d)


def _last_start():
    """Where the last window of 1,600 characters of a page of n begins, at steps of 1,400."""
    return F.ceil(F.greatest(F.col("n") - 1600, F.lit(0)) / F.lit(1400.0)).cast("long") * 1400


@query(f"""WITH {SECTIONS_SQL}, ends AS (SELECT source, max(char_end) AS n FROM spans GROUP BY source),
starts AS (SELECT source, unnest(range(0, 1 + CAST(ceil(greatest(n - 1600, 0) / 1400.0) AS BIGINT))) * 1400 AS char_start FROM ends)
SELECT c.source, c.char_start, s.heading_path, s.variant FROM starts c ASOF LEFT JOIN spans s ON c.source = s.source AND c.char_start >= s.char_start""")
def section_at_chunk_start(spark, d):
    spans = _section_spans(spark, d)
    ends = spans.groupBy("source").agg(F.max("char_end").alias("n"))
    starts = steps(ends.select("source", _last_start().alias("last")), "last", 1400, "char_start").drop("last")
    found = C.section_at(starts, spans.select("source", F.col("char_start").alias("at"), "heading_path", "variant"), "source", "char_start", "at")
    return found.select("source", "char_start", "section.heading_path", "section.variant")


@query(f"""WITH {SECTIONS_SQL}, fences AS (SELECT source, char_start AS a, char_end AS b FROM spans WHERE doc_id % 3 = 0),
ends AS (SELECT source, max(char_end) AS n FROM spans GROUP BY source),
chunks AS (SELECT source, s * 1400 AS a, least(s * 1400 + 1600, n) AS b FROM (SELECT source, n, unnest(range(0, 1 + CAST(ceil(greatest(n - 1600, 0) / 1400.0) AS BIGINT))) AS s FROM ends))
SELECT c.source, c.a AS char_start, c.b AS char_end FROM chunks c WHERE EXISTS (SELECT 1 FROM fences f WHERE f.source = c.source AND greatest(c.a, f.a) < least(c.b, f.b) AND NOT (c.a <= f.a AND f.b <= c.b))""")
def fence_cut_chunks(spark, d):
    """Chunks that touch a fence without holding it. The overlap is an equality on blocks of 1,600 characters, so pages of any length join in pieces."""
    spans = _section_spans(spark, d)
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / 1600), F.floor((b - 1) / 1600))).alias("block")
    fences = spans.filter("doc_id % 3 = 0").select("source", F.col("char_start").alias("a"), F.col("char_end").alias("b"), blocks(F.col("char_start"), F.col("char_end")))
    ends = spans.groupBy("source").agg(F.max("char_end").alias("n"))
    starts = steps(ends.select("source", "n", _last_start().alias("last")), "last", 1400, "char_start").drop("last")
    chunks = starts.select("source", "char_start", F.least(F.col("char_start") + 1600, F.col("n")).alias("char_end"))
    pieces = chunks.select("*", blocks(F.col("char_start"), F.col("char_end")))
    cut = (F.greatest("char_start", "a") < F.least("char_end", "b")) & ~((F.col("char_start") <= F.col("a")) & (F.col("b") <= F.col("char_end")))
    return pieces.join(fences, (pieces.source == fences.source) & (pieces.block == fences.block) & cut, "left_semi").select("source", "char_start", "char_end").distinct()


@query(f"""WITH {SECTIONS_SQL}, refs AS (SELECT doc_id, source, source || ' > ' || lang AS heading_path, CASE WHEN doc_id % 3 = 0 THEN 1 END AS variant FROM documents WHERE doc_id % 50 = 0)
SELECT r.doc_id AS case_id, 'S1' AS slot, 'expected' AS role, r.source AS source_id, s.char_start, s.char_end FROM refs r JOIN spans s ON s.source = r.source AND s.heading_path = r.heading_path AND (r.variant IS NULL OR s.variant = r.variant)""")
def spans_by_section(spark, d):
    """Expected spans from an index of sections, written once: one section, or all of a path."""
    index = stored(_section_spans(spark, d).select(F.col("source").alias("source_id"), "heading_path", "variant", "char_start", "char_end"), "sections")
    docs = table(spark, d, "documents").filter("doc_id % 50 = 0")
    refs = docs.select(F.col("doc_id").alias("case_id"), F.lit("S1").alias("slot"), F.lit("expected").alias("role"), F.col("source").alias("source_id"), F.concat_ws(" > ", "source", "lang").alias("heading_path"), F.when(F.col("doc_id") % 3 == 0, 1).alias("variant"))
    return E.spans_from_index(refs, index, "case_id")


@query(f"""WITH {WINDOWS_SQL}, w AS (SELECT doc_id, "window", display_text, sha256(display_text) AS p, length(display_text) AS size, starts_with(display_text, 'a') AS cuts FROM windows),
once AS (SELECT doc_id, p, count(*) AS n, any_value(size) AS size, arg_min(cuts, "window") AS cuts FROM w GROUP BY doc_id, p),
per AS (SELECT doc_id, count(*) AS chunks, sum(n) - count(*) AS dropped FROM once GROUP BY doc_id),
a AS (SELECT source, count(*) AS documents, sum(coalesce(chunks, 0)) AS chunks_total, min(coalesce(chunks, 0)) AS lo, max(coalesce(chunks, 0)) AS hi, count(*) FILTER (chunks = 1) AS one, sum(coalesce(dropped, 0)) AS dropped, count(*) FILTER (dropped > 0) AS with_dropped,
  sum(CASE WHEN doc_id IN (1, 2) THEN coalesce(chunks, 0) ELSE 0 END) AS tiny FROM documents LEFT JOIN per USING (doc_id) GROUP BY source),
b AS (SELECT source, min(size) AS size_min, quantile_disc(size, 0.5) AS size_p50, quantile_disc(size, 0.9) AS size_p90, max(size) AS size_max, count(*) FILTER (cuts) AS cutting, count(*) FILTER (size < 400) AS small FROM once JOIN documents USING (doc_id) GROUP BY source)
SELECT a.source, documents, CAST(chunks_total AS BIGINT) AS chunks_total, lo AS chunks_per_document_min, hi AS chunks_per_document_max, one AS documents_with_one_chunk, CAST(dropped AS BIGINT) AS duplicates_dropped, with_dropped AS documents_with_duplicates, CAST(tiny AS BIGINT) AS chunks_of_tiny,
  CAST(size_min AS INT) AS size_min, CAST(size_p50 AS INT) AS size_p50, CAST(size_p90 AS INT) AS size_p90, CAST(size_max AS INT) AS size_max, cutting AS chunks_cutting_code, small AS small_chunks, CAST(0 AS BIGINT) AS heading_only_chunks, round(100 * cutting / chunks_total, 2) AS pct_cutting_code FROM a LEFT JOIN b USING (source)""")
def arm_chunk_stats(spark, d):
    """Chunk counts, sizes, repeats and marks of each source; as a mark that SQL can tell, chunks that begin with an a stand for those that cut code."""
    docs = table(spark, d, "documents")
    spans = C.fixed_windows(docs).withColumn("cuts_code", F.startswith("display_text", F.lit("a"))).withColumn("heading_only", F.lit(False))
    return C.arm_stats(docs, spans, ["source"], tiny=[1, 2])


def _paged(docs):
    """A Markdown page from each document: a title, and a section from every fourth line on."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("\n## Part "), i.cast("string"), F.lit("\n\n"), x)).otherwise(x))
    return docs.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


@query()
def chunk_header_aware(spark, d):
    chunks = C.header_chunks(_paged(table(spark, d, "documents")))
    return chunks.select("doc_id", "chunk_id", "char_start", "char_end", "heading_path", "content_hash", "cuts_code")


@query("""WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS source_id, 1 + CAST(ceil(n / 4.0) AS BIGINT) AS sections, 1 + CAST(ceil(n / 4.0) AS BIGINT) AS distinct_heading_paths FROM l""")
def section_inventory(spark, d):
    return M.inventory(_paged(table(spark, d, "documents")), "doc_id").select("source_id", "sections", "distinct_heading_paths")


@query("SELECT r AS doc_id FROM (SELECT unnest(range(0, (SELECT max(doc_id) + 100 FROM documents))) AS r) WHERE r NOT IN (SELECT doc_id FROM documents)")
def missing_document_ids(spark, d):
    docs = table(spark, d, "documents")
    return M.missing_ids(docs, "doc_id", 0, docs.agg(F.max("doc_id")).first()[0] + 99)


@query(f"""WITH h AS (SELECT doc_id, sha256(text) AS c, sha256({sql_collapse('text')}) AS passage_hash FROM documents)
SELECT passage_hash, count(*) AS n, count(DISTINCT c) AS n_contents, min(doc_id) AS first_id FROM h GROUP BY passage_hash HAVING count(*) > 1""")
def passage_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("c"), F.sha2(T.collapse_whitespace(F.col("text")), 256).alias("passage_hash"))
    return docs.groupBy("passage_hash").agg(F.count("*").alias("n"), F.count_distinct("c").alias("n_contents"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(f"SELECT doc_id, sha256({sql_collapse('text')}) AS passage_hash, CAST(length({sql_collapse('text')}) AS INT) AS n FROM documents")
def collapse_whitespace_hash(spark, d):
    t = T.collapse_whitespace(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("passage_hash"), F.length(t).alias("n"))


@query(f"""WITH t AS (SELECT doc_id, {sql_strip('text')} AS t FROM documents),
e AS (SELECT doc_id, t, left(t, 300) AS c, substring(t, 301, 1) AS nxt, regexp_extract(left(t, 300), '(?s)^(.+)[ \\n]', 1) AS back FROM t)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE regexp_replace(CASE WHEN NOT regexp_matches(nxt, '[{WS}]') AND back <> '' THEN back ELSE c END, '[{WS}]+$', '') END AS excerpt FROM e""")
def excerpt_300(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(nfc_normalize(text), '[%s%s]') THEN 'vi' ELSE 'en' END AS language FROM conversations""" % (T.VIETNAMESE, T.VIETNAMESE.upper()))
def detect_language_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.detect_language(F.col("text")).alias("language"))


_MARKED = "text || ' [' || turn || '] see [a](u) and ![b](v \"t\"). Plain words without any mark here. [2] [2] [0]'"


def _marked(spark, d):
    text = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit('] see [a](u) and ![b](v "t"). Plain words without any mark here. [2] [2] [0]'))
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))


@query(r"""SELECT conv_id, turn, sha256(regexp_replace(%s, '!?\[([^\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+"[^"\n]*")?\)', '\1', 'g')) AS hash FROM conversations""" % _MARKED)
def strip_links(spark, d):
    return _marked(spark, d).select("conv_id", "turn", F.sha2(T.strip_links(F.col("text")), 256).alias("hash"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn IN (0, 2) THEN [2] ELSE [CAST(turn AS INT), 2] END AS markers FROM conversations""")
def extract_markers(spark, d):
    return _marked(spark, d).select("conv_id", "turn", T.markers(F.col("text")).alias("markers"))


_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({_MARKED}, '([.!?]+(?:[ \t]*\[\d+\])*)([{WS}]|$)', '\1' || chr(1) || '\2', 'g'), '(\n+)', '\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"""


_UNCITED = r"CAST(len(list_filter(s, lambda x: NOT regexp_matches(x, '\[0*[1-9]\d*\]') AND len(regexp_extract_all(regexp_replace(x, '\[\d+\]', '', 'g'), '[\pL\pN_\pM]+')) >= 5)) AS INT)"
_CODED = _SENTENCES.replace(_MARKED, f"CASE WHEN turn % 2 = 1 THEN '`x 7` ' ELSE '' END || {_MARKED}")  # in code, a marker is two words


@query(f"SELECT conv_id, turn, CASE WHEN turn IN (0, 2) THEN [2] ELSE [CAST(turn AS INT), 2] END AS markers, {_UNCITED} AS uncited FROM (SELECT conv_id, turn, {_CODED} AS s FROM conversations)")
def code_aware_citations(spark, d):
    """Markers and uncited sentences where every second turn holds its marker in code."""
    t = _marked(spark, d).withColumn("text", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("`x [7]` "), "text")).otherwise(F.col("text")))
    return t.select("conv_id", "turn", code_aware_markers("text").alias("markers"), code_aware_uncited("text").alias("uncited"))


@query(rf"""SELECT conv_id, turn, CAST(len(s) AS INT) AS sentences, CAST(len(list_filter(s, lambda x: NOT regexp_matches(x, '\[0*[1-9]\d*\]') AND len(regexp_extract_all(regexp_replace(x, '\[\d+\]', '', 'g'), '[\pL\pN_\pM]+')) >= 5)) AS INT) AS uncited
FROM (SELECT conv_id, turn, {_SENTENCES} AS s FROM conversations)""")
def uncited_sentences(spark, d):
    t = F.col("text")
    return _marked(spark, d).select("conv_id", "turn", F.size(T.sentences(t)).alias("sentences"), T.uncited_sentences(t).alias("uncited"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn IN (0, 2) THEN [2] WHEN turn <= 3 THEN [CAST(turn AS INT), 2] ELSE [2] END AS cited, CASE WHEN turn > 3 THEN [CAST(turn AS INT)] ELSE CAST([] AS INT[]) END AS dropped FROM conversations""")
def resolve_citations(spark, d):
    """Of the markers, those of the three retrieved passages and those beyond."""
    found = _marked(spark, d).select("conv_id", "turn", resolved_citations(F.col("text"), F.array().cast("array<int>"), F.lit(3)).alias("r"))
    return found.select("conv_id", "turn", "r.cited", "r.dropped")


@query("SELECT doc_id, sha256(text || ' key=[REDACTED] own [REDACTED]') AS hash FROM documents")
def redact_keys(spark, d):
    key = "AIza" + "Sy0123456789abcdefghijklmnopqrstu_-"
    text = F.concat("text", F.lit(f" key={key} own top-secret"))
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redact(text, "top-secret"), 256).alias("hash"))


PRICES = {"in": 0.30, "out": 2.50}


@query(f"""WITH t AS (SELECT conv_id, role, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS n FROM conversations)
SELECT conv_id, CAST(coalesce(sum(n) FILTER (role <> 'assistant'), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens,
round((coalesce(sum(n) FILTER (role <> 'assistant'), 0) * {PRICES['in']}::DOUBLE + coalesce(sum(n) FILTER (role = 'assistant'), 0) * {PRICES['out']}::DOUBLE) / 1000000, 9) AS usd FROM t GROUP BY conv_id""")
def token_estimate_and_cost(spark, d):
    n, out = T.estimated_tokens(F.col("text")).cast("long"), F.col("role") == "assistant"
    sums = table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.sum(F.when(~out, n)), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(F.when(out, n)), F.lit(0)).alias("output_tokens"))
    return sums.withColumn("usd", F.round((F.col("prompt_tokens") * PRICES["in"] + F.col("output_tokens") * PRICES["out"]) / 1000000, 9))


@query("""WITH o AS (SELECT lang, source, count(*) AS n, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source)
SELECT lang, source, n, labelled, good, round(n / sum(n) OVER (PARTITION BY lang), 4) AS share_of_lang FROM o""")
def coverage_matrix(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    n = both.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    return n.withColumn("share_of_lang", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 4))


@query()
def html_to_text_sections(spark, d):
    """Pages as text, with their titles and the sections of that text."""
    pages = H.html_documents(table(spark, d, "pages"), "page_id", "html")
    counts = M.sections_frame(pages, "page_id", "text").groupBy("source_id").agg(F.count("*").alias("sections"))
    return pages.join(counts.withColumn("page_id", F.col("source_id").cast("long")).drop("source_id"), "page_id", "left").select("page_id", "title", F.length("text").alias("chars"), F.coalesce("sections", F.lit(0)).alias("sections"))
