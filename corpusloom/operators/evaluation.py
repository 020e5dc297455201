"""Scores of retrieval and answers: spans, hits, ranks, evidence, labels, citations, summaries and failures.

Everything is joins and grouped aggregates over long tables; every rate has its own denominator, and is null where that is 0.
"""

from __future__ import annotations

import pickle
from functools import partial

import ahocorasick
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import opened, shared_folder
from .ranges import nearest_ranks, with_ranks

HIT_KS = (1, 3, 5)
CORRECT, PARTIAL, INCORRECT, FALSE_REFUSAL, CORRECT_REFUSAL, HALLUCINATION = "correct", "partially_correct", "incorrect", "false_refusal", "correct_refusal", "hallucination"
LABELS = (CORRECT, PARTIAL, INCORRECT, FALSE_REFUSAL, CORRECT_REFUSAL, HALLUCINATION)
CITATION_CLASSES = ("correct_evidence", "correct_source_wrong_evidence", "unsupported_citation", "citation_missing")


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open spans share a character; touching ones do not."""
    return F.greatest(a0, b0) < F.least(a1, b1)


# --- expected spans --------------------------------------------------------------------------------------------


def _write_items(batches, folder: str):
    """Rows (block, item_id, text) sorted by block: a file of each block's items."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    now, held = None, []

    def close():
        with fs.open_output_stream(f"{path}/items-{now}") as out:
            out.write(pickle.dumps(held, 5))
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], names=["block"])

    for batch in batches:
        for block, *item in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now:
                if held:
                    yield close()
                now, held = block, []
            held.append(tuple(item))
    if held:
        yield close()


def _automaton(items: list[tuple]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for item_id, text in items:
        _, ids = found.get(text, (0, ()))
        found.add_word(text, (len(text), (*ids, item_id)))
    found.make_automaton()
    return found


def _find(batches, folder: str, blocks: list[int], item_type: pa.DataType, chars: int = 16_000_000):
    """Rows (doc_id, text) in parts of about ``chars`` characters; each part meets every block of items, of which a task holds one."""
    fs, path = opened(folder)
    last: tuple[int, ahocorasick.Automaton] | None = None
    held, size = [], 0

    def flush():
        nonlocal last
        for block in blocks if last is None or last[0] == blocks[0] else blocks[::-1]:  # the one at hand first
            if last is None or last[0] != block:
                with fs.open_input_stream(f"{path}/items-{block}") as file:
                    last = block, _automaton(pickle.loads(file.read()))
            for batch in held:
                rows = []
                for k, text in enumerate(batch.column(1)):
                    first: dict = {}
                    for end, (n, ids) in last[1].iter(text.as_py() or ""):
                        for i in ids:
                            first.setdefault((i, n), end + 1 - n)
                    rows += [(k, i, s, s + n) for (i, n), s in first.items()]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "char_start", "char_end"])

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            held.append(batch.slice(at, 512))
            size += pa.compute.sum(pa.compute.binary_length(held[-1].column(1))).as_py() or 0
            if size >= chars:
                yield from flush()
                held, size = [], 0
    yield from flush()


def passage_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, char_start, char_end): where a document first holds an item's whole text (each text of an id that has several lengths).

    Items, of any type of id, are written in blocks of a bounded size as files that tasks read; documents are read once,
    whatever the number of items, and not shuffled. The driver holds the numbers of the blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.filter(F.col(item_text) != "").select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    kind, total = asked.schema["item_id"].dataType, asked.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, char_start int, char_end int"
    if not total:
        return spark.createDataFrame([], shape)
    folder, blocks = shared_folder(spark), -(-total // block_chars)
    tasks = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")).select("block", "item_id", "text").repartition(tasks, "block").sortWithinPartitions("block")
    written = sorted(r.block for r in dealt.mapInArrow(partial(_write_items, folder=folder), "block int").collect())
    return rows.mapInArrow(partial(_find, folder=folder, blocks=written, item_type=to_arrow_type(kind)), shape)


def spans_from_index(refs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, slot, role, source_id, char_start, char_end): the places of sections that cases refer to.

    ``refs``: key, slot, role, source_id, heading_path, variant (null: every one of that path). ``index``: source_id, heading_path,
    variant, char_start, char_end. A reference that matches no section raises when it is read.
    """
    places = index.select(F.col("source_id").alias("s"), F.col("heading_path").alias("h"), F.col("variant").alias("v"), "char_start", "char_end")
    met = refs.join(places, (F.col("source_id") == F.col("s")) & (F.col("heading_path") == F.col("h")) & (F.col("variant").isNull() | (F.col("variant") == F.col("v"))), "left")
    said = F.concat_ws(" ", F.lit("no section for"), F.col(key).cast("string"), F.col("source_id").cast("string"), "heading_path", F.col("variant").cast("string"))
    start = F.when(F.col("char_start").isNull(), F.raise_error(said).cast("long")).otherwise(F.col("char_start"))
    return met.select(key, "slot", "role", "source_id", start.alias("char_start"), "char_end")


# --- retrieval -------------------------------------------------------------------------------------------------


def chunk_hits(retrieved: DataFrame, spans: DataFrame, case: list[str]) -> DataFrame:
    """Per case, slot, role and rank: whether the chunk hits at source and at section level.

    ``retrieved``: case columns, rank, source_id, char_start, char_end, duplicates (array of struct(source_id, char_start,
    char_end)). ``spans``: the case's key (the last of ``case``), slot, role, source_id, char_start, char_end. At section level
    the copies that a chunk stands for count like itself; at source level only itself does.
    """
    key = case[-1]
    places = retrieved.select(*case, "rank", F.explode(F.concat(F.array(F.struct(F.col("source_id"), "char_start", "char_end", F.lit(True).alias("own"))), F.transform("duplicates", lambda d: F.struct(d["source_id"].alias("source_id"), d["char_start"].alias("char_start"), d["char_end"].alias("char_end"), F.lit(False).alias("own"))))).alias("p")).select(*case, "rank", "p.*")
    expected = spans.select(key, "slot", "role", "source_id", F.col("char_start").alias("a"), F.col("char_end").alias("b"))
    return places.join(expected, [key, "source_id"]).groupBy(*case, "slot", "role", "rank").agg(
        F.max("own").alias("source"), F.max(overlaps(F.col("char_start"), F.col("char_end"), F.col("a"), F.col("b"))).alias("section"), F.max(F.col("own") & overlaps(F.col("char_start"), F.col("char_end"), F.col("a"), F.col("b"))).alias("section_bare"))


def retrieval_scores(retrieved: DataFrame, spans: DataFrame, case: list[str], ks: tuple[int, ...] = HIT_KS) -> DataFrame:
    """Hits at k, slot fractions and reciprocal ranks of each case, lenient and strict (expected spans alone).

    Every slot of a case counts, also one that has only alternates where those are left out. ``*_bare`` columns leave out
    duplicates, so comparing them tells what the duplicate rule changed.
    """
    key, k = case[-1], max(ks)
    slots = retrieved.select(*case).distinct().join(spans.select(key, "slot").distinct(), key)
    hits = chunk_hits(retrieved, spans, case)
    strict = F.col("role") == "expected"
    first = lambda level, only=None: F.min(F.when(F.col(level) if only is None else F.col(level) & only, F.col("rank")))
    names = {(lv, s): f"{lv}{'_strict' if s else ''}" for lv in ("source", "section", "section_bare") for s in (False, True)}
    per_slot = hits.groupBy(*case, "slot").agg(*[first(lv, strict if s else None).alias(n) for (lv, s), n in names.items()])
    both = slots.join(per_slot, [*case, "slot"], "left")
    at = lambda n, j: F.coalesce(F.col(n) <= j, F.lit(False))
    out = [F.min(at(n, j)).cast("int").alias(f"{n}_hit_{j}") for n in names.values() for j in ks]
    out += [F.avg(at(n, k).cast("double")).alias(f"{n}_slot_fraction") for n in ("source", "section", "section_bare")]
    out += [F.coalesce(1.0 / F.min(F.when(F.col(n) <= k, F.col(n))), F.lit(0.0)).alias(f"{n}_mrr") for n in names.values()]
    return both.groupBy(*case).agg(*out)


def evidence_scores(retrieved: DataFrame, quotes: DataFrame, spans: DataFrame, case: list[str], ks: tuple[int, ...] = HIT_KS) -> DataFrame:
    """evidence_hit_k (every required point has a quote whole in one of the first k chunks), any_hit_k, and alternate_only.

    ``quotes``: case key, point, required, quote; ``retrieved`` has the chunk's text; white space counts as single spaces in both.
    """
    from ..functions.text import collapse_whitespace

    key, k = case[-1], max(ks)
    texts = retrieved.select(*case, "rank", collapse_whitespace(F.col("text")).alias("t"))
    asked = retrieved.select(*case).distinct().join(quotes.select(key, "point", "required", collapse_whitespace(F.col("quote")).alias("q")), key)
    found = texts.join(asked, case).filter(F.contains("t", F.col("q"))).select(*case, "point", "q", "rank")
    inside = chunk_hits(retrieved, spans, case).filter("role = 'expected' and section").select(*case, "rank", F.lit(True).alias("inside")).distinct()
    placed = found.join(inside, [*case, "rank"], "left").groupBy(*case, "point").agg(F.min("rank").alias("first"), F.min(F.when(F.col("inside"), F.col("rank"))).alias("first_inside"), F.min(F.when(F.col("inside").isNull(), F.col("rank"))).alias("first_outside"))
    points = asked.groupBy(*case, "point").agg(F.max("required").alias("required")).join(placed, [*case, "point"], "left")
    at = lambda c, j: F.coalesce(F.col(c) <= j, F.lit(False))
    need = lambda test: F.min(F.when(F.col("required"), test)).cast("int")
    return points.groupBy(*case).agg(
        *[need(at("first", j)).alias(f"evidence_hit_{j}") for j in ks], *[F.max(at("first", j)).cast("int").alias(f"any_hit_{j}") for j in ks],
        need(at("first_outside", k) & ~at("first_inside", k)).alias("alternate_only"))


# --- answers ---------------------------------------------------------------------------------------------------


def judge_check(ok: Column, answerable: Column, insufficient: Column, note: Column, citations: Column) -> Column:
    """Which check a record needs: 'answer', 'refusal', or none (null)."""
    refusal = F.when(insufficient & ~note & (citations == 0), F.lit(None)).otherwise("refusal")
    return F.when(ok, F.when(answerable, F.when(~insufficient, "answer")).otherwise(refusal))


def result_label(answerable: Column, insufficient: Column, note: Column, citations: Column, coverage: Column, contradicts: Column, presents_related: Column, judged: Column) -> Column:
    """The label of an answer; null where the table needs a verdict that is not there."""
    bare = insufficient & ~note & (citations == 0)
    refused = F.when(bare, CORRECT_REFUSAL).when(judged & presents_related, HALLUCINATION).when(judged & ~presents_related, CORRECT_REFUSAL)
    ready = judged & (F.size(coverage) > 0)
    answered = F.when(~ready, None).when(contradicts, INCORRECT).when(F.forall(coverage, lambda c: c == "yes"), CORRECT).when(F.exists(coverage, lambda c: c.isin("yes", "partial")), PARTIAL).otherwise(INCORRECT)
    return F.when(~answerable, refused).when(insufficient, FALSE_REFUSAL).otherwise(answered)


def points_covered(coverage: Column) -> Column:
    """Points covered, half for partial ones, of all required points."""
    total = F.aggregate(coverage, F.lit(0.0), lambda s, c: s + F.when(c == "yes", 1.0).when(c == "partial", 0.5).otherwise(0.0))
    return F.try_divide(total, F.size(coverage))


def grounded(unsupported: Column) -> Column:
    return F.size(unsupported) == 0


def rate(count: Column, n: Column) -> Column:
    return F.try_divide(count, n)


def summarize_answers(rows: DataFrame, *by: str) -> DataFrame:
    """Label counts and rates of each group (answerable, label, check, grounded, points_covered)."""
    is_ = lambda *names: F.col("label").isin(*names)
    return rows.groupBy(*by).agg(*answer_metrics(is_))


def answer_metrics(is_) -> list[Column]:
    """The aggregates of an answer summary, for any grouping."""
    has, able = F.col("label").isNotNull(), F.col("answerable")
    judged = has & able & (F.col("check") == "answer")
    n_able, n_not, n_judged = F.count_if(has & able), F.count_if(has & ~able), F.count_if(judged)
    return [
        F.count("*").alias("records"), F.count_if(~has).alias("unlabelled"), *[F.count_if(is_(x)).alias(x) for x in LABELS],
        rate(F.count_if(able & is_(CORRECT)), n_able).alias("accuracy"), rate(F.count_if(able & is_(CORRECT, PARTIAL)), n_able).alias("lenient_accuracy"),
        rate(F.count_if(judged & F.col("grounded")), n_judged).alias("groundedness"), F.avg(F.when(judged, F.col("points_covered"))).alias("points_covered_mean"),
        rate(F.count_if(~able & is_(CORRECT_REFUSAL)), n_not).alias("correct_refusal_rate"), rate(F.count_if(~able & is_(HALLUCINATION)), n_not).alias("hallucination_rate"),
        rate(F.count_if(able & is_(FALSE_REFUSAL)), n_able).alias("false_refusal_rate"),
    ]


def citation_class(n: Column, evidence: Column, source: Column) -> Column:
    """One of the four classes, from how many citations there are and whether any hits evidence, or at least its source."""
    return F.when(n == 0, CITATION_CLASSES[3]).when(evidence, CITATION_CLASSES[0]).when(source, CITATION_CLASSES[1]).otherwise(CITATION_CLASSES[2])


def citation_scores(records: DataFrame, cited: DataFrame, case: list[str]) -> DataFrame:
    """The citation bundle of each answered record.

    ``records``: case columns, answerable, insufficient, judged (whether its answer was judged). ``cited``: a row for each
    citation with source_ok, section_ok and, where judged, supported. Records that answer "insufficient" have only
    ``related_citation_count``; those of cases without an answer in the corpus have counts alone, as there is no evidence to check.
    """
    c = F.col
    sums = cited.groupBy(*case).agg(F.count("*").alias("n"), F.max("section_ok").alias("any_section"), F.max("source_ok").alias("any_source"), F.max("supported").alias("any_supported"), *[F.avg(F.coalesce(c(x), F.lit(False)).cast("double")).alias(f"share_{x}") for x in ("section_ok", "source_ok", "supported")])
    rows = records.join(sums, case, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    answered, no = ~c("insufficient"), F.lit(False)
    checked = answered & c("answerable")
    judged = checked & F.coalesce("judged", no)
    return rows.select(
        *case, answered.alias("answered"), F.when(~answered, c("n")).alias("related_citation_count"), F.when(answered, c("n")).alias("citation_count"), F.when(answered, c("n") > 0).alias("citation_present"),
        F.when(checked, c("share_source_ok")).alias("source_precision"), F.when(checked, c("share_section_ok")).alias("section_precision"), F.when(judged, c("share_supported")).alias("support_rate"),
        F.when(checked, citation_class(c("n"), F.coalesce("any_section", no), F.coalesce("any_source", no))).alias("auto_class"), F.when(judged, citation_class(c("n"), F.coalesce("any_supported", no), F.coalesce("any_source", no))).alias("judge_class"))


def scored_rows(records: DataFrame, spans: DataFrame, retrieval: DataFrame, answers: DataFrame, citations: DataFrame, case: list[str], fallback: bool = True) -> DataFrame:
    """Records with structs ``retrieval``, ``answer`` and ``citation`` of their scores, ``spans_unavailable``, and the split.

    ``records``: case columns (the key of ``spans`` last), status, mode, answerable, split, run_split and any others. Scores are
    of records that went well; those of citations and answers of full runs. An answerable case without expected spans has its
    answer scored alone and is marked; without ``fallback`` it raises. A record's own split counts before its run's.
    """
    key, c = case[-1], F.col
    # score tables in turn as one struct each, which is null where they have no row
    nested = lambda df, name: df.select(*case, F.struct(*[x for x in df.columns if x not in case]).alias(name))
    rows = records.join(spans.select(key).distinct().withColumn("covered", F.lit(True)), key, "left")
    ok = c("status") == "ok"
    lacking = ok & c("answerable") & c("covered").isNull()
    if not fallback:
        raised = F.raise_error(F.concat(F.lit("no expected spans: "), c(key).cast("string"))).cast("boolean")
        rows = rows.filter(F.when(lacking, raised).otherwise(F.lit(True)))
    full = ok & (c("mode") == "full")
    for df, name in ((retrieval, "retrieval"), (answers, "answer"), (citations, "citation")):
        rows = rows.join(nested(df, name), case, "left")
    when = {"retrieval": ok & c("answerable") & c("covered").isNotNull(), "answer": full, "citation": full & ~lacking}
    kept = [x for x in records.columns if x not in ("split", "run_split")]
    return rows.select(*kept, F.coalesce("split", "run_split").alias("split"), *[F.when(test, c(name)).alias(name) for name, test in when.items()], lacking.alias("spans_unavailable"))


def secondary_stages(stage: Column, section_hit: Column, evidence_hit: Column) -> Column:
    """Stages that a failure shows besides its first: chunking, where the section was hit and no quote was whole in a chunk."""
    cut = (section_hit == 1) & (evidence_hit == 0) & (stage != "chunking")
    return F.when(stage.isNotNull(), F.when(F.coalesce(cut, F.lit(False)), F.array(F.lit("chunking"))).otherwise(F.array().cast("array<string>")))


def failure_stage(label: Column, section_hit: Column, evidence_hit: Column, gate_fired: Column, n_hitting: Column, cuts_code: Column, first_rank: Column, cites_above: Column) -> Column:
    """The first stage that explains a failure; null for successes and unlabelled records. Retrieval columns are null where no evidence is expected."""
    failed = label.isNotNull() & (~label.isin(CORRECT, CORRECT_REFUSAL) | F.coalesce(section_hit == 0, F.lit(False)))
    return F.when(~F.coalesce(failed, F.lit(False)), None).when(section_hit == 0, "retrieval_miss").when((label == FALSE_REFUSAL) & gate_fired, "refusal").when(
        (evidence_hit == 0) | ((n_hitting == 1) & cuts_code), "chunking").when((first_rank >= 3) & cites_above, "ranking").when(
        label.isin(FALSE_REFUSAL, HALLUCINATION), "refusal").when(label.isin(PARTIAL, INCORRECT), "generation").otherwise("citation")


def latency_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, p50, p95 and max of each group, nulls left out."""
    there = rows.filter(F.col(value).isNotNull())
    sums = there.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return with_ranks(sums, nearest_ranks(there, value, {"p50": 0.5, "p95": 0.95}, *by), *by).select(*by, "n", "mean", "p50", "p95", "max")


def cost_usd(prompt: Column, output: Column, thoughts: Column, input_price: Column, output_price: Column) -> Column:
    """List price of tokens, thoughts priced like output; null where a price is."""
    return (prompt * input_price + (output + thoughts) * output_price) / 1_000_000
