"""Judges of answers, runs before they are made, and the checks on what runs have in common."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import cost_usd, judge_check, latency_summary


def judge_prompt(template: Column, question: Column, answer: Column, points: Column, passages: Column) -> Column:
    """The prompt of a judge: {{question}}, {{answer}}, {{points}} and {{passages}} of a template, each put in once.

    ``points`` is an array of struct(id, point), ``passages`` an array of texts, numbered from 1. What is put in is never searched again.
    """
    listed = F.array_join(F.transform(points, lambda p: F.concat(F.lit("- "), p["id"], F.lit(": "), p["point"])), "\n")
    numbered = F.array_join(F.transform(passages, lambda p, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), p)), "\n\n")
    values = F.create_map(F.lit("{{question}}"), question, F.lit("{{answer}}"), answer, F.lit("{{points}}"), listed, F.lit("{{passages}}"), numbered)
    parts = F.split(F.regexp_replace(template, r"(\{\{(?:question|answer|points|passages)\}\})", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(values, p), p)), "")


def judge_plan(records: DataFrame, judgements: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """(record_id, check, state) of all records: 'cached' with a judgement of the same answer, model and prompt, 'pending' without one, 'stale' with one of another, 'none' where no check is needed.

    records: record_id, answer_hash, ok, answerable, insufficient, note, citations; judgements: record_id, answer_hash, model, prompt_version.
    """
    check = judge_check(*map(F.col, ("ok", "answerable", "insufficient", "note", "citations")))
    same = (F.col("j_hash") == F.col("answer_hash")) & (F.col("j_model") == model) & (F.col("j_prompt") == prompt_version)
    given = judgements.select("record_id", F.col("answer_hash").alias("j_hash"), F.col("model").alias("j_model"), F.col("prompt_version").alias("j_prompt"))
    both = records.withColumn("check", check).join(given, "record_id", "left")
    states = both.groupBy("record_id", "check").agg(F.coalesce(F.max(same), F.lit(False)).alias("cached"), F.count("j_hash").alias("n"))
    state = F.when(F.col("check").isNull(), "none").when(F.col("cached"), "cached").when(F.col("n") > 0, "stale").otherwise("pending")
    return states.select("record_id", "check", state.alias("state"))


def require_judged(plan: DataFrame) -> None:
    """Raises where a record needs a judgement that is not there or is of another answer, model or prompt."""
    bad = plan.filter("state in ('pending', 'stale')").select("record_id", "state").limit(5).collect()
    if bad:
        raise ValueError(f"judgements that are missing or of something else: {sorted((r.record_id, r.state) for r in bad)}")


def judge_latency(lines: DataFrame, *by: str) -> DataFrame:
    """Summaries of a judge's generate and total times; lines from before retries were counted are left out."""
    flat = lines.filter("retry_count is not null").select(*by, F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_ms").alias("ms")) for s in ("generate", "total")])))
    return latency_summary(flat, "ms", *by, "stage")


def estimate_run(cases: DataFrame, output_tokens: int, prompt_overhead: int, input_price: float | None, output_price: float | None, requests_per_minute: int, *by: str) -> DataFrame:
    """Calls, tokens, list price (per million tokens; null where a price is) and least minutes of a run before it is made, by group.

    cases: question, passages_chars.
    """
    tokens = F.ceil((F.length("question") + F.col("passages_chars")) / 4.0).cast("long") + prompt_overhead
    sums = cases.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(tokens).alias("prompt_tokens")).withColumn("output_tokens", F.col("calls") * output_tokens)
    cost = cost_usd(F.col("prompt_tokens"), F.col("output_tokens"), F.lit(0), F.lit(input_price).cast("double"), F.lit(output_price).cast("double"))
    return sums.select(*by, "calls", "prompt_tokens", "output_tokens", cost.alias("cost_usd"), F.ceil(F.col("calls") / requests_per_minute).cast("long").alias("minutes"))


def coverage_of_targets(targets: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(target_id, source_id, heading_path, n_chunks): how many chunks overlap each planned section; null where there is no such section."""
    from .evaluation import overlaps

    found = targets.join(sections.select("source_id", "heading_path", F.col("char_start").alias("s0"), F.col("char_end").alias("s1")), ["source_id", "heading_path"], "left")
    near = found.join(chunks.select("source_id", "char_start", "char_end"), "source_id", "left")
    hit = F.col("s0").isNotNull() & F.col("char_start").isNotNull() & overlaps(F.col("s0"), F.col("s1"), F.col("char_start"), F.col("char_end"))
    return near.groupBy("target_id", "source_id", "heading_path").agg(F.when(F.max("s0").isNotNull(), F.count_if(hit)).alias("n_chunks"))


def uncovered(coverage: DataFrame) -> DataFrame:
    """Targets that fail the gate: no such section, or no chunk of it."""
    return coverage.filter("coalesce(n_chunks, 0) = 0")


def disagreeing(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column, n_values) where rows that should agree (prompt versions, models of a run) have more than one value; nulls count as one."""
    counts = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))).alias(c) for c in columns]
    flat = rows.groupBy(*by).agg(*counts).select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in columns])))
    return flat.filter("n_values > 1")


def gate_disagreements(records: DataFrame) -> DataFrame:
    """Records whose reason does not fit: a gate that fired and a model that was called all the same, or neither of them."""
    return records.filter(F.col("gate_fired") == F.col("llm_called"))


def to_metadata(row: Column, lists: tuple[str, ...], names: tuple[str, ...]) -> Column:
    """A flat map of strings for a store that knows no nulls and no lists: nulls are left out, lists become JSON."""
    value = lambda n: F.to_json(row[n]) if n in lists else row[n].cast("string")
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(value, names))), lambda k, v: v.isNotNull())


def from_metadata(metadata: Column, shape: dict[str, str]) -> Column:
    """The struct that ``to_metadata`` was made of; ``shape`` has the type of each field."""
    read = lambda n, t: F.from_json(metadata[n], t) if t.startswith("array") else metadata[n].cast(t)
    return F.struct(*[read(n, t).alias(n) for n, t in shape.items()])


def projected(records: DataFrame, shape: dict[str, str]) -> DataFrame:
    """Records with exactly the columns of a shape, in order and type; a column that it does not know raises, one that is missing is null."""
    unknown = sorted(set(records.columns) - set(shape))
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    return records.select(*[(F.col(n) if n in records.columns else F.lit(None)).cast(t).alias(n) for n, t in shape.items()])


def pack_floats(vector: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(vector)}f", *vector)


def unpack_floats(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 4}f", data))


def embed_missing(misses: DataFrame, model: str, task: str, embed: Callable[[list[str], str], list[list[float]]], batch: int = 64, text_col: str = "text") -> DataFrame:
    """Rows for the embedding cache (key, vector) of texts that it lacks, a call for each ``batch`` texts at most."""
    import pyarrow as pa

    from ..functions.text import cache_key

    def run(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = embed(part.column(1).to_pylist(), task)
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["key", "vector"])

    keyed = misses.select(cache_key(F.lit(model), F.lit(task), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, "key string, vector array<float>")


def hash_embedder(dim: int = 16) -> Callable[[list[str], str], list[list[float]]]:
    """A deterministic embedder without a model, for tests and dry runs; texts and tasks that differ get other vectors of length 1."""
    from hashlib import blake2b

    def embed(texts: list[str], task: str) -> list[list[float]]:
        out = []
        for text in texts:
            raw = b"".join(blake2b(f"{task}|{k}|{text}".encode("utf-8", "surrogatepass"), digest_size=64).digest() for k in range(-(-dim // 16)))
            values = [int.from_bytes(raw[4 * k : 4 * k + 4], "little") / 2**31 - 1 for k in range(dim)]
            size = sum(v * v for v in values) ** 0.5 or 1.0
            out.append([v / size for v in values])
        return out

    return embed


def blind_sheet(rows: DataFrame, seed: int) -> DataFrame:
    """(item, question, answer, key): a rater's sheet in an order fixed by the seed, without arm or case; the key says which is which.

    A sheet is what a person rates by hand, a sample of some dozens (``statistics.stratified_sample``), so it is numbered in one task.
    """
    from pyspark.sql import Window as W

    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("case_id").cast("string"), "arm"), 256)
    return rows.select(F.row_number().over(W.orderBy(order)).alias("item"), "question", "answer", F.struct("case_id", "arm").alias("key"))


def mismatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, only_left, only_right): keys of a sheet and of its key that the other side doesn't have."""
    both = left.select(key, F.lit(True).alias("in_left")).join(right.select(key, F.lit(True).alias("in_right")), key, "full_outer")
    return both.filter("in_left is null or in_right is null").select(key, F.col("in_right").isNull().alias("only_left"), F.col("in_left").isNull().alias("only_right"))


def read_sheet(text: str) -> dict[int, dict]:
    """Verdicts of a filled sheet: a JSON line {item, label, ...} each; an item twice or without a label raises."""
    found: dict[int, dict] = {}
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip():
            row = json.loads(line)
            if row.get("item") in found or not row.get("label"):
                raise ValueError(f"line {n}: an item once, with its label, is expected")
            found[row["item"]] = row
    return found
