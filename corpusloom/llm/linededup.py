"""Operator 9: near-duplicate lines across all documents, of which one stays.

Every line with a word is compared, whatever its length and script, by the Jaccard similarity of the sets of
``shingle``-character shingles (lower case, white space collapsed); one shorter than a shingle is its own only shingle, so it
repeats equal lines alone. Exact repeats are counted first, so that everything after works on distinct lines. Those get
MinHash signatures, cut into bands; distinct lines that share a band meet in one bucket, where similarities are computed
exactly (``buckets``). At the least similarity two lines share no band in (1 - 0.8**3)**7 = 0.7 % of cases. Inside a bucket a
line is compared until it has met each component there, so a bucket of copies of one line costs about one comparison a line;
only a spanning forest of links leaves a task. Components of the links come from distributed union-find (``components``); the
first line of a component in the order of (id, line number) stays.

Lines travel as 64-bit hashes. Only documents that lose lines (and the few others that a Bloom filter of their id and text
lets through) are joined with what they lose, and shuffled for it; the others' texts stay where they are read.

Defined results: null texts stay null and empty ones empty; documents that lose nothing are returned as they are; of ones
that lose their last line with words, the text becomes empty (or the row goes, see ``drop_emptied``); rows of one id and one
text count as one document, and rows of one id with other texts as documents of their own; rows with null id are never
changed; empty tables give empty tables; all columns of the input are returned. Ids are integers.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from . import buckets
from .common import free, join_unique, tidy, written
from .components import connected_components


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def shingles(line: str, size: int) -> set[str]:
    """Of a normalised line; of one shorter than a shingle, the line."""
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def _windows(lines: list[str], size: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all shingles of the lines in turn, and where each line's begin (with the end of all).

    Lines are normalised and not empty; a line shorter than a shingle is one shingle.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(kind)
    lengths = np.array([len(x) for x in lines])
    hashes = codes * kind(0x9E3779B97F4A7C15 & np.iinfo(kind).max)
    total, base = hashes.copy(), kind(0x100000001B3 if kind is np.uint64 else 0x01000193)
    for k in range(1, size):  # over the next characters; where a line ends, what it would take from the next is left out
        total[:-k] = total[:-k] * base + hashes[k:]
    total ^= total >> kind(15)
    total *= kind(0xC2B2AE3D27D4EB4F & np.iinfo(kind).max)
    total ^= total >> kind(13)
    count = np.maximum(lengths - size + 1, 1)
    starts = np.cumsum(lengths) - lengths
    picked = total[np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    at = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero(lengths < size):
        picked[at[i]] = kind(xxhash.xxh64_intdigest(lines[i].encode("utf-8", "surrogatepass")) & np.iinfo(kind).max)
    return picked, at


def hashed_shingles(lines: list[str], size: int) -> list[np.ndarray]:
    """Each line's set of shingles, as a sorted array of 64-bit hashes."""
    if not lines:
        return []
    picked, at = _windows(lines, size, np.uint64)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        own = picked[s:e]
        own.sort()
        first = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=first[1:])
        out.append(own[first])
    return out


def signatures(lines: list[str], size: int, rows: int) -> np.ndarray:
    """(lines, rows) MinHash values. Lines are normalised and not empty."""
    picked, at = _windows(lines, size, np.uint32)
    return buckets.minhash(picked, at[:-1], rows)


def _hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in lines), np.uint64, len(lines))


@tidy
def _lines(batches, size: int, bands: int, band_rows: int):
    names = ["doc_id", "version", "line", "id", *(f"b{k}" for k in range(bands))]
    for batch in batches:
        owner, numbers, texts = [], [], []

        def flush():
            ids = _hashes(texts).view(np.int64)
            short = pa.array(np.fromiter(map(len, texts), np.int64, len(texts)) < size)  # equal lines alone are similar to these
            keys = [pa.compute.if_else(short, None, pa.array(k)) for k in buckets.band_keys(signatures(texts, size, bands * band_rows), bands)]
            own = pa.array(owner)
            return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(numbers, pa.int32()), pa.array(ids), *keys], names=names)

        chars = 0
        for k, text in enumerate(batch.column(2)):
            for n, line in enumerate(text.as_py().lower().split("\n")):
                if words := line.split():
                    owner.append(k)
                    numbers.append(n)
                    texts.append(" ".join(words))
                    chars += len(line)
            if chars > 1_000_000:
                yield flush()
                owner, numbers, texts, chars = [], [], [], 0
        if owner:
            yield flush()


@tidy
def _wanted_lines(batches, wanted: buckets.Filter):
    """Rows (id, text) of the lines that the filter holds, of which repeats near each other are left out."""
    seen: set[int] = set()
    for batch in batches:
        lines = [" ".join(words) for text in batch.column(0) for line in text.as_py().lower().split("\n") if (words := line.split())]
        ids = _hashes(lines)
        at = [i for i in np.flatnonzero(wanted.holds(ids)).tolist() if (x := int(ids[i])) not in seen and not seen.add(x)]
        if len(seen) > 200_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(ids[at].view(np.int64)), pa.array([lines[i] for i in at], pa.string())], names=["id", "text"])


def _maybe(wanted: buckets.Filter):
    """A column function: whether the filter may hold a 64-bit hash (never null)."""

    @F.arrow_udf(BooleanType())
    def holds(hashes: pa.Array) -> pa.Array:
        return pa.array(wanted.holds(hashes.to_numpy(zero_copy_only=False).view(np.uint64)))

    return holds


@F.arrow_udf(StringType())
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of the given numbers."""
    out = []
    for text, numbers in zip(texts, gone):
        text = text.as_py()
        if text is not None and numbers.is_valid:
            lines = text.split("\n")
            stays = np.ones(len(lines), bool)
            stays[numbers.values.to_numpy()] = False
            text = "\n".join(itertools.compress(lines, stays.tolist()))
        out.append(text)
    return pa.array(out, pa.string())


_without = _without.asNondeterministic()  # so that it runs once, also where a filter reads its result


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 8, bands: int = 7, band_rows: int = 3, tile: int = 1000, filter_bits: int = buckets.FILTER_BITS) -> DataFrame:
    """(doc_id, version, lines array<int>): the numbers (from 0) of the lines that each document loses; version is xxhash64 of its text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null and text is not null")
    keys = [f"b{k}" for k in range(bands)]
    cut = partial(_lines, size=shingle, bands=bands, band_rows=band_rows)
    lines = written(rows.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(cut, "doc_id long, version long, line int, id long, " + ", ".join(f"{k} long" for k in keys)), "lines")
    distinct = written(lines.groupBy("id").agg(F.count("*").alias("n"), *[F.min(k).alias(k) for k in keys]), "distinct")
    meets = buckets.buckets(distinct, keys, parts)
    texts = buckets.fetched(rows.select("text"), meets, _wanted_lines, filter_bits)
    found = connected_components(buckets.links(meets, texts, partial(hashed_shingles, size=shingle), least, tile, parts))
    many = distinct.filter("n > 1").select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "full").select("id", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("component", "id").alias("component"))
    total = lines.count()
    repeated = written(join_unique(lines.select("id", "doc_id", "version", "line"), written(many, "many"), "id", "n", total).select("component", "doc_id", "line", "version"), "repeated")
    first = repeated.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line", "version")).alias("first"))
    gone = join_unique(repeated, written(first, "first"), "component", "n", total).filter("struct(doc_id, line, version) <> first")
    return gone.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, count_as: str | None = None, **options) -> DataFrame:
    """``docs`` without the lines that repeat another one; with ``count_as``, also how many lines each document lost.

    ``drop_emptied`` leaves out documents of which no line with words is left: all that they said is said elsewhere.
    """
    of, version, gone, lost, rest = (free(n, docs) for n in ("of", "version", "gone", "lost", "rest"))
    marks = written(duplicate_lines(docs, id_col, text_col, **options).select(F.col("doc_id").alias(of), F.col("version").alias(version), F.col("lines").alias(gone)), "gone")
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    # both the filter's table and the mark of each row have a bounded size; what goes grows with the documents, so its join is never a broadcast
    keys = marks.select(F.xxhash64(of, version).alias("id"))
    marked = docs.withColumn(lost, _maybe(buckets.Filter(keys, options.get("filter_bits", buckets.FILTER_BITS)))(F.xxhash64(own, F.xxhash64(text))))
    both = marked.filter(lost).join(marks.hint("merge"), (own == F.col(of)) & (F.xxhash64(text) == F.col(version)), "left")
    both = both.withColumn(rest, _without(text, F.col(gone)))
    if drop_emptied:
        both = both.filter(F.col(gone).isNull() | F.rlike(F.col(rest), F.lit(r"[^\x20\x09-\x0D]")))
    changed = [F.col(rest if c == text_col else f"`{c}`").alias(c) for c in docs.columns]
    same = marked.filter(f"not `{lost}`").select(*[F.col(f"`{c}`") for c in docs.columns], *([F.lit(0).alias(count_as)] if count_as else []))
    return same.unionAll(both.select(*changed, *([F.coalesce(F.size(gone), F.lit(0)).alias(count_as)] if count_as else [])))
