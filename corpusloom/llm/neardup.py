"""The pipeline's near-duplicate documents: five-word shingles, Jaccard similarity of 0.8 or more, of which one stays.

Exact repeats are counted first. Distinct texts get MinHash signatures, cut into bands; texts that share a band meet in a
bucket, where the similarity of their whole sets of shingles is computed (``buckets``), so no link is wrong. At the least
similarity a pair shares no band in (1 - 0.8**3)**14 = 4e-5 of cases, at 0.85 in 1e-6.

The stage links what operator 1 links (``simhash``, here on five-word shingles too, at its radius of 2) and what is similar by
this module, and keeps one document of each component of both. Fingerprints alone can't do it: texts of similarity 0.8 differ
in about 10 of 64 bits, and at a radius that finds nearly all of them (16) no tile pair is skipped any more.

Words are those of ``simhash``: lower-case A-Z, cut at ASCII white space, so line breaks make no difference; a text of fewer
words than a shingle is one shingle. Texts without words are repeats of each other; null text counts as empty; rows with null
id stay; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets, simhash
from .common import free, id_text, join_unique, tidy, written
from .components import connected_components

_ODD = (np.random.default_rng(17).integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int, memo: _Hashes) -> np.ndarray:
    """The set of a text's shingles, as a sorted array of 64-bit hashes."""
    if len(memo) > 400_000:
        memo.clear()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total += codes[k : k + len(total)] * _ODD[k]
    total ^= total >> np.uint64(29)
    return np.unique(total * np.uint64(0xBF58476D1CE4E5B9))


def _text_id(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 7)


@tidy
def _marks(batches, size: int, bands: int, band_rows: int):
    memo = _Hashes()
    for batch in batches:
        docs, ids, sets, held = [], [], [], 0

        def flush():
            marks = buckets.minhash(np.concatenate(sets).astype(np.uint32), np.cumsum([0, *map(len, sets[:-1])]), bands * band_rows)
            columns = [pa.array(docs, pa.int64()), pa.array(np.array(ids, np.uint64).view(np.int64)), *map(pa.array, buckets.band_keys(marks, bands))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "id", *(f"b{k}" for k in range(bands))])

        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            docs.append(doc_id)
            ids.append(_text_id(words))
            sets.append(shingles(words, size, memo))
            held += len(sets[-1])
            if held > 200_000:
                yield flush()
                docs, ids, sets, held = [], [], [], 0
        if docs:
            yield flush()


@tidy
def _wanted_texts(batches, wanted: buckets.Filter):
    for batch in batches:
        ids = np.fromiter((_text_id(words_of(t.as_py())) for t in batch.column(0)), np.uint64, batch.num_rows)
        keep = wanted.holds(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep].view(np.int64)), batch.column(0).filter(pa.array(keep))], names=["id", "text"])


def _sets(texts: list[str], size: int):
    memo = _Hashes()
    return (shingles(words_of(t), size, memo) for t in texts)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5, bands: int = 14, band_rows: int = 3, tile: int = 1000, filter_bits: int = buckets.FILTER_BITS) -> DataFrame:
    """(doc_id, component_id) of the documents that repeat another or are similar to one; component_id is their smallest id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = id_text(docs, id_col, text_col).filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    keys = [f"b{k}" for k in range(bands)]
    cut = partial(_marks, size=shingle, bands=bands, band_rows=band_rows)
    marked = written(rows.mapInArrow(cut, "doc_id long, id long, " + ", ".join(f"{k} long" for k in keys)), "marks")
    distinct = written(marked.groupBy("id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *[F.min(k).alias(k) for k in keys]), "distinct")
    meets = buckets.buckets(distinct, keys, parts)
    texts = buckets.fetched(rows.select("text"), meets, _wanted_texts, filter_bits)
    found = connected_components(buckets.links(meets, texts, partial(_sets, size=shingle), least, tile, parts))
    joined = distinct.select("id", "rep", "n").join(found.withColumnRenamed("node", "id"), "id", "left").filter("n > 1 or component is not null")
    many = written(joined.select("id", "rep", "n", F.coalesce("component", "id").alias("component")), "many")
    low = many.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size"))
    classes = join_unique(many, low, "component", "size", many.count()).select("id", "n", "component_id")
    return join_unique(marked.select("doc_id", "id"), written(classes, "classes"), "id", "n", marked.count()).select("doc_id", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 2, **options) -> DataFrame:
    """The rows of ``docs`` of which one stays for each class of similar texts or close fingerprints: that of the smallest id (rows without id stay)."""
    prints = simhash.near_duplicates(docs, id_col, text_col, shingle, radius).filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("component_id").cast("long"))
    links = prints.union(similar_documents(docs, id_col, text_col, shingle=shingle, **options)).filter("doc_id <> component_id")
    gone = connected_components(links.select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst"))).filter("node <> component").select(F.col("node").alias(node := free("gone", docs))).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(node), "left_anti")
