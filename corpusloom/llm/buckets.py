"""Buckets of items that share a band of their MinHash signatures, and exact comparison inside them.

Shared by the operators on lines and on whole documents. An item is a 64-bit hash of its text. Buckets with the same items in
several bands are compared once. Texts of the items that share a bucket with others are read again from their source: rows go
through a bit table of the wanted hashes (a Bloom filter of at most ``FILTER_BITS`` bits, whatever the input) and then a semi
join, so a full table costs a larger shuffle and never a text. A bucket of more than ``tile`` items is split in parts, and each pair
of parts is a task's work of its own, of about 2 ``tile`` items at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Links, join_unique, tidy, written

FILTER_BITS = 1 << 27
_MULTIPLIERS = np.random.default_rng(91).integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = (0, 18, 36)  # of the three places that a 64-bit hash has in a bit table


def minhash(shingles: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
    """(items, rows) MinHash values of items whose 32-bit shingles begin at ``starts``: for each row the least hash."""
    out = np.empty((len(starts), rows), np.uint32)
    for r in range(rows):
        out[:, r] = np.minimum.reduceat(shingles * _MULTIPLIERS[r], starts)
    return out


def band_keys(marks: np.ndarray, bands: int) -> list[np.ndarray]:
    """A 64-bit key of each item for each band of its signature."""
    out = []
    for k, part in enumerate(np.split(marks.astype(np.uint64), bands, axis=1)):
        key = np.full(len(marks), k + 1, np.uint64)
        for column in part.T:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out.append((key * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sets, as sorted arrays, is ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= least * (len(both) - common)


def _shared(batches):
    """Rows (key, id) sorted by key; keeps those whose key has two rows or more."""
    last: tuple | None = None
    pending = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and last[0] == key[0]:
            keep[0] = True
            if pending:
                yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], names=["key", "id"])
        pending = not keep[-1]
        last = (key[-1], ids[-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[keep])], names=["key", "id"])


def buckets(distinct: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(key, id, size): the items that share one of their keys with others, in each bucket that is not the same as another."""
    rows = distinct.select("id", F.explode(F.array(*keys)).alias("key")).filter("key is not null").select("key", "id")
    meets = written(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared, "key long, id long"), "buckets")
    sums = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    once = meets.groupBy("key").agg(*sums).groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    return written(join_unique(meets, once, "key", "size", meets.count()), "distinct-buckets")


class Filter:
    """A bit table of ids with three places each; ``holds`` is never false for one of them."""

    def __init__(self, ids: DataFrame, most: int = FILTER_BITS):
        n, self.size = ids.count(), min(1 << 16, most)
        while self.size < min(12 * n, most):
            self.size *= 2
        places = F.array(*[F.shiftrightunsigned("id", s).bitwiseAND(F.lit(self.size - 1).cast("long")) for s in _SHIFTS])
        bits = ids.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(p & 63)))").alias("v")).toArrow()
        self.words = np.zeros(max(1, self.size >> 6), np.uint64)  # at most FILTER_BITS / 64, whatever the input
        self.words[bits["w"].to_numpy()] = bits["v"].to_numpy().view(np.uint64)

    def holds(self, ids: np.ndarray) -> np.ndarray:
        """Of unsigned 64-bit ids."""
        found = np.ones(len(ids), bool)
        for s in _SHIFTS:
            p = (ids >> np.uint64(s)) & np.uint64(self.size - 1)
            found &= ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return found


def fetched(rows: DataFrame, meets: DataFrame, read: Callable, most: int = FILTER_BITS) -> DataFrame:
    """(id, text) of each item of the buckets. ``read`` makes rows (id, text) of batches of ``rows``, given the filter."""
    wanted = written(meets.select("id").distinct(), "wanted")
    found = rows.mapInArrow(partial(read, wanted=Filter(wanted, most)), "id long, text string")
    return written(found.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")


class Bucket:
    """Items of one bucket part, in components of similar ones."""

    def __init__(self, least: float):
        self.least = least
        self.sets: list[np.ndarray] = []
        self.ids: list[int] = []
        self.group: list[list[int]] = []

    def meet(self, item: int, own: np.ndarray, stays: bool) -> list[int]:
        """Ids of one similar item of each component; merges them if the item stays."""
        found, hit = [], []
        for g, members in enumerate(self.group):
            for m in members:
                if similar(self.sets[m], own, self.least):
                    found.append(self.ids[m])
                    hit.append(g)
                    break
        if stays:
            self.sets.append(own)
            self.ids.append(item)
            merged = [len(self.ids) - 1]
            for g in reversed(hit):
                merged = self.group.pop(g) + merged
            self.group.append(merged)
        return found


@tidy
def _verify(batches, sets: Callable[[list[str]], Iterable[np.ndarray]], least: float):
    """Rows (key, low, high, probe, id, text) sorted by key, pair of parts and probe; the first part's items come before those they only meet."""
    links, now, bucket = Links(), None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            *keys, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
            for *pair, probe, item, own in zip(*keys, sets(texts)):
                if pair != now:
                    now, bucket = pair, Bucket(least)
                if probe and not bucket.ids:
                    continue
                found = bucket.meet(item, own, not probe)
                if found:
                    links.add(np.full(len(found), item, np.int64), np.array(found, np.int64))
    a, b = links.edges()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])


def links(meets: DataFrame, texts: DataFrame, sets: Callable[[list[str]], Iterable[np.ndarray]], least: float, tile: int, parts: int) -> DataFrame:
    """(src, dst): spanning forests of the links between similar items of a bucket. ``sets`` makes sorted arrays of shingles of texts."""
    count = F.ceil(F.col("size") / tile)
    met = meets.join(texts, "id").withColumn("own", F.pmod(F.xxhash64("id"), count).cast("int")).withColumn("last", (count - 1).cast("int"))
    # each part with every later one; its own items are compared in all of these, those of the last part by themselves
    paired = met.select("key", "own", "id", "text", F.explode(F.filter(F.sequence(F.lit(0), "last"), lambda p: (p != F.col("own")) | (p == F.col("last")))).alias("other"))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    dealt = paired.select("key", low, high, (F.col("own") > F.col("other")).cast("int").alias("probe"), "id", "text").repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "probe", "id")
    return dealt.mapInArrow(partial(_verify, sets=sets, least=least), "src long, dst long")
