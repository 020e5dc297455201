"""Shared helpers of the operators: the shared folder, written tables, and local spanning forests."""

from __future__ import annotations

import ctypes
import functools
import itertools
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SERIAL = itertools.count()
_LIBC = ctypes.CDLL(None)
#: Words everywhere in these operators: runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder inside ``spark.checkpoint.dir``; that setting is only made here for a local session that has none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corpusloom-{os.getpid()}-{next(_SERIAL)}-{uuid.uuid4().hex[:8]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks; what others kept there goes, as workers are used again."""
    for other in [k for k in _KEPT if k != owner]:
        del _KEPT[other]
    return _KEPT.setdefault(owner, {})


def tidy(work):
    """A function of ``mapInArrow`` after which the worker gives its unused memory back, as it will wait or do other work."""

    @functools.wraps(work)
    def run(batches, **options):
        kept(work.__module__)
        try:
            yield from work(batches, **options)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(_LIBC, "malloc_trim"):
                _LIBC.malloc_trim(0)

    return run


def filesystem(folder: str):
    """(file system, path) of a folder of the shared storage, for tasks that read or write files of their own there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under internal names, null text as empty; other columns can't clash with internal ones."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def free(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have (names differ by more than letter case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def join_unique(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, share: int = 256) -> DataFrame:
    """Inner join with the one row that ``table`` has for each key, also where a few keys hold most of ``rows``.

    ``size`` is the table's column with how many of the ``total`` rows (of which ``rows`` may be a part) have the key. Fewer
    than ``share`` keys can have more than a ``share``-th of them, so those are broadcast; the others' rows are shuffled.
    """
    limit = total // share
    hot = F.broadcast(table.filter(F.col(size) > limit))
    rest = rows.join(F.broadcast(table.filter(F.col(size) > limit).select(key)), key, "left_anti").join(table.filter(F.col(size) <= limit), key)
    return rows.join(hot, key).unionByName(rest)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph with edges a[i]-b[i]; roots themselves are left out."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        u, v = u[open_], v[open_]
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


class Links:
    """Collects links and keeps no more than a spanning forest of them, so memory follows nodes and not pairs."""

    def __init__(self, most: int = 1 << 20):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, most

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((np.asarray(a, np.int64), np.asarray(b, np.int64)))
            self.held += len(a)
            if self.held > self.most:
                self.shrink()

    def shrink(self) -> None:
        if self.parts:
            self.parts = [forest(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]
            self.held = len(self.parts[0][0])
            self.most = max(self.most, 2 * self.held)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self.shrink()
        return self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64))
