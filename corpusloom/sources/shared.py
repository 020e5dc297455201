"""The folder that the driver and all executors share, for intermediate tables and files that tasks write and read."""

from __future__ import annotations

import ctypes
import itertools
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SERIAL = itertools.count()
_LIBC = ctypes.CDLL(None)


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside ``spark.checkpoint.dir``, which only a local session may leave unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/library-{os.getpid()}-{next(_SERIAL)}-{uuid.uuid4().hex[:8]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is made once, and lost executors don't make it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 200, size: int = 2_000_000):
    """Arrow batches in parts of at most ``rows`` rows and of about ``size`` bytes, so that what Python makes of them stays small; a row is never cut."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def released(batches):
    """The batches; then the worker gives its unused memory back, as it waits for other work and is never ended."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)


def opened(folder: str):
    """(file system, path) of a folder, as tasks see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)
