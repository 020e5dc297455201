"""Tables that grow: the embedding cache, vector collections, and append-only records with their latest view."""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions.text import cache_key, redact


def latest(records: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last record of each key. A record is carried through the aggregate, so no window gathers a key's rows."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, "r.*")


def pending(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet."""
    return wanted.join(present.select(key), key, "left_anti")


def split_by_cache(texts: DataFrame, cache: DataFrame, model: str, task: str, text_col: str = "text", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, misses): misses once each, where they first occur."""
    keyed = texts.withColumn("key", cache_key(F.lit(model), F.lit(task), F.col(text_col)))
    hits = keyed.join(cache.select("key", "vector"), "key")
    misses = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by(text_col, order).alias(text_col), F.min(order).alias(order))
    return hits, misses


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str = "chunk_id", config_col: str = "chunker_config", config: str | None = None, buckets: int = 64, describe: dict | None = None, attempts: int = 20) -> None:
    """Replace and add rows by key; rows of another configuration raise.

    A collection is cut into ``buckets`` by a hash of the key, fixed when it is created, as is what ``describe`` says of it
    (model, space, ...), with which later writes have to agree. A version holds the buckets that its rows touch, whole. It takes
    effect with a commit: a manifest of all buckets under the next number, of which only one writer can create each. A writer
    that comes second takes over the other's buckets, and merges anew where both touched the same. ``rows`` are read twice: for
    the buckets that they touch, and to be written. No rows write nothing.
    """
    if config is not None:
        rows = rows.withColumn(config_col, F.when(F.col(config_col) == config, F.col(config_col)).otherwise(F.raise_error(F.concat(F.lit("rows of another configuration: "), F.col(config_col)))))
    base = _committed(spark, path)
    if base:
        buckets = base["buckets"]
        _agrees(base, describe or {}, path)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
    if not touched:
        return
    for _ in range(attempts):
        new = _merged(spark, path, rows, key, touched, base, buckets)
        while True:
            manifest = {"commit": base["commit"] + 1 if base else 1, "buckets": buckets, "describe": base["describe"] if base else describe or {}, "schema": new["schema"], "files": (base["files"] if base else {}) | new["files"]}
            if _created(spark, f"{path}/_commits/{manifest['commit']:08d}.json", json.dumps(manifest)):
                return
            seen, base = base, _committed(spark, path)
            if base["buckets"] != buckets:
                raise ValueError(f"{path} was created meanwhile with {base['buckets']} buckets")
            _agrees(base, describe or {}, path)
            if any(base["files"].get(str(b)) != (seen or {"files": {}})["files"].get(str(b)) for b in touched):
                break  # another writer was at the same buckets
    raise ValueError(f"{path} changed under {attempts} attempts to write to it")


def _merged(spark: SparkSession, path: str, rows: DataFrame, key: str, touched: list[int], base: dict | None, buckets: int) -> dict:
    """Write a version of the touched buckets: the base's rows of other keys, and the new rows."""
    version = max(_numbers(spark, path, "v"), default=0) + 1
    while not _created(spark, f"{path}/_claims/v{version:08d}", ""):
        version += 1
    if present := [f"{path}/{base['files'][str(b)]}" for b in touched if str(b) in base["files"]] if base else []:
        old = spark.read.schema(ST.StructType.fromJson(base["schema"])).parquet(*present).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        new = rows.select(F.col(key).alias("__new"))
        rows = old.join(new, F.col(key).eqNullSafe(F.col("__new")), "left_anti").unionByName(rows)
    rows.withColumn("__buckets", F.lit(buckets)).write.partitionBy("__buckets", "__bucket").parquet(f"{path}/v{version:08d}")
    top = f"v{version:08d}/__buckets={buckets}"
    files = {n.split("=")[1]: f"{top}/{n}" for n in _folders(spark, f"{path}/{top}", "__bucket=")}
    return {"schema": json.loads(rows.drop("__bucket").schema.json()), "files": files}


def collection(spark: SparkSession, path: str, **expected) -> DataFrame | None:
    """The newest committed state of every bucket of a collection; None where there are no rows.

    ``expected``: what it was described by when it was created (or ``buckets``); anything else raises.
    """
    manifest = _committed(spark, path)
    if not manifest:
        return None
    _agrees(manifest, expected, path)
    return spark.read.schema(ST.StructType.fromJson(manifest["schema"])).parquet(*[f"{path}/{f}" for f in manifest["files"].values()])


def described(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest: commit, buckets, describe, schema and files."""
    return _committed(spark, path)


def _agrees(manifest: dict, expected: dict, path: str) -> None:
    has = manifest["describe"] | {"buckets": manifest["buckets"]}
    if other := {k: (has.get(k), v) for k, v in expected.items() if has.get(k) != v}:
        raise ValueError(f"{path} has other metadata (has, wanted): {other}")


def _committed(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the last commit."""
    commits = _folders(spark, f"{path}/_commits", "")
    names = [n for n in commits if n.endswith(".json") and not n.startswith(".")]
    if names:
        return json.loads(_read(spark, f"{path}/_commits/{names[-1]}"))
    if whole := [n for n in _numbers(spark, path, "v") if _folders(spark, f"{path}/v{n:08d}", "_SUCCESS") and not _folders(spark, f"{path}/v{n:08d}", "__buckets=")]:
        raise ValueError(f"{path}/v{whole[0]:08d} is not cut into buckets; write its rows to a new collection")
    return None


def vacuum(spark: SparkSession, path: str, keep: int = 1, older: float = 3600.0) -> list[int]:
    """Remove versions that none of the last ``keep`` commits needs and that were written ``older`` seconds ago or before; their numbers.

    Unfinished writes stay, as their writer may be at work.
    """
    commits = [n for n in _folders(spark, f"{path}/_commits", "") if n.endswith(".json") and not n.startswith(".")]
    needed = {f.split("/")[0] for n in commits[-keep:] for f in json.loads(_read(spark, f"{path}/_commits/{n}"))["files"].values()}
    fs, root = _hadoop(spark, path)
    gone = []
    for n in _numbers(spark, path, "v") if commits else []:
        folder = f"{path}/v{n:08d}"
        if f"v{n:08d}" not in needed and _folders(spark, folder, "_SUCCESS"):
            done = fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")).getModificationTime() / 1000
            if time.time() - done >= older:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
                gone.append(n)
    return gone


def _hadoop(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names in a folder that begin so, through Hadoop's file systems; none where there is no folder."""
    fs, root = _hadoop(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n for n in names if n.startswith(prefix))


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return [int(n[len(prefix) :]) for n in _folders(spark, path, prefix) if n[len(prefix) :].isdigit()]


def _read(spark: SparkSession, path: str) -> str:
    fs, file = _hadoop(spark, path)
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file whole; False where it is there already. Of several writers one succeeds."""
    fs, file = _hadoop(spark, path)
    fs.mkdirs(file.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then; a link is made or not
        target = file.toUri().getPath()
        temporary = f"{os.path.dirname(target)}/.{os.path.basename(target)}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temporary, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(temporary)
    try:
        stream = fs.create(file, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass()) or fs.exists(file):
            return False
        raise
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    return True


class RecordLog:
    """An append-only file of JSON lines on the driver, for control-plane records.

    A line counts once it ends; what a crash left unended is cut off by the next append and left out by reads, while a broken
    whole line raises. Lines pass ``redact`` before they are written.
    """

    def __init__(self, path: str, redact=lambda line: line):
        self.path, self.redact = path, redact

    def append(self, record: dict) -> None:
        line = self.redact(json.dumps(record, ensure_ascii=False, allow_nan=False)) + "\n"
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path, "ab+") as f:
            f.truncate(self._ended(f))
            f.write(line.encode())
            f.flush()
            os.fsync(f.fileno())

    @staticmethod
    def _ended(f, block: int = 1 << 16) -> int:
        """Where the last whole line ends, read from the end of the file back."""
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            start = max(0, at - block)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
        return 0

    def read(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, "rb") as f:
            lines = f.read().split(b"\n")[:-1]
        out = []
        for n, line in enumerate(lines, 1):
            try:
                out.append(json.loads(line))
            except ValueError as e:
                raise ValueError(f"{self.path} line {n}: {e}") from e
        return out

    def frame(self, spark: SparkSession, schema: str) -> DataFrame:
        """The records with their append order as ``seq``."""
        rows = [json.dumps(r | {"seq": n}, ensure_ascii=False) for n, r in enumerate(self.read())]
        shape = ST.StructType.fromDDL(f"{schema}, seq bigint")
        lines = spark.createDataFrame([(x,) for x in rows], "line string")
        return lines.select(F.from_json("line", shape, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_manifest(path: str, manifest: dict) -> None:
    """Atomically: a reader sees the old manifest or the new one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(json.dumps(manifest, ensure_ascii=False, indent=2, allow_nan=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".tmp", path)


def redacted_json(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as redacted JSON lines."""
    return df.select(redact(F.to_json(F.struct(*df.columns)), key).alias("value"))
