"""Operator 10: token ids as patched frame-of-reference blocks in binary files, and back.

A block holds ``BLOCK`` ids: the minimum is subtracted, the rest is packed at the width that covers a percentile of the
block's values, and values that do not fit keep their low bits in place while their high bits go to an exception list.
A file is self-contained::

    magic "CLPF" | version u32 | documents u64 | ids u64 | blocks u64 | block size u64
    | null flags u8[documents] | document ids i64[documents] | tokens of each u64[documents]
    | block starts u64[blocks] (bytes from the start of the blocks) | blocks

    block: minimum u32 | values u16 | exceptions u16 | width u8, high width u8, 2 bytes of zeros | exception places u16[]
    | packed high bits | packed low bits

Documents are dealt by ranges of the id, whose bounds come from quantiles of the id column alone, sorted inside each range by
(id, text hash) and written in files of bounded size named by range; so file names in order hold the documents in ascending
id order (null ids first, repeated ids by hash). Rows without id, or of an id that very many rows have, are ranges by the hash
of their text. Files are written under
another name and renamed; a task that runs again writes the same bytes. Reading goes through Spark's binary file source,
which splits the work by file, and needs only per-file totals to place every document.

Defined results: ids are integers (others are cast to one, and raise or are null as Spark's cast does); null text counts as
empty and has the end id alone; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filesystem, id_text, shared_dir, tidy
from .tokens import Encoder, vocabulary

BLOCK, MAGIC, VERSION = 4096, b"CLPF", 1
_SPLIT_BITS = 6  # of text hashes, by which rows of one id are dealt where they are many
FILES = "name string, part long, serial long, docs long, tokens long, bytes long"
_HEAD = struct.Struct("<4sIQQQQ")
_BLOCK = struct.Struct("<IHHBBxx")


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width)
    return np.packbits(bits, bitorder="little").tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return np.pad(np.packbits(bits, axis=1, bitorder="little"), ((0, 0), (0, 4 - (width + 7) // 8))).view("<u4")[:, 0].astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    kth = int(np.partition(rest, k := min(len(rest) - 1, int(percentile * len(rest))))[k])
    width, most = kth.bit_length(), int(rest.max()).bit_length()
    if most - width < 2:  # exceptions cost more than a bit for each value
        width = most
    places = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    high = max(0, most - width) if len(places) else 0
    packed = _pack(rest & np.uint32((1 << width) - 1), width)
    return _BLOCK.pack(low, len(ids), len(places), width, high) + places.astype("<u2").tobytes() + _pack(rest[places] >> np.uint32(width % 32), high) + packed


def decode_block(data: bytes, at: int = 0) -> np.ndarray:
    low, n, exceptions, width, high = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    places = np.frombuffer(data, "<u2", exceptions, at)
    at += 2 * exceptions
    tops = _unpack(data[at : (at := at + (exceptions * high + 7) // 8)], exceptions, high)
    values = _unpack(data[at : at + (n * width + 7) // 8], n, width)
    if exceptions:
        values[places] |= tops << np.uint32(width)
    return values + np.uint32(low)


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 0.9, block: int = BLOCK) -> bytes:
    """The bytes of one file: ids of all documents in turn, cut into blocks regardless of documents."""
    blocks = [encode_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)][: len(blocks)], dtype="<u8") if blocks else np.empty(0, "<u8")
    flags = np.array([d is None for d in doc_ids], np.uint8)
    head = _HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), len(blocks), block)
    return b"".join([head, flags.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), starts.tobytes(), *blocks])


class Reader:
    """One file; ``ids(start, stop)`` decodes only the blocks that hold the range."""

    def __init__(self, data: bytes):
        self.data = data
        magic, version, n, self.total, blocks, self.block = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block file of this version")
        at = _HEAD.size
        null = np.frombuffer(data, np.uint8, n, at)
        at += n
        self.doc_ids = [None if x else int(d) for x, d in zip(null, np.frombuffer(data, "<i8", n, at))]
        self.lengths = np.frombuffer(data, "<u8", n, at := at + 8 * n).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", blocks, at := at + 8 * n)
        self.base = at + 8 * blocks

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, np.uint32)
        first = start // self.block
        parts = [decode_block(self.data, self.base + int(s)) for s in self.starts[first : (stop - 1) // self.block + 1]]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


@tidy
def _write(batches, folder: str, path: str, end_id: int, percentile: float, file_ids: int):
    from pyspark import TaskContext

    encoder, end, attempt = Encoder.of(path, __name__), np.uint32(end_id).astype("<u4").tobytes(), TaskContext.get().taskAttemptId()
    system, root = filesystem(folder)
    ids: list[int | None] = []
    lengths: list[int] = []
    held: list[bytes] = []
    size = serial = 0
    now = None

    def flush():
        nonlocal ids, lengths, held, size, serial
        name = f"part-{now:010d}-{serial:07d}.pfor"
        payload = encode_file(ids, lengths, np.frombuffer(b"".join(held), "<u4"), percentile)
        with system.open_output_stream(f"{root}/_{name}.{attempt}") as f:
            f.write(payload)
        system.move(f"{root}/_{name}.{attempt}", f"{root}/{name}")
        row = (name, now, serial, len(ids), size, len(payload))
        ids, lengths, held, size, serial = [], [], [], 0, serial + 1
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["name", "part", "serial", "docs", "tokens", "bytes"])

    for batch in batches:
        for part, doc_id, text in zip(*batch.columns):
            if (part := part.as_py()) != now:
                if ids:
                    yield flush()
                now, serial = part, 0
            data = encoder.encode(text.as_py()) + end
            ids.append(doc_id.as_py())
            lengths.append(len(data) // 4)
            held.append(data)
            size += len(data) // 4
            if size >= file_ids:
                yield flush()
    if ids:
        yield flush()


def _ranges(rows: DataFrame, n: int):
    """A column with the number of the row's range in the order of (id, text hash); built-in functions alone.

    There are about ``n`` ranges of ids of as many rows each. Rows without id, and those of an id that is a quantile more than
    once (so at least an ``n``-th of all rows have it), are dealt further by the upper bits of their text's hash.
    """
    found = rows.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("q")).first()["q"] if n > 1 else None
    bounds, hash_ = sorted(set(found or [])), F.xxhash64("text")
    hot = [b for b in bounds if found.count(b) > 1]  # a bound is the last id of its range
    if bounds:
        width = int(len(bounds) ** 0.5) + 1  # bounds in groups: the last group that begins below the id, then its bounds below the id
        groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
        row = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
        group = F.size(F.filter(row([g[0] for g in groups]), lambda b: b < F.col("doc_id")))
        inside = F.size(F.filter(F.get(F.array(*map(row, groups)), group - 1), lambda b: b < F.col("doc_id")))
        of = F.when(F.col("doc_id").isNull(), 0).when(group == 0, 1).otherwise((group - 1) * width + inside + 1)
    else:
        of = F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    dealt = F.shiftright(hash_, 64 - _SPLIT_BITS) + (1 << _SPLIT_BITS - 1) + 1
    split = F.col("doc_id").isNull() | (F.col("doc_id").isin(hot) if hot else F.lit(False))
    return of.cast("long") * ((1 << _SPLIT_BITS) + 1) + F.when(split, dealt).otherwise(0)


def write_token_files(docs: DataFrame, folder: str, vocabulary_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", percentile: float = 0.9, file_ids: int = 4_000_000) -> None:
    """Write all documents' ids to ``folder`` in ascending id order, and the list of files (``_files``: name, part, serial, docs, tokens, bytes), each row by the task that wrote the file."""
    spark = docs.sparkSession
    system, root = filesystem(folder)
    system.create_dir(root)
    rows = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = rows.select(_ranges(rows, 3 * n).alias("part"), "doc_id", "text")
    dealt = parted.repartition(n, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    work = partial(_write, folder=folder, path=vocabulary_path, end_id=end_id, percentile=percentile, file_ids=file_ids)
    dealt.mapInArrow(work, FILES).write.mode("overwrite").parquet(f"{folder}/_files")


def _read(batches):
    for batch in batches:
        for name, data in zip(batch.column(0), batch.column(1)):
            reader = Reader(data.as_py())
            ends = np.cumsum(reader.lengths)
            step = 1 << 20
            crcs, starts = [], ends - reader.lengths
            held, held_at = np.empty(0, np.uint32), 0
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e > held_at + len(held):
                    held, held_at = reader.ids(s, max(e, min(s + step, reader.total))), s
                crcs.append(zlib.crc32(held[s - held_at : e - held_at].astype("<u4").tobytes()))
            k = len(reader.doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name.as_py().rpartition("/")[2]] * k, pa.string()), pa.array(reader.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(reader.lengths, pa.int64()), pa.array(crcs, pa.int64())],
                names=["name", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``folder``, decoded from their blocks.

    start counts the ids of all documents before it over all files in name order. Only rows of files are summed for that: those
    of a range by themselves, and one row for each range, of which there are as many as shuffle partitions allow.
    """
    shape = "name string, doc_id long, start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.pfor").load(folder).select("path", "content")
    docs = files.mapInArrow(_read, shape)
    totals = spark.read.schema(FILES).parquet(f"{folder}/_files")
    ranges = totals.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    ranges = ranges.select("part", (F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).alias("above"))
    inside = totals.select("name", "part", (F.sum("tokens").over(W.partitionBy("part").orderBy("serial")) - F.col("tokens")).alias("within"))
    before = inside.join(ranges, "part").select("name", (F.col("above") + F.col("within")).alias("before"))
    return docs.join(before, "name").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 2, folder: str | None = None, **options) -> str:
    """Write the files and their list (``_files``, a row per file) into a folder, by default a new one of the shared folder; returns it."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens"
    write_token_files(docs, folder, vocabulary_path or vocabulary("word_bpe_49k.json"), end_id, **options)
    return folder
