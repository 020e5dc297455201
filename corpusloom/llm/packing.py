"""Operator 3: best-fit packing of documents into fixed-length token sequences, in a tree of rounds.

Documents become pieces: one piece, or pieces of ``capacity`` ids of which the first may be shorter. Each partition packs its
pieces best-fit (longest first, into the fullest sequence with room) as soon as it has tokenized them. Sequences with almost
no room left are final. Those with room go on as items to the next round, in fewer partitions, where whole sequences are
packed best-fit again, and so on up the tree. A partition of a later round takes ``most_items`` items at most, which bounds
its memory; where more are left than one partition takes, they are dealt anew, so that others meet, until a round at whose end
there is one partition or nothing (less than a thousandth) was won.

A sequence is a row that carries its members, so a round shuffles a few dozen bytes a piece and never a text or its ids.
Rounds are written tables; a lost executor costs a part of one round.

Defined results: null text counts as empty and has the end id alone; repeated rows are packed once each; null ids are kept;
an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, tidy, written
from .tokens import Encoder, vocabulary

MEMBER = "struct<doc_id: {0}, piece: int, start: bigint, length: bigint, ids_crc32: bigint>"


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, longest item first, each into the fullest bin that has room for it (ties: any)."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), np.int64)
    with_room = n = 0  # bit r: some bin has r left
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        if fits := with_room >> size:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                with_room ^= 1 << left
        else:
            b, left, n = n, capacity, n + 1
        bins[i] = b
        if left := left - size:
            room[left].append(b)
            with_room |= 1 << left
    return bins


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _bins(lengths: np.ndarray, members: pa.Array, offsets: np.ndarray, capacity: int, slack: int, first_id: int) -> pa.RecordBatch:
    """Pack items, of which item i has the members offsets[i] to offsets[i + 1]; a row for each bin."""
    bins = best_fit(lengths, capacity)
    order = np.argsort(bins, kind="stable")
    n = int(bins.max()) + 1 if len(bins) else 0
    used = np.bincount(bins, lengths, n).astype(np.int64)
    counts = np.diff(offsets)
    ends = np.cumsum(np.bincount(bins, counts, n).astype(np.int64))
    sizes = counts[order]
    take = np.repeat(offsets[:-1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), members.take(pa.array(take)))
    return pa.RecordBatch.from_arrays([pa.array(first_id + np.arange(n)), pa.array(used), pa.array(used >= capacity - slack), lists], names=["bin", "used", "full", "members"])


def _first_id(level: int) -> int:
    from pyspark import TaskContext

    return (level << 56) + (TaskContext.get().partitionId() << 32)


@tidy
def _pack_texts(batches, path: str, end_id: int, capacity: int, slack: int):
    encoder, end = Encoder.of(path, __name__), np.uint32(end_id).astype("<u4").tobytes()
    ids: list[pa.Array] = []
    rows: list[tuple[int, int, int, int]] = []
    owner: list[int] = []
    seen = 0
    for batch in batches:
        ids.append(batch.column(0))
        for k, text in enumerate(batch.column(1)):
            data = encoder.encode(text.as_py()) + end
            for p, (start, length) in enumerate(pieces(len(data) // 4, capacity)):
                rows.append((p, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                owner.append(seen + k)
        seen += batch.num_rows
    if rows:
        piece, start, length, crc = (np.array(c) for c in zip(*rows))
        members = pa.StructArray.from_arrays(
            [pa.concat_arrays(ids).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )
        yield _bins(length, members, np.arange(len(rows) + 1), capacity, slack, _first_id(0))


@tidy
def _repack(batches, capacity: int, slack: int, level: int):
    if (held := [b for b in batches if b.num_rows]):
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("members").chunk(0)
        offsets = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
        yield _bins(table.column("used").to_numpy(), lists.flatten(), offsets, capacity, slack, _first_id(level))


def _unfold(batches):
    for batch in batches:
        lists, bins = batch.column(1), batch.column(0).to_numpy()
        counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        fields = {flat.type.field(k).name: c for k, c in enumerate(flat.flatten())}
        length = fields["length"].to_numpy()
        before = np.cumsum(length) - length
        firsts = np.repeat(np.cumsum(counts) - counts, counts)
        yield pa.RecordBatch.from_arrays([*fields.values(), pa.array(np.repeat(bins, counts)), pa.array(before - before[firsts])], names=[*fields, "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 0, capacity: int = 2048, slack: int | None = None, fan_in: int = 8, most_items: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; offsets have no gaps in a sequence."""
    slack = capacity // 256 if slack is None else slack
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"bin bigint, used bigint, full boolean, members array<{MEMBER.format(kind)}>"
    work = partial(_pack_texts, path=vocabulary_path or vocabulary("byte_bpe_50k.json"), end_id=end_id, capacity=capacity, slack=slack)
    now = written(rows.mapInArrow(work, shape), "round-0")
    parts = max(1, now.select(F.spark_partition_id().alias("p")).distinct().count())
    done, level, won = [], 0, True
    while parts > 1 or not level:
        open_ = now.filter("not full")
        n = open_.count()
        to = min(parts, max(-(-parts // fan_in), -(-n // most_items)))
        if not n or level and to >= parts and not won:
            break
        done.append(now.filter("full"))
        parts, level = to, level + 1
        now = written(open_.repartition(parts, F.xxhash64("bin", F.lit(level))).mapInArrow(partial(_repack, capacity=capacity, slack=slack, level=level), shape), f"round-{level}")
        won = n - now.count() > n // 1000
    sequences = reduce(DataFrame.union, [*done, now]).select("bin", "members")
    return sequences.mapInArrow(_unfold, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
