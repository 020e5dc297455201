"""Operator 13: collocations, phrases of two to five words whose parts stand together more often than by chance.

Words are counted first; the frequent ones of a language get slots of a minimal perfect hash (``mph``), under which texts are
written once as sequences of slots. Then level by level: a phrase of m words is the pair of the slots of its first and its last
m - 1 words, so it exists only where both are frequent (Apriori), and the pair is its exact 64-bit key. Keys are first counted
by the place of their hash in a sketch, which has ``LOAD`` places for every ``least`` pairs that may occur, so that it tells
as much in a large corpus as in a small one; only keys of places that reach ``least``, and that some task has its share of,
can be frequent. These candidates, in blocks of a bounded size, get a minimal perfect hash each, whose stored keys decide on a
match. Mappers count slots by
``bincount`` into an array for each block; a tree of sums, ``FAN`` arrays at a time, adds them up. Counts are files by block
as well, so the parts of every cut of a candidate are read by slot. No candidate, word or count of the corpus passes through
the driver; it has block numbers and sums.

A worker keeps ``HELD`` bytes of blocks and of the sketch's bits at most, and reads others again; no worker has the sketch's
counts, it sends those of ``PENDING`` pairs at a time. An array of counts leaves a mapper when it has
``ARRAYS`` of them. Slots have 32 bits: a level of more than 2^32 / 4 candidates or so stops with an error.

Defined results: null texts count as empty; a null language is ``und``; texts without words have no phrases; repeated rows and
ids count each; an empty table gives no rows; other columns are ignored. Only A-Z are lower-cased. Words may hold anything but
space, tab and the characters that end a piece.
"""

from __future__ import annotations

import itertools
import pickle
from collections import Counter, OrderedDict
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, join_unique, kept, shared_dir, tidy, written
from .mph import Table, mixed

LOAD, PLACES, PIECES = 4, 1 << 22, 1024  # places for each ``least`` pairs, the fewest of a sketch, and its most pieces
FAN, ARRAYS = 64, 64
BLOCK, LOCAL = 1 << 16, 18  # keys of a block on average, and bits of a slot inside its block
HELD, PENDING, ROW = 64 << 20, 2_000_000, 1 << 16  # bytes of a worker's files, pairs of a task's sketch, slots of a row of sequences
NONE = np.uint32(0xFFFFFFFF)
_END = b"\xff"  # between pieces; no byte of UTF-8
_MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)
_OUT = "kind string, piece int, turn int, payload binary"


def tokens(raw: bytes) -> list[bytes]:
    """The words of UTF-8 bytes, with ``_END`` between pieces."""
    return raw.translate(_MAP).replace(_END, b" \xff ").split()


def _parts(batch: pa.RecordBatch, chars: int = 2_000_000):
    """(lang, bytes) of texts of one language together, a piece's end between them."""
    texts: dict[str, tuple[list[bytes], int]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        if raw := text.as_buffer().to_pybytes() if text.is_valid else b"":
            raws, size = texts.pop(lang, ([], 0))
            raws.append(raw)
            if size + len(raw) > chars:
                yield lang, _END.join(raws)
            else:
                texts[lang] = raws, size + len(raw)
    for lang, (raws, _) in texts.items():
        yield lang, _END.join(raws)


@tidy
def _words(batches):
    counts: dict[str, Counter] = {}

    def flush():
        for lang, found in counts.items():
            found.pop(_END, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, raw in _parts(batch):
            counts.setdefault(lang, Counter()).update(tokens(raw))
            if sum(map(len, counts.values())) > 150_000:
                yield from flush()
    yield from flush()


def _digest(lang: str, word: bytes, seed: int) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(lang.encode("utf-8", "surrogatepass") + b" " + word, seed)
    return x >> 64, x & 0xFFFFFFFFFFFFFFFF


@tidy
def _hashed(batches, seed: int):
    for batch in batches:
        pairs = [_digest(lang, word, seed) for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist())]
        both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *batch.columns], names=["key", "other", *batch.schema.names])


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(keys, 99) % np.uint64(blocks)).astype(np.int64)


@tidy
def _numbered(batches, blocks: int):
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(_block_of(keys, blocks).astype(np.int32)), *batch.columns], names=["block", *batch.schema.names])


@tidy
def _built(batches, folder: str, level: int):
    """Rows sorted by block; writes each block's table, with the columns beside the key in the order of its slots, texts in a file of their own."""
    fs, path = filesystem(folder)

    def write(block: int, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        keys = table["key"].to_numpy().view(np.uint64)
        own = Table(keys)
        if len(own) >> LOCAL:
            raise ValueError(f"{len(own)} keys in a block")
        order = np.empty(len(keys), np.int64)
        order[own.find(keys)] = np.arange(len(keys))
        columns = {c: table[c].take(pa.array(order)).combine_chunks() for c in table.column_names if c not in ("key", "block")}
        texts = {c: columns.pop(c) for c in ("lang", "word") if c in columns}
        for name, data in (("table", (own, {c: v.to_numpy() for c, v in columns.items()})), *([("texts", texts)] if texts else ())):
            with fs.open_output_stream(f"{path}/{name}-{level}-{block}") as out:
                out.write(pickle.dumps(data, 5))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(own)], pa.int64())], names=["block", "n"])

    now, rows = None, []
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for s, e in zip(edges[:-1], edges[1:]):
            if e == s:
                continue
            if now is not None and numbers[s] != now:
                yield write(now, rows)
                rows = []
            now = int(numbers[s])
            rows.append(batch.slice(s, e - s))
    if rows:
        yield write(now, rows)


def _grouped(owner: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(number, where it is) of each of the numbers."""
    if not len(owner):
        return []
    owner = owner.astype(np.uint16 if int(owner.max()) < 1 << 16 else np.uint32)  # 16 bits sort faster
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    edges = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    return list(zip(owner[np.concatenate([[0], edges])].tolist(), np.split(order, edges)))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and how often each occurs; sorts in place."""
    values.sort()
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1]) if len(values) else np.empty(0, np.int64)
    return values[starts], np.diff(starts, append=len(values))


class Sketch:
    """A count for each of ``places`` places of hashes of pairs, in pieces of ``piece`` places; its bits are files of about 1 MB."""

    def __init__(self, pairs: int, least: int):
        most = min(max(PLACES, -(-LOAD * pairs // least)), (1 << 32) - (1 << 24))
        self.piece = 1 << max(16, (-(-most // PIECES) - 1).bit_length())
        self.places = -(-most // self.piece) * self.piece
        self.file = max(self.piece, 1 << 23)  # places of a file of bits

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys, 77) % np.uint64(self.places)).astype(np.uint32)


class Index:
    """Blocks of all levels, as files that tasks read when they need them.

    ``blocks`` has how many a level has, and which have keys; ``bits`` the sketch of a level, and which files its bits have.
    """

    def __init__(self, folder: str, blocks: dict[int, tuple[int, list[int]]], least: int, bits: dict[int, tuple[Sketch, list[int]]] | None = None):
        self.folder, self.blocks, self.least, self.bits = folder, blocks, least, bits or {}

    def _file(self, name: str):
        held = kept(__name__).setdefault("files", OrderedDict())
        path = f"{self.folder}/{name}"
        if path not in held:
            fs, folder = filesystem(self.folder)
            with fs.open_input_stream(f"{folder}/{name}") as file:
                data = file.read()
            while held and sum(size for size, _ in held.values()) + len(data) > HELD:
                held.popitem(last=False)
            held[path] = len(data), pickle.loads(data)
        held.move_to_end(path)
        return held[path][1]

    def _held_first(self, groups: list[tuple[int, np.ndarray]], name: str) -> list[tuple[int, np.ndarray]]:
        """Files that the worker has come first, else each pass over more than ``HELD`` bytes would read all of them."""
        held = kept(__name__).get("files", ())
        return sorted(groups, key=lambda g: f"{self.folder}/{name}-{g[0]}" not in held)

    def table(self, level: int, block: int) -> tuple[Table, dict[str, np.ndarray]]:
        return self._file(f"table-{level}-{block}")

    def counts(self, level: int, block: int) -> np.ndarray:
        return self.table(1, block)[1]["n"] if level == 1 else self._file(f"counts-{level}-{block}")

    def find(self, level: int, keys: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
        """Slots of keys, ``NONE`` where there is none; words have another 64 bits to compare."""
        out = np.full(len(keys), NONE, np.uint32)
        n, there = self.blocks[level]
        there = set(there)
        for block, at in self._held_first(_grouped(_block_of(keys, n)), f"table-{level}"):
            if block not in there:
                continue
            table, columns = self.table(level, block)
            slots = table.find(keys[at])
            hit = slots >= 0
            if other is not None:
                hit[hit] = columns["other"][slots[hit]].view(np.uint64) == other[at[hit]]
            out[at[hit]] = (block << LOCAL) + slots[hit]
        return out

    def passing(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Which keys' places reach ``least`` in the level's sketch."""
        sketch, there = self.bits[level]
        out, place, there = np.zeros(len(keys), bool), sketch.place(keys), set(there)
        for number, at in self._held_first(_grouped(place // np.uint32(sketch.file)), f"bits-{level}"):
            if number in there:
                own = place[at] % np.uint32(sketch.file)
                out[at] = (self._file(f"bits-{level}-{number}")[own >> 3] >> (own & 7).astype(np.uint8)) & 1 == 1
        return out

    def take(self, level: int, slots: np.ndarray, column: str) -> np.ndarray:
        """What the slots' blocks have for them: ``count``, ``key``, or a column of the table."""
        out, text = None, column in ("lang", "word")
        name = f"{'texts' if text else 'counts' if column == 'count' and level > 1 else 'table'}-{level}"
        for block, at in self._held_first(_grouped(slots >> LOCAL), name):
            own = slots[at].astype(np.int64) & ((1 << LOCAL) - 1)
            if text:
                values = self._file(f"{name}-{block}")[column].take(pa.array(own)).to_numpy(zero_copy_only=False)
            else:
                values = (self.counts(level, block) if column == "count" else self.table(level, block)[0].keys if column == "key" else self.table(level, block)[1][column])[own]
            out = np.empty(len(slots), values.dtype) if out is None else out
            out[at] = values
        return np.empty(0, np.int64) if out is None else out

    def ends(self, level: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of a phrase without its last and without its first word."""
        keys = self.take(level, slots, "key").astype(np.uint64)
        return (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)

    def words(self, level: int, slots: np.ndarray) -> np.ndarray:
        """(phrases, level): the slots of each phrase's words."""
        columns = []
        for m in range(level, 1, -1):
            slots, last = self.ends(m, slots)
            for k in range(m - 1, 1, -1):
                last = self.ends(k, last)[1]
            columns.append(last)
        return np.stack([slots, *columns[::-1]], axis=1)


def _pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of slots that follow each other, and where."""
    at = np.flatnonzero((seq[1:] != NONE) & (seq[:-1] != NONE)) if len(seq) > 1 else np.empty(0, np.int64)
    return at, (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1].astype(np.uint64)


_KINDS = {1: np.dtype("<u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4"), 8: np.dtype("<i8")}


def _width(most: int) -> int:
    return next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)


def packed_at(n: int, at: np.ndarray, values: np.ndarray) -> bytes:
    """``n`` counts, of which ``values`` at the rising places ``at`` are not 0: each in as few bytes as the largest needs, all or with gaps between places, whichever is shorter."""
    gaps = np.diff(at.astype(np.int64), prepend=0)
    width, step = _width(int(values.max(initial=0))), _width(int(gaps.max(initial=0)))
    sparse = len(at) * (step + width) < n * width
    head = np.array([n, len(at) if sparse else -1, width | step << 8], "<i8").tobytes()
    if sparse:
        return head + gaps.astype(_KINDS[step]).tobytes() + values.astype(_KINDS[width]).tobytes()
    full = np.zeros(n, _KINDS[width])
    full[at] = values
    return head + full.tobytes()


def packed(values: np.ndarray) -> bytes:
    at = np.flatnonzero(values)
    return packed_at(len(values), at, values[at])


def added_to(total: np.ndarray | None, payload: bytes) -> np.ndarray:
    """``total`` (None: zeros) plus packed counts."""
    n, k, widths = np.frombuffer(payload, "<i8", 3).tolist()
    total = np.zeros(n, np.int64) if total is None else total
    kind, step = _KINDS[widths & 255], _KINDS[widths >> 8]
    if k < 0:
        total += np.frombuffer(payload, kind, n, 24)
    else:
        total[np.cumsum(np.frombuffer(payload, step, k, 24), dtype=np.int64)] += np.frombuffer(payload, kind, k, 24 + step.itemsize * k)
    return total


def _rows(kind: str, pieces: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    turn, n = TaskContext.get().partitionId(), len(pieces)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(pieces, pa.int32()), pa.array([turn] * n, pa.int32()), pa.array(payloads, pa.binary())], names=["kind", "piece", "turn", "payload"])


class _Sequences:
    """Collects sequences of slots, where what the next level could count in them falls in its sketch, and writes both."""

    def __init__(self, sketch: Sketch | None):
        self.parts: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size, self.pending, self.sketch = 0, 0, sketch

    def add(self, seq: np.ndarray):
        there = seq != NONE
        near = np.zeros(len(seq), bool)
        near[:-1] |= there[1:]
        near[1:] |= there[:-1]
        there &= near  # alone, it is in no longer phrase
        keep = there.copy()
        keep[1:] |= there[:-1]
        short = np.where(there, seq, NONE)[keep]
        if self.sketch is not None and len(short):
            self.places.append(self.sketch.place(_pairs(short)[1]))
            self.pending += len(self.places[-1])
            if self.pending > PENDING:
                yield from self.counted()
        self.parts += [short, np.array([NONE], np.uint32)]
        self.size += len(short) + 1
        if self.size > 1_000_000:
            yield from self.flush()

    def flush(self):
        """Rows end where no phrase goes on."""
        if self.size > len(self.parts) // 2:
            seq = np.concatenate(self.parts)
            ends = np.flatnonzero(seq == NONE) + 1
            cuts = np.unique(ends[np.searchsorted(ends, np.arange(ROW, len(seq) + ROW, ROW).clip(max=len(seq)))])
            yield _rows("sequence", [0] * len(cuts), [seq[s:e].tobytes() for s, e in zip([0, *cuts.tolist()], cuts.tolist())])
        self.parts, self.size = [], 0

    def counted(self):
        if self.pending:
            at, n = _distinct(np.concatenate(self.places))
            piece = self.sketch.piece
            pieces = np.unique(at // np.uint32(piece)).astype(np.int64)
            edges = [*np.searchsorted(at, (pieces * piece).astype(np.uint32)).tolist(), len(at)]
            yield _rows("sketch", pieces.tolist(), [packed_at(piece, at[s:e] % np.uint32(piece), n[s:e]) for s, e in zip(edges[:-1], edges[1:])])
        self.places, self.pending = [], 0

    def close(self):
        yield from self.flush()
        yield from self.counted()


@tidy
def _encoded(batches, index: Index, seed: int, sketch: Sketch | None):
    """Sequences of the slots of frequent words."""
    out, memo = _Sequences(sketch), {}
    for batch in batches:
        for lang, raw in _parts(batch):
            words = tokens(raw)
            if sum(map(len, memo.values())) > 100_000:
                memo.clear()
            known = memo.setdefault(lang, {})
            if new := [w for w in set(words) if w not in known]:
                keys = np.array([_digest(lang, w, seed) for w in new], np.uint64)
                slots = index.find(1, keys[:, 0], keys[:, 1])
                there = np.flatnonzero(slots != NONE).tolist()
                known.update(zip((new[i] for i in there), slots[there].tolist()))
            yield from out.add(np.fromiter(map(known.get, words, itertools.repeat(int(NONE))), np.uint32, len(words)))
    yield from out.close()


def _sequences(batches, index: Index, level: int, most: int = 1_000_000):
    """Sequences of a level, of frequent phrases alone; those of several rows together, up to ``most`` slots."""

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        seq = np.concatenate(parts)
        at = np.flatnonzero(seq != NONE)
        if level > 1:
            seq[at[index.take(level, seq[at], "count") < index.least]] = NONE
        return seq

    for batch in batches:
        parts, size = [], 0
        for payload in batch.column(0):
            part = np.frombuffer(payload.as_buffer(), np.uint32)
            if parts and size + len(part) > most:
                yield joined(parts)
                parts, size = [], 0
            parts.append(part)
            size += len(part)
        if parts:
            yield joined(parts)


@tidy
def _candidates(batches, index: Index, level: int, tasks: int, parts: int, most: int = 2_000_000):
    """Distinct keys of the level of each sequence, which the sketch lets pass and a task has often enough: an array for each of ``parts`` parts.

    A key that occurs ``least`` times over all tasks occurs a ``tasks``-th of that in one of them. A task that can't hold its
    keys sends all that it has.
    """
    keys, counts, share = np.empty(0, np.uint64), np.empty(0, np.int64), -(-index.least // tasks)

    def dealt(keys: np.ndarray):
        there = _grouped(mixed(keys, 55) % np.uint64(parts))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in there], pa.int32()), pa.array([keys[at].tobytes() for _, at in there], pa.binary())], names=["part", "keys"])

    for seq in _sequences(batches, index, level - 1):
        new = _pairs(seq)[1]
        new, n = _distinct(new[index.passing(level, new)])
        at = np.searchsorted(keys, new)
        old = at < len(keys)
        old[old] = keys[at[old]] == new[old]
        counts[at[old]] += n[old]
        counts, keys = np.insert(counts, at[~old], n[~old]), np.insert(keys, at[~old], new[~old])
        if len(keys) > most:
            yield dealt(keys)
            keys, counts = keys[:0].copy(), counts[:0].copy()
    yield dealt(keys[counts >= share])


@tidy
def _united(batches):
    """Rows (part, keys) sorted by part: the distinct keys of each part."""
    now, held, size = None, [], 0

    def distinct():
        return np.unique(np.concatenate(held))

    for batch in batches:
        for part, packed_keys in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and part != now:
                yield pa.RecordBatch.from_arrays([pa.array(distinct().view(np.int64))], names=["key"])
                held, size = [], 0
            now = part
            held.append(np.frombuffer(packed_keys.as_buffer(), np.uint64))
            size += len(held[-1])
            if size > 2_000_000:
                held = [distinct()]
                size = 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(distinct().view(np.int64))], names=["key"])


@tidy
def _counted(batches, index: Index, level: int, sketch: Sketch | None):
    """Sequences of the level's candidates, and how often each occurs."""
    out, counts = _Sequences(sketch), {}
    for seq in _sequences(batches, index, level - 1):
        at, keys = _pairs(seq)
        on = index.passing(level, keys)
        at, slots = at[on], index.find(level, keys[on])
        found = np.full(max(len(seq) - 1, 0), NONE, np.uint32)
        found[at] = slots
        slots = slots[slots != NONE].astype(np.int64)
        for block, here in index._held_first(_grouped(slots >> LOCAL), f"table-{level}"):
            if block not in counts:
                if len(counts) == ARRAYS:
                    yield _rows("count", list(counts), list(map(packed, counts.values())))
                    counts = {}
                counts[block] = np.zeros(len(index.table(level, block)[0]), np.int64)
            counts[block] += np.bincount(slots[here] & ((1 << LOCAL) - 1), minlength=len(counts[block]))
        yield from out.add(found)
    yield _rows("count", list(counts), list(map(packed, counts.values())))
    yield from out.close()


@tidy
def _added(batches):
    """Rows (piece, turn, payload) sorted by the first two: one for each, with the sum of the payloads."""
    now, total = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([packed(total)], pa.binary())], names=["piece", "turn", "payload"])

    for batch in batches:
        for piece, turn, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if now is not None and (piece, turn) != now:
                yield done()
                total = None
            now, total = (piece, turn), added_to(total, payload.as_buffer())
    if now is not None:
        yield done()


def tree_sum(arrays: DataFrame) -> DataFrame:
    """(piece, payload) of rows (piece, turn, payload): the arrays of each piece summed, ``FAN`` turns at a time."""
    spark = arrays.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns, now = (arrays.agg(F.max("turn")).first()[0] or 0) + 1, arrays.select("piece", "turn", "payload")
    while True:
        turns = -(-turns // FAN)
        dealt = now.withColumn("turn", F.floor(F.col("turn") / FAN).cast("int")).repartition(parts, "piece", "turn").sortWithinPartitions("piece", "turn")
        now = dealt.mapInArrow(_added, "piece int, turn int, payload binary")
        if turns == 1:
            return now.drop("turn")
        now = written(now, "sums")


@tidy
def _bits(batches, least: int, sketch: Sketch):
    for batch in batches:
        bits = [np.packbits(added_to(None, p.as_buffer()) >= least, bitorder="little").tobytes() for p in batch.column(1)]
        numbers = [p * sketch.piece // sketch.file for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), batch.column(0), pa.array(bits, pa.binary())], names=["number", "piece", "bits"])


@tidy
def _bits_filed(batches, folder: str, level: int, sketch: Sketch):
    """Rows (number, piece, bits) sorted by number: a file for each number."""
    fs, path = filesystem(folder)

    def write(number: int, bits: np.ndarray):
        with fs.open_output_stream(f"{path}/bits-{level}-{number}") as out:
            out.write(pickle.dumps(bits, 5))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], names=["number"])

    now, held = None, None
    for batch in batches:
        for number, piece, bits in zip(*(c.to_pylist() for c in batch.columns)):
            if number != now:
                if held is not None:
                    yield write(now, held)
                now, held = number, np.zeros(sketch.file // 8, np.uint8)
            at = piece * sketch.piece % sketch.file // 8
            held[at : at + len(bits)] = np.frombuffer(bits, np.uint8)
    if held is not None:
        yield write(now, held)


def _sketched(now: DataFrame, folder: str, level: int, least: int, sketch: Sketch) -> list[int]:
    """Write the bits of the level's sketch; which files they are."""
    parts, files = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sketch.places // sketch.file)
    bits = tree_sum(now.filter("kind = 'sketch'")).mapInArrow(partial(_bits, least=least, sketch=sketch), "number int, piece int, bits binary")
    dealt = bits.repartition(min(files, parts), "number").sortWithinPartitions("number")
    done = written(dealt.mapInArrow(partial(_bits_filed, folder=folder, level=level, sketch=sketch), "number int"), "bits")
    return sorted(r.number for r in done.collect())


@tidy
def _filed(batches, folder: str, level: int, least: int):
    """Write the counts of blocks; how often their frequent phrases occur."""
    fs, path = filesystem(folder)
    for batch in batches:
        sums = []
        for piece, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = added_to(None, payload.as_buffer())
            with fs.open_output_stream(f"{path}/counts-{level}-{piece}") as out:
                out.write(pickle.dumps(counts, 5))
            sums.append(int(counts[counts >= least].sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["piece", "n"])


@tidy
def _scored(batches, index: Index):
    """Of (level, block): its frequent phrases with their lowest cuts."""
    names = ["lang", "phrase", "level", "slot", "head", "tail", "a", "l", "r", "n", "score"]
    for batch in batches:
        for level, block in zip(*(c.to_pylist() for c in batch.columns)):
            counts = index.counts(level, block)
            slots = (np.flatnonzero(counts >= index.least) + (block << LOCAL)).astype(np.uint32)
            for slots in np.array_split(slots, -(-len(slots) // 20_000)) if len(slots) else ():
                a = index.take(level, slots, "count").tolist()
                head, tail = index.ends(level, slots)
                lefts, rights, p, q = {level - 1: index.take(level - 1, head, "count").tolist()}, {level - 1: index.take(level - 1, tail, "count").tolist()}, head, tail
                for m in range(level - 1, 1, -1):
                    p, q = index.ends(m, p)[0], index.ends(m, q)[1]
                    lefts[m - 1], rights[m - 1] = index.take(m - 1, p, "count").tolist(), index.take(m - 1, q, "count").tolist()
                own = index.words(level, slots)
                langs, totals = index.take(1, own[:, 0], "lang").tolist(), index.take(1, own[:, 0], "total").tolist()
                spelt = [index.take(1, column, "word").tolist() for column in own.T]
                rows = []
                for i in range(len(slots)):
                    score, k = min((1000 * a[i] * totals[i] // (lefts[k][i] * rights[level - k][i]), k) for k in range(1, level))
                    rows.append((langs[i], b" ".join(w[i] for w in spelt).decode("utf-8", "surrogatepass"), level, int(slots[i]), int(head[i]), int(tail[i]), a[i], lefts[k][i], rights[level - k][i], totals[i], score))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(zip(*rows))], names=names)


def _out(df: DataFrame, tag: str) -> DataFrame:
    """Written with a folder for each kind of row, so that each is read alone, in small row groups, as Spark reads one at once."""
    path = f"{shared_dir(df.sparkSession)}/{tag}"
    df.write.option("parquet.block.size", 16 << 20).partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(_OUT).parquet(path)


def _build(keys: DataFrame, folder: str, level: int) -> tuple[int, list[int]]:
    """Write the level's tables; how many blocks they are, and which of them have keys."""
    n, parts = keys.count(), int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-n // BLOCK)
    if blocks >> (31 - LOCAL):
        raise ValueError(f"{n} phrases of {level} words need slots of more than 32 bits")
    there = []
    if blocks:
        kind = ", ".join(f"{c} {t}" for c, t in keys.dtypes)
        dealt = keys.mapInArrow(partial(_numbered, blocks=blocks), f"block int, {kind}").repartition(min(blocks, parts), "block").sortWithinPartitions("block", "key")
        found = written(dealt.mapInArrow(partial(_built, folder=folder, level=level), "block int, n long"), "blocks")
        there = sorted(r.block for r in found.select("block").collect())
    return blocks, there


def candidates(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every phrase of 2 to ``longest`` words that occurs ``least`` times or more: lang, phrase, level, slot, head, tail, a, l, r, n, score."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    words = written(rows.mapInArrow(_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= least).alias("kinds"), F.sum(F.when(F.col("n") >= least, F.col("n"))).alias("often")), "totals")
    kinds, often = (x or 0 for x in totals.agg(F.sum("kinds"), F.sum("often")).first())
    frequent = written(join_unique(words.filter(F.col("n") >= least), totals, "lang", "kinds", kinds).drop("kinds", "often"), "frequent")
    seed = 0
    while True:  # two words with one key would share a slot: other keys then
        hashed = frequent.mapInArrow(partial(_hashed, seed=seed), "key long, other long, " + ", ".join(f"{c} {t}" for c, t in frequent.dtypes))
        if hashed.groupBy("key").count().filter("count > 1").isEmpty():
            break
        seed += 1
    folder, parts = shared_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    index = Index(folder, {1: _build(hashed, folder, 1)}, least)
    often = {1: often}  # by level, how many places its frequent phrases have
    sketch = Sketch(often[1], least)
    now = _out(rows.mapInArrow(partial(_encoded, index=index, seed=seed, sketch=sketch), _OUT), "words") if index.blocks[1][0] else None
    for level in range(2, longest + 1) if now else ():
        index = Index(folder, index.blocks, least, {level: (sketch, _sketched(now, folder, level, least, sketch))})
        sequences = now.filter("kind = 'sequence'").select("payload")
        tasks = max(1, sequences.rdd.getNumPartitions())
        own = sequences.mapInArrow(partial(_candidates, index=index, level=level, tasks=tasks, parts=parts), "part int, keys binary")
        found = written(own.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_united, "key long"), "keys")
        blocks = _build(found, folder, level)
        if not blocks[0]:
            break
        index = Index(folder, index.blocks | {level: blocks}, least, index.bits)
        sketch = Sketch(often[level - 1], least) if level < longest else None
        now = _out(sequences.mapInArrow(partial(_counted, index=index, level=level, sketch=sketch), _OUT), f"level-{level}")
        done = written(tree_sum(now.filter("kind = 'count'")).mapInArrow(partial(_filed, folder=folder, level=level, least=least), "piece int, n long"), "counts")
        often[level] = done.agg(F.sum("n")).first()[0] or 0
    blocks = [(level, b) for level, (_, there) in index.blocks.items() if level > 1 for b in there]
    listed = spark.createDataFrame(blocks, "level int, block int").repartition(max(1, len(blocks)))
    return written(listed.mapInArrow(partial(_scored, index=index), "lang string, phrase string, level long, slot long, head long, tail long, a long, l long, r long, n long, score long"), "phrases")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000, percent: int = 100, **columns) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): candidates by score, but those that nearly always stand in a longer one.

    Dropped are phrases whose words lie inside a longer candidate with ``percent`` of their occurrences. A phrase one word
    longer tells: it occurs as often as any longer one, at least. ``top``: so many of each language, else all.
    """
    found = candidates(docs, least, longest, **columns)
    longer = found.filter("level > 2").select((F.col("level") - 1).alias("level"), F.explode(F.array("head", "tail")).alias("slot"), F.col("a").alias("most")).groupBy("level", "slot").agg(F.max("most").alias("most"))
    left = found.join(longer, ["level", "slot"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order))
    return (ranked.filter(F.col("rank") <= top) if top else ranked).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
