"""Operator 5: benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words: the words at its ones are hashed, those at its zeros may differ. Hashes of the
test items are joined with those of every document; around each hit the document's words and the item's are aligned at the
hit's offset, and the run with the best balance (+1 for an equal word, -``penalty`` for a different one) is the overlap. It
counts if it spans ``least_words`` words (or the whole item, if that is shorter) and ``least_share`` of its words are equal.

Items of fewer than ``WHOLE`` words are also judged as a whole: ``least_share`` of all their words are equal at one place of the
text. Those places are found without loss: an item is cut into two pieces more than words may differ, and some two pieces are
equal there; they are looked up at the places of a text where enough words are words of such items. Of items under ``TOLERANT``
words all words have to be equal, as a question so short with another word is mostly another question.

Words are lower case without punctuation around them; those of punctuation alone are left out. Test items are indexed by tasks
in blocks of about ``block_words`` words, files of the shared folder. The documents are read once: a task joins the seeds of its
texts with those of one block after another, and keeps the blocks that fit into ``HELD`` bytes between its texts. So test sets of
any size pass without the driver, a broadcast or a shuffle of documents, and memory is that of a few blocks.

Defined results: null texts, texts and items without words overlap with nothing; repeated rows of documents are reported once each, and repeated
items (of one id and text) are one item; null
ids are reported like others; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, id_text, kept, shared_dir, tidy

#: Of weight 8; any two words of a passage may differ between hits of different masks.
MASKS = ("11111111", "1101100111011", "1110010110111", "110101100110011")
#: Items of fewer words are judged as a whole too; of those with fewer than TOLERANT, no word may differ.
WHOLE, TOLERANT = 20, 8
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„…¿¡"
_ODD = (np.random.default_rng(5).integers(0, 1 << 63, 4096, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class Words(dict):
    """64-bit hashes of words as they stand in a lower-case text; 0 for punctuation alone. Bounded by ``most``."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        bare = word.strip(_PUNCT)
        value = self[word] = (xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) or 1) if bare else 0
        return value

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        split = (text or "").lower().split()
        found = np.fromiter(map(self.__getitem__, split), np.uint64, len(split))
        return found[found != 0]


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, place in enumerate(i for i, c in enumerate(mask) if c == "1"):
        total += words[place : place + n] * _ODD[k % len(_ODD)]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple], masks: tuple[str, ...]):
        self.ids = [i for i, _ in items]
        words = Words()
        self.words = [words.of(t) for _, t in items]
        span = max(map(len, masks))
        short = sorted({len(w) for w in self.words if 0 < len(w) < span})
        self.masks = [*((m, lambda n, m=m: n >= len(m)) for m in masks), *(("1" * n, lambda k, n=n: k == n) for n in short)]
        self.tables = []
        for mask, applies in self.masks:
            hashes, item, place = [], [], []
            for i, w in enumerate(self.words):
                if applies(len(w)):
                    h = seed_hashes(w, mask)
                    hashes.append(h)
                    item.append(np.full(len(h), i))
                    place.append(np.arange(len(h)))
            h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[(h >> np.uint64(42)).astype(np.int64)] = True
            item, place = (np.concatenate(x).astype(np.int32)[order] if x else np.empty(0, np.int32) for x in (item, place))
            self.tables.append((mask, h[order], item, place, np.packbits(bits, bitorder="little")))
        del self.masks
        self._whole: dict[float, Whole] = {}

    def whole(self, least_share: float) -> Whole:
        if least_share not in self._whole:
            self._whole[least_share] = Whole(self.words, least_share)
        return self._whole[least_share]

    def hits(self, seeds: Callable[[str], np.ndarray], most: int = 1_000_000):
        """(place in words, item, place in item, words of the mask) of every seed that a test item has too, about ``most`` at a time."""
        for mask, hashes, item, place, bits in self.tables:
            found = seeds(mask)
            slot = (found >> np.uint64(42)).astype(np.int64)
            at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            low, high = np.searchsorted(hashes, found[at], "left"), np.searchsorted(hashes, found[at], "right")
            at, low, counts = at[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(counts)
            for part in np.split(np.arange(len(at)), np.searchsorted(ends, np.arange(most, int(ends[-1]) if len(ends) else 0, most))):
                n = counts[part]
                rows = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield np.repeat(at[part], n), item[rows].astype(np.int64), place[rows].astype(np.int64), len(mask)

    def bytes(self) -> int:
        return sum(x.nbytes for table in self.tables for x in table[1:]) + sum(w.nbytes for w in self.words)


class Whole:
    """Short items, found wherever ``least_share`` of all their words are equal."""

    def __init__(self, words: list[np.ndarray], least_share: float):
        self.words = words
        self.lengths = []  # (words, least equal words, places, hashes of all pairs of pieces in turn, which pair, item)
        short = [i for i, w in enumerate(words) if TOLERANT <= len(w) < WHOLE]
        self.known = np.unique(np.concatenate([words[i] for i in short])) if short else np.empty(0, np.uint64)
        for n in sorted({len(words[i]) for i in short}):
            least = max(1, int(np.ceil(least_share * n - 1e-9)))
            items = np.array([i for i in short if len(words[i]) == n])
            pieces = np.array_split(np.arange(n), min(n, n - least + 2))
            pairs = [np.concatenate(x) for x in combinations(pieces, 2)] if len(pieces) > 1 else pieces
            block = np.stack([words[i] for i in items])
            seeds = []
            for places in pairs:
                h = self._hash(block, places)
                order = np.argsort(h, kind="stable")
                seeds.append((places, h[order], items[order]))
            self.lengths.append((n, least, seeds))

    @staticmethod
    def _hash(rows: np.ndarray, places: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Of the words at ``places`` of each row, or of the windows of one row of words that begin ``at``."""
        total = np.zeros(len(rows) if at is None else len(at), np.uint64)
        for p in places.tolist():
            total += (rows[:, p] if at is None else rows[at + p]) * _ODD[p]
        total ^= total >> np.uint64(29)
        return total * np.uint64(0xBF58476D1CE4E5B9)

    def hits(self, words: np.ndarray, ends: np.ndarray):
        """(place in words, item, equal words) of all items; ``ends`` are those of the texts, which no item crosses."""
        if not self.lengths or not len(words):
            return
        where = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        common = np.concatenate([[0], np.cumsum(self.known[where] == words)])
        for n, least, seeds in self.lengths:
            at = np.flatnonzero(common[n:] - common[:-n] >= least)
            at = at[at + n <= ends[np.searchsorted(ends, at, "right")]]
            if not len(at):
                continue
            met = set()
            for places, hashes, items in seeds:
                found = self._hash(words, places, at)
                low, high = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
                for k in np.flatnonzero(high > low).tolist():
                    met.update((int(at[k]), int(i)) for i in items[low[k] : high[k]])
            for place, item in sorted(met):
                same = int(np.count_nonzero(self.words[item] == words[place : place + n]))
                if same >= least:
                    yield place, item, same


def best_run(equal: np.ndarray, penalty: float) -> tuple[int, int]:
    """[start, stop) of the run with the best balance of equal and different words."""
    balance = np.concatenate([[0], np.cumsum(np.where(equal, 1.0, -penalty))])
    low = np.minimum.accumulate(balance)
    stop = int(np.argmax(balance - low))
    return int(np.flatnonzero(balance[: stop + 1] == low[stop])[-1]), stop


class Texts:
    """Words of some texts in turn, and the hashes of their seeds."""

    def __init__(self, texts: list[str], words: Words):
        self.parts = [words.of(t) for t in texts]
        self.ends = np.cumsum([len(p) for p in self.parts])
        self.starts = self.ends - [len(p) for p in self.parts]
        self.words = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint64)
        self._seeds: dict[str, np.ndarray] = {}

    def seeds(self, mask: str) -> np.ndarray:
        if mask not in self._seeds:
            self._seeds[mask] = seed_hashes(self.words, mask)
        return self._seeds[mask]


def matches(texts: Texts, index: Index, least_words: int, least_share: float, penalty: float) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (start, words, equal words) of the best overlap."""
    met = set()
    for at, item, place, span in index.hits(texts.seeds):
        doc = np.searchsorted(texts.ends, at, "right")
        inside = at + span <= texts.ends[doc]
        rows = np.unique(np.stack([doc, item, at - place - texts.starts[doc]], 1)[inside], axis=0)
        met.update(map(tuple, rows.tolist()))
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for doc, item, shift in sorted(met):
        mine, own = index.words[item], texts.parts[doc]
        low, high = max(0, -shift), min(len(mine), len(own) - shift)
        equal = mine[low:high] == own[low + shift : high + shift]
        s, e = best_run(equal, penalty)
        n, same = e - s, int(equal[s:e].sum())
        if n >= min(least_words, len(mine)) and same >= least_share * n and same > found.get((doc, item), (0, 0, 0))[2]:
            found[doc, item] = (low + shift + s, n, same)
    for place, item, same in index.whole(least_share).hits(texts.words, texts.ends):
        doc = int(np.searchsorted(texts.ends, place, "right"))
        if same > found.get((doc, item), (0, 0, 0))[2]:
            found[doc, item] = (place - int(texts.starts[doc]), len(index.words[item]), same)
    return found


def _chunks(column: pa.Array, chars: int = 1_000_000):
    """(start, texts) of a column, so that a chunk has not many more than ``chars`` characters."""
    texts, start, size = [], 0, 0
    for k, text in enumerate(column):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size > chars:
            yield start, texts
            texts, start, size = [], k + 1, 0
    if texts:
        yield start, texts


#: Bytes of index blocks that a worker keeps between its texts and tasks.
HELD = 128 << 20


class Blocks:
    """The index blocks of a folder, in the order of their numbers."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def __iter__(self):
        held = kept(__name__)
        for old in [path for path in held if not path.startswith(self.folder)]:
            del held[old]
        size = sum(index.bytes() for index in held.values())
        for name in self.names:
            path = f"{self.folder}/{name}"
            index = held.get(path)
            if index is None:
                system, at = filesystem(path)
                with system.open_input_stream(at) as f:
                    index = pickle.loads(f.read())
                if size + index.bytes() <= HELD:
                    held[path] = index
                    size += index.bytes()
            yield index


def _write_blocks(batches, folder: str, masks: tuple[str, ...]):
    """Rows (block, id, text) sorted by block; writes a file for each block under another name and renames it."""
    from pyspark import TaskContext

    system, root = filesystem(folder)
    held: list[tuple] = []
    now, attempt = None, TaskContext.get().taskAttemptId()

    def flush():
        name = f"block-{now:07d}"
        with system.open_output_stream(f"{root}/_{name}.{attempt}") as f:
            f.write(pickle.dumps(Index(sorted(held, key=lambda r: (r[0] is None, r[0], r[1])), masks), protocol=5))
        system.move(f"{root}/_{name}.{attempt}", f"{root}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    for batch in batches:
        for block, item, text in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now:
                if held:
                    yield flush()
                now, held = block, []
            held.append((item, text))
    if held:
        yield flush()


def write_index(benchmark: DataFrame, item_id: str, item_text: str, masks: tuple[str, ...], block_words: int) -> Blocks:
    """Index the items in blocks of the shared folder; the driver has the names of the blocks alone."""
    items = id_text(benchmark, item_id, item_text).distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()[0] or 0
    blocks, folder = max(1, -(-total // block_words)), f"{shared_dir(benchmark.sparkSession)}/index"
    system, root = filesystem(folder)
    system.create_dir(root)
    rows = items.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text")
    dealt = rows.repartition(min(blocks, 1000), "block").sortWithinPartitions("block")
    names = dealt.mapInArrow(partial(_write_blocks, folder=folder, masks=masks), "name string").collect()  # a short name for each block
    return Blocks(folder, sorted(r.name for r in names))


def _matches(column: pa.Array, words: Words, blocks: Blocks, **rule):
    """(first row, texts, overlaps with each block) of the texts of a column; larger chunks where there are more blocks than are kept."""
    for start, texts in _chunks(column, 1_000_000 * min(16, 1 + len(blocks.names) // 8)):
        prepared = Texts(texts, words)
        yield start, len(texts), ((index, matches(prepared, index, **rule)) for index in blocks)


@tidy
def _report(batches, blocks: Blocks, kind: pa.DataType, **rule):
    words = Words()
    for batch in batches:
        for start, _, found in _matches(batch.column(1), words, blocks, **rule):
            rows = [(d + start, index.ids[i], len(index.words[i]), *x) for index, pairs in found for (d, i), x in pairs.items()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], kind), *(pa.array(c, pa.int32()) for c in cols[2:])],
                names=["doc_id", "item_id", "item_words", "start", "n_words", "n_equal"],
            )


@tidy
def _clean(batches, blocks: Blocks, text: int, **rule):
    words = Words()
    for batch in batches:
        for start, n, found in _matches(batch.column(0).field(text), words, blocks, **rule):
            bad = {d for _, pairs in found for d, _ in pairs}
            yield batch.take(pa.array([start + k for k in range(n) if k not in bad], pa.int64()))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, least_words: int = 12, least_share: float = 0.75, penalty: float = 2.0, block_words: int = 100_000) -> DataFrame:
    """(doc_id, item_id, item_words, start, n_words, n_equal): the best overlap of every row with every item it overlaps with."""
    rows = id_text(docs, id_col, text_col)
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    shape = f"doc_id {kind}, item_id {item_kind}, item_words int, start int, n_words int, n_equal int"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(benchmark.schema[item_id].dataType)
    rule = {"least_words": least_words, "least_share": least_share, "penalty": penalty}
    blocks = write_index(benchmark, item_id, item_text, masks, block_words)
    return rows.mapInArrow(partial(_report, blocks=blocks, kind=arrow, **rule), shape)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, least_words: int = 12, least_share: float = 0.75, penalty: float = 2.0, block_words: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns; a filter in place, without a join."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rule = {"text": docs.columns.index(text_col), "least_words": least_words, "least_share": least_share, "penalty": penalty}
    blocks = write_index(benchmark, item_id, item_text, masks, block_words)
    return rows.mapInArrow(partial(_clean, blocks=blocks, **rule), rows.schema).select("row.*")
