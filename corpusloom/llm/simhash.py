"""Operator 1: near-duplicate documents by SimHash fingerprints, compared exactly in tiles.

A fingerprint has one bit per bit position of the shingle hashes: 1 if set in over half of them. Distinct fingerprints are
dealt to tiles by the population counts of equal lanes of the fingerprint. Flipping one bit changes one lane's count by one,
so two fingerprints at distance d lie in tiles whose counts differ by d at most in sum, and all other pairs of tiles are
skipped. Inside a pair of tiles numpy compares everything with exclusive-or and bit counts: no link is lost. Tiles of more
than ``tile`` fingerprints are split, and each part meets all it has to.

Only distinct fingerprints are compared, and a task returns a spanning forest of the links that it finds, never all pairs.

Defined results: null text counts as empty, texts without words have fingerprint 0 and are linked like any other; repeated
rows give a row each; a null id is returned as it is and never names a component unless all ids of the class are null
(then component_id is null); an empty table gives no rows. Columns other than id and text are ignored. Ids are integers.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Links, id_text, join_unique, tidy, written
from .components import connected_components

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the whole text as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < shingle:
        return _hash(b" ".join(words))
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(shingle))))), np.uint64, n)
    lanes = hashes.view(np.uint8).reshape(n, 8)
    if n < 200:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(0)
    else:
        counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@tidy
def _fingerprints(batches, shingle: int):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, len(ids), 1000):
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts[at : at + 1000]), np.uint64, min(1000, len(ids) - at))
            yield pa.RecordBatch.from_arrays([ids[at : at + 1000], pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed long."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), f"doc_id {kind}, fp long")


def _lane_counts(lanes: int):
    width = 64 // lanes
    mask = F.lit((1 << width) - 1).cast("long")
    return [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(mask)) for k in range(lanes)]


def _steps(lanes: int, radius: int, base: int) -> list[int]:
    """Cell number differences of all pairs of cells that may hold a link, one of either direction, without 0."""
    found = []

    def extend(prefix: list[int], left: int) -> None:
        if len(prefix) == lanes:
            found.append(prefix)
            return
        for d in range(-left, left + 1):
            extend([*prefix, d], left - abs(d))

    extend([], radius)
    return sorted(n for n in (sum(d * base ** (lanes - 1 - k) for k, d in enumerate(v)) for v in found) if n > 0)


def _compare(owners: np.ndarray, owner_ids: np.ndarray, probes: np.ndarray, probe_ids: np.ndarray, radius: int, links: Links, block: int = 1024) -> None:
    for i in range(0, len(owners), block):
        mine = owners[i : i + block, None]
        for j in range(0, len(probes), block):
            r, c = np.nonzero(np.bitwise_count(mine ^ probes[None, j : j + block]) <= radius)
            links.add(owner_ids[i + r], probe_ids[j + c])


@tidy
def _tiles(batches, radius: int):
    """Rows come sorted by tile, owners before probes; holds one tile's owners and one batch of probes at a time."""
    links, key = Links(), None
    own: list[np.ndarray] = []
    own_ids: list[np.ndarray] = []
    for batch in batches:
        cell, part, probe, fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(cell)]):
            if s == e:
                continue
            if key != (cell[s], part[s]):
                key, own, own_ids = (cell[s], part[s]), [], []
            cut = s + int(np.searchsorted(probe[s:e], 1))
            if cut > s:
                for f, i in zip(own, own_ids):
                    _compare(f, i, fp[s:cut], rep[s:cut], radius, links)
                _compare(fp[s:cut], rep[s:cut], fp[s:cut], rep[s:cut], radius, links)
                own.append(fp[s:cut])
                own_ids.append(rep[s:cut])
            if cut < e and own:
                for f, i in zip(own, own_ids):
                    _compare(f, i, fp[cut:e], rep[cut:e], radius, links)
    a, b = links.edges()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])


def hamming_links(prints: DataFrame, radius: int = 2, tile: int = 8192, lanes: int | None = None) -> DataFrame:
    """(src, dst): spanning forests of all links between distinct fingerprints at ``radius`` or fewer differing bits.

    ``prints`` has distinct ``fp`` and a ``rep`` that stands for each. More fingerprints are cut into more lanes, so that a
    tile meets a vanishing share of all; every choice gives the same links.
    """
    if lanes is None:
        n = prints.count()
        lanes = 4 if n <= 1 << 24 else 8 if n <= 1 << 33 else 16
    base = 64 // lanes + 1 + radius  # wide enough that a step never runs over into the next lane
    counts = _lane_counts(lanes)
    cell = F.lit(0).cast("long")
    for c in counts:
        cell = cell * F.lit(base).cast("long") + c
    cells = prints.select("fp", "rep", cell.alias("cell"))
    hot = cells.groupBy("cell").count().filter(F.col("count") > tile).select("cell", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    steps = F.array(*[F.lit(s).cast("long") for s in _steps(lanes, radius, base)])
    probes = cells.select("fp", "rep", F.lit(-1).alias("own_part"), F.explode(F.transform(steps, lambda s: F.col("cell") - s)).alias("cell"))
    if hot.isEmpty():
        owners = cells.select("cell", F.lit(0).alias("part"), F.lit(0).alias("probe"), "fp", "rep")
        met = probes.select("cell", F.lit(0).alias("part"), F.lit(1).alias("probe"), "fp", "rep")
    else:
        parts = F.coalesce("parts", F.lit(1))
        split = cells.join(hot, "cell", "left").withColumn("own_part", F.pmod(F.xxhash64("fp"), parts).cast("int"))
        owners = split.select("cell", F.col("own_part").alias("part"), F.lit(0).alias("probe"), "fp", "rep")
        same = split.filter("own_part > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("own_part") - 1)).alias("part"), F.lit(1).alias("probe"), "fp", "rep")
        met = probes.join(hot, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("probe"), "fp", "rep").union(same)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = owners.union(met).repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "probe")
    return dealt.mapInArrow(partial(_tiles, radius=radius), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest id reachable over links."""
    rows = written(simhash(docs, id_col, text_col, shingle), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct")
    found = connected_components(hamming_links(prints.filter("rep is not null").select("fp", "rep"), radius))
    classes = written(prints.join(found, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "classes")
    return join_unique(rows, classes, "fp", "n", rows.count()).select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which one stays for each class: that of the smallest id (rows without id stay)."""
    gone = near_duplicates(docs, id_col, text_col, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(gone, id_col, "left_anti")
    return kept.select(*docs.columns)
