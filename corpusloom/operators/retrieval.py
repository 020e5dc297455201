"""Vector search over a collection, passage deduplication and the score gate.

Queries are written once, in blocks of a bounded number of vectors, as files that tasks read; the driver never holds them. Each
task multiplies every block with its part of the collection and keeps the best few of each part for each query, and the exact
order among those is settled by a window that needs ``k`` rows for each query and part. The collection is read once and never
shuffled, whatever its size and however many queries there are.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import opened, shared_folder

K, OVER_FETCH, MARGIN, DIGITS = 5, 10, 0.05, 6


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(vector: Column) -> Column:
    """A vector of length 1; the zero vector raises."""
    n = l2_norm(vector)
    return F.when(n == 0, F.raise_error(F.lit("a zero vector has no direction"))).otherwise(F.transform(vector, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity as an expression, for pairs that are there already."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (l2_norm(a) * l2_norm(b))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def write_blocks(asked: DataFrame, folder: str, sizes: dict[int, int], block: int) -> dict[int, list[int]]:
    """Write rows (cell, id, vector) as Arrow files of about ``block`` rows; the numbers of each cell's blocks. ``sizes``: rows of each cell."""
    parts = {cell: -(-n // block) for cell, n in sizes.items()}
    if not parts:
        return {}
    of = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("cell")]
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id"), of).cast("int")).select("cell", "block", "id", "vector")
    tasks = min(sum(parts.values()), int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = numbered.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", "id")
    found: dict[int, list[int]] = {}
    for cell, number in sorted(map(tuple, dealt.mapInArrow(partial(_write, folder=folder), "cell int, block int").collect())):
        found.setdefault(cell, []).append(number)
    return found


def _write(batches, folder: str):
    """Rows sorted by cell and block: a file for each of them."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    now, held = None, []

    def close():
        with fs.open_output_stream(f"{path}/block-{now[0]}-{now[1]}") as out, pa.ipc.new_stream(out, held[0].schema) as writer:
            for part in held:
                writer.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in now], names=["cell", "block"])

    for batch in batches:
        keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for s, e in zip(edges[:-1], edges[1:]):
            if s == e:
                continue
            if now is not None and tuple(keys[s]) != now:
                yield close()
                held = []
            now = tuple(keys[s].tolist())
            held.append(batch.slice(s, e - s).select([2, 3]))
    if held:
        yield close()


class Blocks:
    """Blocks of queries as a task reads them; the last few stay in memory."""

    def __init__(self, folder: str, parts: dict[int, list[int]], held: int = 32):
        self.folder, self.parts, self.held = folder, parts, held
        self.open: OrderedDict[tuple[int, int], tuple[pa.Array, np.ndarray]] = OrderedDict()

    def of(self, cell: int):
        """(ids, matrix) of each block that looks at a cell."""
        for n in self.parts.get(cell, ()):
            if (cell, n) not in self.open:
                fs, path = opened(self.folder)
                with fs.open_input_stream(f"{path}/block-{cell}-{n}") as file:
                    table = pa.ipc.open_stream(file).read_all().combine_chunks()
                self.open[cell, n] = (table.column(0).combine_chunks(), _matrix(table.column(1).combine_chunks()))
                while len(self.open) > self.held:
                    self.open.popitem(last=False)
            self.open.move_to_end((cell, n))
            yield self.open[cell, n]


def _search(batches, folder: str, parts: dict[int, list[int]], k: int, skip_self: bool, numbers: int = 4_000_000):
    """Rows (cell, id, vector): for each query that looks at a cell the best k of each part of it, and all that tie with the last after rounding."""
    blocks, held, size = Blocks(folder, parts), {}, 0

    def flush():
        for cell, rows in held.items():
            table = pa.Table.from_batches(rows).combine_chunks()
            ids, matrix = table.column(0).combine_chunks(), _matrix(table.column(1).combine_chunks())
            plain = ids.to_numpy(zero_copy_only=False)
            for query_ids, queries in blocks.of(cell):
                asked, best = query_ids.to_numpy(zero_copy_only=False), []
                for at in range(0, len(plain), 2048):
                    scores = queries @ matrix[at : at + 2048].T
                    if skip_self:
                        scores[asked[:, None] == plain[None, at : at + 2048]] = -2
                    n = min(k, scores.shape[1])
                    floor = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n] - 2 * 10.0**-DIGITS
                    q, c = np.nonzero((scores >= floor) & (scores > -2))
                    best.append((q, c + at, scores[q, c]))
                q, c, scores = _cut(best, k)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), ids.take(pa.array(c)), pa.array(scores)], names=["query_id", "id", "raw"])
        held.clear()

    for batch in batches:
        cells = batch.column(0).to_numpy(zero_copy_only=False)
        order = pa.array(np.argsort(cells, kind="stable"))
        sorted_batch, cells = batch.take(order), np.sort(cells)
        for at in range(0, batch.num_rows, 4096):
            part, own = sorted_batch.slice(at, 4096), cells[at : at + 4096]
            for cell in np.unique(own).tolist():
                s, e = np.searchsorted(own, [cell, cell + 1])
                held.setdefault(cell, []).append(part.slice(s, e - s).select([1, 2]))
            size += len(part.column(2).flatten())
            if size >= numbers:
                yield from flush()
                size = 0
    yield from flush()


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the best k of rows (query_id, id, raw) after rounding, ties by id."""
    scored = found.select("query_id", "id", F.round("raw", DIGITS).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def _cut(parts, k: int):
    q, ids, scores = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((-scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.searchsorted(q, q)
    place = np.arange(len(q)) - first
    kth = scores[np.minimum(first + k - 1, np.searchsorted(q, q, "right") - 1)]
    keep = (place < k) | (scores >= kth - 2 * 10.0**-DIGITS)
    return q[keep], ids[keep], scores[keep]


def top_k(queries: DataFrame, collection: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False, block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): for each query the k rows with the highest cosine (rounded), ties by id.

    ``queries`` may be of any size; null ids and vectors match nothing.
    """
    spark, there = collection.sparkSession, F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    rows = collection.filter(there).select(F.lit(0).alias("cell"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    asked = queries.filter(there).select(F.lit(0).alias("cell"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    folder, n = shared_folder(spark), asked.count()
    parts = write_blocks(asked, folder, {0: n} if n else {}, block)
    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, rows)]
    if not parts:
        return spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, rank int")
    return ranked(rows.mapInArrow(partial(_search, folder=folder, parts=parts, k=k, skip_self=skip_self), f"query_id {kinds[0]}, id {kinds[1]}, raw double"), k)


def dedup_hits(hits: DataFrame, passage_hash: str, k: int = K, query: str = "query_id", id_col: str = "id") -> DataFrame:
    """Of hits with one passage the best stays; they are ranked anew and cut at k.

    Adds duplicate_ids (the hits that a kept one stands for, in their order) and duplicates_dropped (over all hits of the query).
    """
    order = [F.desc("score"), F.col(id_col)]
    same = W.partitionBy(query, passage_hash)
    nth = hits.withColumn("nth", F.row_number().over(same.orderBy(*order)))
    ids = F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"))).over(same)
    kept = nth.withColumn("all", F.array_sort(ids)).filter("nth = 1").withColumn("duplicate_ids", F.slice(F.transform("all", lambda x: x["i"]), 2, 1 << 30))
    per = W.partitionBy(query)
    ranked = kept.withColumn("duplicates_dropped", F.sum(F.size("duplicate_ids")).over(per).cast("long")).withColumn("rank", F.row_number().over(per.orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).drop("nth", "all")


def gate(top1: Column, threshold: float) -> Column:
    """Whether the gate closes: strictly below the threshold; without any score it closes too."""
    return F.coalesce(top1 < threshold, F.lit(True))


def tuned_threshold(top1: DataFrame, answerable: Column, score: str = "top1_score", margin: float = MARGIN) -> DataFrame:
    """One row: the lowest top score of an answerable query less a margin, and how many queries that gates."""
    low = top1.agg(F.round(F.min(F.when(answerable, F.col(score))) - margin, 4)).first()[0]
    threshold, shut = F.lit(low).cast("double"), F.col(score) < F.lit(low)
    return top1.agg(F.first(threshold).alias("threshold"), F.count_if(shut).alias("n_gated"), F.count_if(answerable & shut).alias("n_gated_answerable"))
