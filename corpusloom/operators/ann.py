"""Approximate vector search over a stored index: an inverted file of k-means cells.

Cells are fitted on a bounded sample (``sample`` rows, those of the least hashes of their ids, so the same at any layout), and
every row of the collection is assigned to its nearest cell and stored in that cell's folder. A search looks at the ``probes``
cells nearest to each query: only their folders are read, and the hits are scored by exact cosine. With as many probes as cells
the result is that of ``retrieval.top_k``.

Defined results: rows with a null id or vector are not in the index; a zero vector has cosine 0 with all; empty collections
make an index that finds nothing. A manifest, written last, names what the index was made of; opening it with another
expectation raises.
"""

from __future__ import annotations

import io
import json
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import opened, shared_folder, stored
from .retrieval import _matrix, _search, ranked, write_blocks


def cells_of(vectors: np.ndarray, cells: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means over unit vectors; a cell that gets empty takes the vector that lies worst."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        scores = vectors @ centres.T
        own, near = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        sizes = np.linalg.norm(sums, axis=1)
        for empty in np.flatnonzero(sizes == 0):
            worst = int(near.argmin())
            sums[empty], near[worst] = vectors[worst], np.inf
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(sizes == 0, 1, sizes)
    return centres


def _assigned(batches, centres: np.ndarray):
    for batch in batches:
        near = [(_matrix(batch.slice(at, 4096).column(1)) @ centres.T).argmax(axis=1) for at in range(0, batch.num_rows, 4096)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(near or [np.empty(0)]).astype(np.int32)), *batch.columns], names=["cell", "id", "vector"])


def build(collection: DataFrame, path: str, cells: int = 64, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding", describe: dict | None = None) -> dict:
    """Write the index of ``collection`` to a new folder; its manifest."""
    rows = collection.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    centres = cells_of(_matrix(some), cells) if len(some) else np.zeros((1, 1))
    kind = {c: t.dataType.simpleString() for c, t in zip(rows.columns, rows.schema)}
    rows.mapInArrow(partial(_assigned, centres=centres), f"cell int, id {kind['id']}, vector {kind['vector']}").write.partitionBy("cell").parquet(f"{path}/rows")
    fs, folder = opened(path)
    data = io.BytesIO()
    np.save(data, centres)
    with fs.open_output_stream(f"{folder}/centres.npy") as out:
        out.write(data.getvalue())
    manifest = {"format": 1, "space": "cosine", "cells": len(centres), "dimension": int(centres.shape[1]), "rows": rows.count(), "id": kind["id"], "vector": kind["vector"], **(describe or {})}
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def manifest_of(path: str, **expected) -> dict:
    """The manifest of a finished index; what it doesn't agree on with ``expected`` raises."""
    fs, folder = opened(path)
    try:
        with fs.open_input_stream(f"{folder}/manifest.json") as file:
            found = json.loads(file.read())
    except FileNotFoundError as e:
        raise ValueError(f"{path} holds no finished index") from e
    if other := {k: (found.get(k), v) for k, v in expected.items() if found.get(k) != v}:
        raise ValueError(f"the index has other metadata (has, wanted): {other}")
    return found


def _nearest_cells(batches, centres: np.ndarray, probes: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            near = np.argsort(-(_matrix(part.column(1)) @ centres.T), axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(len(near)), near.shape[1])
            taken = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *taken.columns], names=["cell", "id", "vector"])


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False, block: int = 2048, **expected) -> DataFrame:
    """(query_id, id, score, rank): the best k of the cells near each query. ``expected``: what the manifest has to say."""
    manifest = manifest_of(path, **expected)
    fs, folder = opened(path)
    with fs.open_input_stream(f"{folder}/centres.npy") as file:
        centres = np.load(io.BytesIO(file.read()))
    asked = queries.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = {c: t.dataType.simpleString() for c, t in zip(asked.columns, asked.schema)}
    shape = f"query_id {kind['id']}, id {manifest['id']}, raw double"
    if not manifest["rows"]:
        return ranked(spark.createDataFrame([], shape), k)
    sent = stored(asked.mapInArrow(partial(_nearest_cells, centres=centres, probes=min(probes, len(centres))), f"cell int, id {kind['id']}, vector {kind['vector']}"), "asked")
    sizes = {r.cell: r.n for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell at most
    if not sizes:
        return ranked(spark.createDataFrame([], shape), k)
    blocks = shared_folder(spark)
    parts = write_blocks(sent, blocks, sizes, block)
    rows = spark.read.schema(f"id {manifest['id']}, vector {manifest['vector']}, cell int").parquet(f"{path}/rows").filter(F.col("cell").isin(sorted(sizes))).select("cell", "id", "vector")
    return ranked(rows.mapInArrow(partial(_search, folder=blocks, parts=parts, k=k, skip_self=skip_self), shape), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n_queries, n_true, n_found): of the hits in ``exact``, how many ``found`` has."""
    keys = ["query_id", "id"]
    both = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
