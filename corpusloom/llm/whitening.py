"""Operator 12: whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed. One Spark pass computes Xᵀ(XQ) for a block Q of directions, over rows that are centred before
they are multiplied; tasks send sums of the size of the block, which a grouped sum adds up by cell. After each pass the new
block is made orthonormal against the directions so far (QR), and Rayleigh-Ritz on all of them gives the best components;
their residuals open the next block. Blocks of earlier passes are kept (at most ``span`` directions, then the best go on), as
power steps alone would need hundreds of passes where eigenvalues lie close. Passes end when the residuals of all k components
are below ``tolerance`` of the largest eigenvalue, or rounding keeps them from falling; a last pass over the components
themselves certifies them: it gives the eigenvalues, residuals and the covariance of the whitened rows that are reported.

An entry c is the whole number x = floor(scale * c) + shift, so counts, sums and deviations are exact. What is on the driver:
the sums of a dimension each, and dimension times ``span`` numbers.

Defined results: rows whose vector is null, empty, or has null, non-finite or huge entries (2^40 or more) are dropped; so are
those of another length than most vectors have (the longer of ties). Components without variance (under ``RANK`` of the
largest eigenvalue) don't exist: equal rows alone, or an empty table, give no rows. Ids may be null, of any type and repeated:
each row is whitened by itself. Other columns are ignored. Deviations over 64 bits need ``wide``.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

RANK = 1e-12
_HUGE = float(1 << 40)


class Fit(NamedTuple):
    """What whitens: n rows with sums of each dimension, components as columns, their eigenvalues; how good they are."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int



def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> tuple[DataFrame, int]:
    """((id, x array<long>), dimension): the rows that count, as whole numbers."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < _HUGE, F.lit(False))))  # a NaN is larger than any number
    x = written(kept.select("id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x")), "vectors")
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    return x.filter(F.size("x") == d), d


@tidy
def _sums(batches, d: int):
    n, total = 0, np.zeros(d, object)
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
        n += len(x)
        for part in np.array_split(x, max(1, len(x) // 4096)):  # 2^12 entries under 2^51 fit
            total += part.sum(axis=0).astype(object)
    yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(t) for t in total], pa.string())], names=["cell", "n", "total"])


@tidy
def _products(batches, mean: np.ndarray, q: np.ndarray):
    """Cells of Xᵀ(XQ), then of (XQ)ᵀ(XQ), then the sums of XQ, over a task's centred rows."""
    d, b = q.shape
    y, gram, sums = np.zeros((d, b)), np.zeros((b, b)), np.zeros(b)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d) - mean
            p = x @ q
            y += x.T @ p
            gram += p.T @ p
            sums += p.sum(axis=0)
    cells = np.concatenate([y.ravel(), gram.ravel(), sums])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "value"])


def products(x: DataFrame, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass: Xᵀ(XQ), (XQ)ᵀ(XQ) and the sums of XQ, of centred rows."""
    d, b = q.shape
    parts = x.select("x").mapInArrow(partial(_products, mean=mean, q=q), "cell int, value double")
    found = parts.groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toArrow()["value"].to_numpy()
    return found[: d * b].reshape(d, b), found[d * b : d * b + b * b].reshape(b, b), found[d * b + b * b :]


def _new_directions(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal block for what ``block`` has outside the basis, without directions that are but rounding."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):  # once more, as the first leaves rounding
        block = block - basis @ (basis.T @ block)
        block, r = np.linalg.qr(block)
        sizes = np.abs(np.diag(r))
        block = block[:, sizes > 1e-10]
    return block


def fit(x: DataFrame, d: int, k: int = 8, extra: int = 8, span: int = 256, tolerance: float = 1e-14, most_passes: int = 500, seed: int = 12) -> Fit:
    """Components 1 to k of the rows ``x`` of dimension ``d``; ``extra`` directions more make a block."""
    columns = x.select("x").mapInArrow(partial(_sums, d=d), "cell int, n long, total string").groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("cell").collect() if d else []
    n, sums = (columns[0].n or 0, [int(c.total or 0) for c in columns]) if columns else (0, [])
    if not n:
        return Fit(0, [0] * d, np.zeros((d, 0)), np.zeros(0), 0.0, np.zeros(0), 0.0, 0)
    mean = np.array([s // n + s % n / n for s in sums])
    span = min(d, max(span, 4 * (k + extra)))
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + extra))))
    basis, images, best, stuck, passes = np.zeros((d, 0)), np.zeros((d, 0)), np.inf, 0, 0
    while True:
        y, _, _ = products(x, mean, q)
        passes += 1
        basis, images = np.hstack([basis, q]), np.hstack([images, y / n])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, images @ turn
        wide = min(len(values), k + extra)
        residual = moved[:, :wide] - ritz[:, :wide] * values[:wide]
        worst = np.linalg.norm(residual[:, :k], axis=0).max()
        stuck = 0 if worst < 0.5 * best else stuck + 1
        best = min(best, worst)
        if worst <= tolerance * values[0] or stuck >= 3 and worst <= 1e-11 * values[0] or values[0] <= 0 or passes >= most_passes:
            break
        if basis.shape[1] + wide > span and basis.shape[1] < d and span < d:
            keep = min(basis.shape[1], 2 * wide)
            basis, images = ritz[:, :keep], moved[:, :keep]
        q = _new_directions(residual, basis)[:, : d - basis.shape[1]]
        if not q.shape[1]:  # the basis holds an invariant subspace: others than these need a fresh start beside it
            q = _new_directions(np.random.default_rng(seed + passes).standard_normal((d, min(wide, d - basis.shape[1]))), basis) if basis.shape[1] < d and (stuck < 3 or len(values) < k) else q
            if not q.shape[1]:
                break
    found, _ = np.linalg.qr(ritz[:, :k])
    found *= np.where(found[np.abs(found).argmax(axis=0), range(found.shape[1])] < 0, -1.0, 1.0)
    y, gram, totals = products(x, mean, found)
    total = trace(x, mean) / n
    values = np.diag(gram) / n
    there = values > RANK * max(values.max(initial=0.0), 0.0)
    found, values, y, gram, totals = found[:, there], values[there], y[:, there], gram[np.ix_(there, there)], totals[there]
    scale = 1 / np.sqrt(values)
    white = (gram / n - np.outer(totals, totals) / n**2) * np.outer(scale, scale)
    error = float(np.abs(white - np.eye(len(values))).max(initial=0.0))
    return Fit(n, sums, found, values, total, np.linalg.norm(y / n - found * values, axis=0), error, passes + 1)


@tidy
def _squares(batches, mean: np.ndarray):
    total = 0.0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(mean)) - mean
            total += float(np.einsum("ij,ij->", x, x))
    yield pa.RecordBatch.from_arrays([pa.array([total])], names=["value"])


def trace(x: DataFrame, mean: np.ndarray) -> float:
    """The sum of squares of all centred entries."""
    return x.select("x").mapInArrow(partial(_squares, mean=mean), "value double").agg(F.sum("value")).first()[0] or 0.0


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2, for each row."""
    if n < 1 << 20 and (np.abs(x).max(initial=0) + 1) < 1 << 40:  # n x and S are under 2^60
        moved = n * x - np.array(sums, np.int64)
        most = int(np.abs(moved).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return (moved * moved).sum(axis=1).tolist()
    wide = np.array(sums, object)
    return [int(((n * row.astype(object) - wide) ** 2).sum()) for row in x]


@tidy
def _whitened(batches, model: Fit):
    k, d = len(model.eigenvalues), len(model.sums)
    mean = np.array([s // model.n + s % model.n / model.n for s in model.sums])
    project = model.components / np.sqrt(model.eigenvalues)
    shares = (model.eigenvalues / model.trace).tolist()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
            m = len(x)
            deviation = pa.array([str(t) for t in deviations(x, model.n, model.sums)], pa.string())
            rows = np.repeat(np.arange(m), k)
            columns = [part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), deviation.take(pa.array(rows)), pa.array(((x - mean) @ project).ravel()), pa.array(shares * m, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "deviation", "whitened", "explained"])


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", wide: bool = False, **options) -> tuple[DataFrame, Fit]:
    """((id, component, n, deviation, whitened, explained, identity_error), fit): a row for each vector and component."""
    x, d = whole_numbers(vectors, id_col, vector_col)
    model = fit(x, d, k, **options)
    kind = x.schema["id"].dataType.simpleString()
    rows = x if len(model.eigenvalues) else x.limit(0)
    found = rows.select("id", "x").mapInArrow(partial(_whitened, model=model), f"id {kind}, component int, deviation string, whitened double, explained double")
    deviation = F.col("deviation").cast("decimal(38,0)" if wide else "long")
    return found.select(F.col("id").alias(id_col), "component", F.lit(model.n).cast("long").alias("n"), deviation.alias("deviation"), "whitened", "explained", F.lit(model.identity_error).alias("identity_error")), model
