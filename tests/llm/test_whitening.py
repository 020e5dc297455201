import math

import numpy as np
import pytest

from corpusloom.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    """Of (id, vector) rows: exact deviations, and whitened values by a full eigendecomposition."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    moved = x * n - sums
    deviation = (moved * moved).sum(axis=1)
    centred = moved.astype(float) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return deviation, centred @ u / np.sqrt(e), e / np.trace(cov)


def agrees(found, rows, k):
    deviation, white, explained = brute(rows, k)
    place = {i: p for p, (i, _) in enumerate(rows)}
    assert len(found) == len(rows) * k
    got = np.zeros((len(rows), k))
    for r in found:
        p, c = place[r.vec_id], r.component - 1
        assert r.n == len(rows) and r.deviation == deviation[p] and abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9
        got[p, c] = r.whitened
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-6


def test_query(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    agrees(queries.op12_whitening(spark, data).collect(), rows, 8)


@pytest.mark.parametrize("span", [256, 40])
def test_many_dimensions_in_blocks(spark, docs, span):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((900, 120)) * np.linspace(2, 0.5, 120)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found, model = whitening.whiten(docs([(*r, 0) for r in rows], VECTORS), k=5, span=span)
    agrees(found.collect(), rows, 5)
    assert model.residuals.max() < 1e-11 * model.eigenvalues[0] and model.identity_error < 1e-9


def test_equal_eigenvalues_and_few_rows(spark, docs):
    rows = [(k, [float(s if j == k // 2 else 0) for j in range(6)]) for k, s in ((2 * j + b, (1, -1)[b]) for j in range(6) for b in (0, 1))]  # a cross: all directions alike
    found, model = whitening.whiten(docs([(*r, 0) for r in rows], VECTORS), k=4)
    z = np.zeros((len(rows), 4))
    for r in found.collect():
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(z.T @ z / len(rows) - np.eye(4)).max() < 1e-9 and np.allclose(model.eigenvalues, model.eigenvalues[0])
    two = docs([(1, [0.0, 0.0, 1.0], 0), (2, [1.0, 0.0, 1.0], 0)], VECTORS)  # one direction has variance
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in whitening.whiten(two)[0].collect()) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_edges(spark, docs):
    nan, wide = float("nan"), "vec_id string, embedding array<double>, id string, x int, n long, component string, deviation int, v int"
    good = [(None, [1.0, 2.0]), ("a", [2.0, 1.0]), ("a", [2.0, 1.0]), ("b", [-3.0, 0.5])]
    bad = [("c", None), ("d", []), ("e", [1.0, None]), ("f", [nan, 1.0]), ("g", [1.0, math.inf]), ("h", [1.0, 2.0, 3.0]), ("i", [1e30, 0.0])]
    found, model = whitening.whiten(docs([(*r, "x", 0, 0, "", 0, 0) for r in good + bad], wide), k=8)
    rows = found.collect()
    assert model.n == 4 and len(rows) == 8 and {r.vec_id for r in rows} == {None, "a", "b"} and {r.component for r in rows} == {1, 2}
    assert len({(r.component, r.whitened, r.deviation) for r in rows if r.vec_id == "a"}) == 2
    for none in (docs([], wide), docs([("a", None, "", 0, 0, "", 0, 0)], wide), docs([("a", [1.0, 1.0], "", 0, 0, "", 0, 0)] * 5, wide)):
        out, model = whitening.whiten(none)
        assert out.count() == 0 and model.identity_error == 0.0


def test_wide_deviations():
    x = np.array([[1 << 30, -(1 << 40)], [0, 7]])
    n, sums = 1 << 40, [3 << 60, -5]
    assert whitening.deviations(x, n, sums) == [(n * (1 << 30) - sums[0]) ** 2 + (-n * (1 << 40) + 5) ** 2, sums[0] ** 2 + (7 * n + 5) ** 2]
    assert whitening.deviations(np.array([[5, 6]]), 2, [9, 12]) == [1]
