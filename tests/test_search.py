import json

import numpy as np
import pytest

from corpusloom.operators import ann as A
from corpusloom.operators import retrieval as R

SHAPE = "vec_id long, embedding array<float>"


def rows_of(n, d=24, seed=0, groups=20):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, d)) * 2
    return [(i, (middle[i % groups] + rng.standard_normal(d)).astype(np.float32).tolist()) for i in range(n)]


def brute(queries, rows, k, skip_self=False):
    unit = lambda rs: np.array([np.array(v, float) / (np.linalg.norm(np.array(v, float)) or 1) for _, v in rs])
    scores = np.round(unit(queries) @ unit(rows).T, 6)
    out = set()
    for (q, _), line in zip(queries, scores):
        best = sorted((-s, i) for s, (i, _) in zip(line, rows) if not (skip_self and i == q))[:k]
        out |= {(q, i, round(-s, 6), n + 1) for n, (s, i) in enumerate(best)}
    return out


def got(df):
    return {(r.query_id, r.id, round(r.score, 6), r.rank) for r in df.collect()}


@pytest.mark.parametrize("block, skip", [(2048, False), (7, True)])
def test_search_in_blocks(spark, block, skip):
    rows = rows_of(500)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    asked = spark.createDataFrame(rows[::9], SHAPE)
    assert got(R.top_k(asked, df, 4, skip_self=skip, block=block)) == brute(rows[::9], rows, 4, skip)


def test_search_reads_the_collection_once(spark):
    rows = rows_of(300)
    df, asked = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(rows[:200], SHAPE)
    plan = R.top_k(asked, df, 3, block=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and len(plan) < 20_000


def test_many_queries_leave_the_driver_flat(spark):
    import resource

    df = spark.range(100_000).selectExpr("id as vec_id", "transform(sequence(0, 63), j -> cast(pmod(xxhash64(id, j), 1000) as float)) as embedding")
    some = df.filter("vec_id < 50")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = R.top_k(df, some, 1)
    assert found.filter("query_id < 50 and id <> query_id").count() == 0
    assert found.count() == 100_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 30_000  # KB; the queries have 25 MB, as matrices 51


def test_edges_of_search(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0, 0.0]), (5, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, "b") for r in rows], f"{SHAPE}, cell string, block int, query_id string")
    assert got(R.top_k(df, df, 2)) == {(1, 1, 1.0, 1), (1, 4, 1.0, 2), (2, 1, 0.0, 1), (2, 2, 0.0, 2), (4, 1, 1.0, 1), (4, 4, 1.0, 2), (5, 1, 1.0, 1), (5, 4, 1.0, 2)}
    assert R.top_k(df.limit(0), df, 2).count() == 0 and R.top_k(df, df.limit(0), 2).count() == 0
    words = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "vec_id string, embedding array<double>")
    assert {(r.query_id, r.id, r.rank) for r in R.top_k(words, words, 1).collect()} == {("a", "a", 1), ("b", "a", 1)}


def test_inverted_file(spark, tmp_path):
    rows = rows_of(3000)
    df, asked = spark.createDataFrame(rows, SHAPE).repartition(4), spark.createDataFrame(rows[::50], SHAPE)
    path = f"file://{tmp_path}/index"
    manifest = A.build(df, path, cells=20, sample=1000, describe={"model": "m1"})
    assert manifest["cells"] == 20 and manifest["rows"] == 3000
    assert spark.read.parquet(f"{path}/rows").count() == 3000
    exact = R.top_k(asked, df, 5)
    assert got(exact) == brute(rows[::50], rows, 5) == got(A.search(spark, path, asked, 5, probes=20, block=6))
    near = A.search(spark, path, asked, 5, probes=4, model="m1", space="cosine")
    row = A.recall(near, exact).first()
    assert row.n_true == 300 and row.n_found >= 270
    one = A.search(spark, path, asked.limit(1), 5, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError, match="other metadata"):
        A.search(spark, path, asked, 5, model="m2")
    with pytest.raises(ValueError, match="no finished index"):
        A.manifest_of(f"file://{tmp_path}/nothing")
    assert json.loads((tmp_path / "index/manifest.json").read_text())["dimension"] == 24


def test_edges_of_the_index(spark, tmp_path):
    none = spark.createDataFrame([(None, [1.0]), (1, None)], SHAPE)
    A.build(none, f"file://{tmp_path}/none", cells=3)
    assert A.search(spark, f"file://{tmp_path}/none", none, 2).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(10)], SHAPE)
    A.build(same, f"file://{tmp_path}/same", cells=4)
    assert {(r.query_id, r.id) for r in A.search(spark, f"file://{tmp_path}/same", same.limit(1), 2, probes=4).collect()} == {(0, 0), (0, 1)}
    assert A.search(spark, f"file://{tmp_path}/same", same.limit(0), 2).count() == 0
