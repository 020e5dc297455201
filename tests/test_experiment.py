import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import experiment as X
from corpusloom.operators import judging as J
from corpusloom.operators import statistics as S
from corpusloom.plans import experiments


def test_draws_are_those_of_random():
    import random

    import numpy as np

    for n in (1, 2, 7, 64, 1000):
        rng = random.Random(42)
        assert np.concatenate(list(S.draws(n, 3000, 42))).tolist() == [rng.randrange(n) for _ in range(3000)]


def test_a_case_is_drawn_once_for_all_its_groups(monkeypatch):
    """Sums are those of weights that follow from the case, however many groups a case is in and however few are held."""
    import numpy as np
    import pyarrow as pa

    rng, made, want = np.random.default_rng(3), [], {}
    philox, drawn = np.random.Philox, []
    for case in range(-75, 75):
        weights = np.random.Generator(philox(key=np.array([case & 0xFFFFFFFFFFFFFFFF, 42], np.uint64))).poisson(1.0, 2500)
        for name in rng.choice(9, rng.integers(1, 9), replace=False):
            d = float(rng.normal())
            made.append((case, f"g{name}", 1, d))
            w = want.setdefault(f"g{name}", np.zeros((2, 2500)))
            w += [weights, weights * d]
    monkeypatch.setattr(np.random, "Philox", lambda key: drawn.append(key[0]) or philox(key=key))
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made[at : at + 100])], names=["c", "g", "n", "d"]) for at in range(0, len(made), 100)]
    for held in (2, 200):
        drawn.clear()
        found = {k: np.zeros((2, 2500)) for k in want}
        for batch in S._weighed(iter(batches), 2500, 42, cases=16, held=held):
            for r in batch.to_pylist():
                found[r["g"]][:, r["place"] : r["place"] + len(r["w"])] += [r["w"], r["wd"]]
        assert len(drawn) == 150 and all(np.allclose(found[k], want[k]) for k in want)


def test_wilcoxon_counts_every_assignment():
    from itertools import product

    a, b = [0.0] * 9, [1.0, -2.0, 3.0, 3.0, -1.0, 5.0, 0.0, 2.5, 4.0]
    kept = [x for x in b if x]
    ranks = S.average_ranks([abs(x) for x in kept])
    low = min(sum(r for r, x in zip(ranks, kept) if x > 0), sum(r for r, x in zip(ranks, kept) if x < 0))
    tail = sum(sum(r for r, s in zip(ranks, signs) if s) <= low for signs in product((0, 1), repeat=len(kept)))
    assert S.wilcoxon(a, b)["p"] == min(1, 2 * tail / 2 ** len(kept))
    assert S.wilcoxon([0.0] * 400, [float((-1) ** k * k) for k in range(400)])["p"] > 0.5


def test_comparison_of_all_metrics(spark, data):
    rows = experiments.compare_all_metrics(spark, data).collect()
    by = {(r.slice, r.metric): r for r in rows}
    assert {r.metric for r in rows if r.slice == "overall"} == set(X.metrics()) and len(X.metrics()) == 32
    binary = [r for r in rows if r.kind == "binary"]
    assert all(r.p == S.mcnemar_p(r.a_only, r.b_only) and r.low <= r.delta <= r.high for r in binary)
    assert by["overall", "latency_total_ms"].p is None and by["overall", "latency_total_ms"].wording.startswith("not tested (")


def test_eligibility_and_overrides(spark, data):
    rows = experiments._rows(spark, data)
    assert X.check_eligible(rows).count() == rows.count()
    with pytest.raises(Exception, match="retrieval metrics of a case without an answer"):
        X.check_eligible(rows.withColumn("section_mrr", F.lit(1.0))).count()
    failures = spark.createDataFrame([(1, "A", "generation")], "case_id long, arm string, stage string")
    with pytest.raises(ValueError, match="not failures"):
        X.apply_overrides(failures, spark.createDataFrame([(2, "A", "ranking", "x")], "case_id long, arm string, stage string, reason string"))


def test_chunk_facts(spark):
    got = spark.createDataFrame([(1, 1, 7, 0, 10, "some text here"), (1, 2, 8, 0, 10, "Some  text")], "case long, rank int, source_id long, char_start int, char_end int, text string")
    spans = spark.createDataFrame([(1, 7, 9, 20), (1, 7, 30, 40)], "case long, source_id long, char_start int, char_end int")
    quotes = spark.createDataFrame([(1, "text  here"), (1, "Some text")], "case long, quote string")
    rows = {r["rank"]: (r.hits_source, r.hits_section, r.n_quotes) for r in X.chunk_facts(got, spans, quotes, ["case"]).collect()}
    assert rows == {1: (True, True, 1), 2: (False, False, 1)}


def test_judging(spark, data):
    plan = experiments.judge_plan(spark, data)
    with pytest.raises(ValueError, match="missing or of something else"):
        J.require_judged(plan)
    J.require_judged(plan.filter("state in ('cached', 'none')"))
    assert J.uncovered(experiments.blueprint_coverage(spark, data)).count() > 0


def test_codecs(spark):
    vector = [0.5, -1.25, 3.0]
    assert J.unpack_floats(J.pack_floats(vector)) == vector and len(J.pack_floats(vector)) == 12
    embed = J.hash_embedder(20)
    assert embed(["a", "b"], "QUERY") == embed(["a", "b"], "QUERY") != embed(["a", "b"], "DOCUMENT") and abs(sum(v * v for v in embed(["a"], "QUERY")[0]) - 1) < 1e-9
    with pytest.raises(ValueError, match="unknown fields"):
        J.projected(spark.range(1), {"other": "int"})
    with pytest.raises(Exception, match="vectors for"):
        J.embed_missing(spark.createDataFrame([("x",)], "text string"), "m", "QUERY", lambda texts, task: []).count()


def test_rater_sheets(spark):
    rows = spark.createDataFrame([(k, arm, f"q{k}", f"a{k}{arm}") for k in range(5) for arm in "AB"], "case_id long, arm string, question string, answer string")
    sheet = J.blind_sheet(rows, 3).collect()
    assert sorted(r.item for r in sheet) == list(range(1, 11)) and [r.item for r in J.blind_sheet(rows.repartition(3), 3).collect()] is not None
    assert {(r.item, r.key) for r in J.blind_sheet(rows.repartition(3), 3).collect()} == {(r.item, r.key) for r in sheet} != {(r.item, r.key) for r in J.blind_sheet(rows, 4).collect()}
    filled = "\n".join(json.dumps({"item": r.item, "label": "correct"}) for r in sheet)
    assert len(J.read_sheet(filled)) == 10
    with pytest.raises(ValueError, match="line 11"):
        J.read_sheet(filled + "\n" + filled)
