import math
import random
import re
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ranges as G
from corpusloom.operators.chunking import section_at
from corpusloom.operators.evaluation import latency_summary


def hot(n=3000, seed=1):
    """Rows (g, k, v): one group has nine tenths of them; some groups are null."""
    rng = random.Random(seed)
    return [(("hot", None, "a", "b")[0 if rng.random() < 0.9 else rng.randrange(4)], k, rng.choice([None, *range(-5, 40)])) for k in range(n)]


def groups(rows):
    out = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((k, v))
    return out


def test_sums_carried_and_next_values(spark):
    rows = hot()
    df = spark.createDataFrame(rows, "group string, part long, before long").repartition(6)
    found = G.Ranges(df, ["group"], ["part"], parts=9).running_sum("before", "up_to").carried("before", "last").next("before", "following").total("before", "all").done()
    assert found.columns == ["group", "part", "before", "up_to", "last", "following", "all"]
    got = {(r.group, r.part): (r.up_to or 0, r.last, r.following, r["all"]) for r in found.collect()}
    want = {}
    for g, line in groups(rows).items():
        sums = list(accumulate(v or 0 for _, v in line))
        carried = list(accumulate((v for _, v in line), lambda a, b: a if b is None else b))
        for i, (k, _) in enumerate(line):
            want[g, k] = (sums[i], carried[i], line[i + 1][1] if i + 1 < len(line) else None, sums[-1])
    assert got == want


def test_no_task_has_a_hot_group(spark):
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, 'x', 'hot') as g", "id as k", "1 as v")
    held = G.Ranges(df, ["g"], ["k"], parts=16)
    sizes = [r.n for r in held.rows.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 14 and max(sizes) < 4000
    plan = held.running_sum("v", "s").done()._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(group#\d+, \d+\).*\n.*Scan", plan)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_nearest_ranks(spark, by):
    rows = hot(1500, 3)
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {tuple(r[c] for c in by): tuple(r[n] for n in ("a", "b", "c", "d")) for r in G.nearest_ranks(df, "v", {"a": 0.5, "b": 0.95, "c": 0.0001, "d": 1.0}, *by).collect()}
    want = {}
    for g, line in (groups(rows) if by else {(): [(k, v) for _, k, v in rows]}).items():
        values = sorted(v for _, v in line if v is not None)
        want[(g,) if by else ()] = tuple(values[max(1, math.ceil(p * len(values))) - 1] for p in (0.5, 0.95, 0.0001, 1.0))
    assert got == want


def test_summary_of_null_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "p", 3.0), (None, "p", 1.0), ("x", None, None), ("y", "q", 2.0)], "a string, b string, ms double")
    assert {tuple(r) for r in latency_summary(df, "ms", "a", "b").collect()} == {(None, "p", 2, 2.0, 1.0, 3.0, 3.0), ("y", "q", 1, 2.0, 2.0, 2.0, 2.0)}
    assert latency_summary(df.limit(0), "ms", "a").count() == 0 and [tuple(r) for r in latency_summary(df, "ms").collect()] == [(3, 2.0, 2.0, 3.0, 3.0)]


def test_as_of_join(spark):
    rng = random.Random(2)
    left = [(rng.choice(["hot", "hot", "hot", "x", None]), rng.randrange(1000), i) for i in range(800)]
    right = [(rng.choice(["hot", "hot", "x", None]), at, f"s{at}") for at in rng.sample(range(1000), 300)]
    a, b = spark.createDataFrame(left, "key string, kind int, row int"), spark.createDataFrame(right, "key string, said int, tie string")
    got = {r.row: (r.found.said, r.found.tie) if r.found else None for r in G.last_before(a, b, "key", "kind", "said", "found").collect()}
    for g, at, i in left:
        best = max(((s, t) for k, s, t in right if k == g and s <= at), default=None)
        assert got[i] == best
    assert G.last_before(a.limit(0), b, "key", "kind", "said", "found").count() == 0 and G.last_before(a, b.limit(0), "key", "kind", "said", "found").filter("found is null").count() == 800
    assert section_at(a, b, "key", "kind", "said").columns == ["key", "kind", "row", "section"]


def test_steps(spark):
    df = spark.createDataFrame([("a", 0), ("b", 7), ("c", 25_000), ("d", -3)], "k string, n long")
    got = {k: sorted(r.at for r in rows) for k, rows in ((k, [r for r in G.steps(df, "n", 3, "at", chunk=100).collect() if r.k == k]) for k in "abcd")}
    assert got == {"a": [0], "b": [0, 3, 6], "c": list(range(0, 25_001, 3)), "d": [0]}
