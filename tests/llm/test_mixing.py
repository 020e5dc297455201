import math
from collections import defaultdict
from hashlib import md5

import pytest

from corpusloom.llm import mixing, queries
from tests.oracle import connect, same

WIDE = "doc_id long, text string, source string, start long, target string, words long, run long, src string"


def shares(sizes, weights, share=1.5, repeats=2):
    """Targets by sharing what is above the most of a source again, until none is."""
    capped, target = {}, {}
    while True:
        free = [s for s in sizes if s not in capped]
        left, total = share * sum(sizes.values()) - sum(capped.values()), sum(weights[s] for s in free)
        target = {s: left * weights[s] / total for s in free}
        over = [s for s in free if target[s] >= repeats * sizes[s]]
        if not over:
            return target | capped
        capped |= {s: float(repeats * sizes[s]) for s in over}


def test_query_equals_sql(spark, data):
    same(queries.op11_mixing(spark, data), connect(data), queries.OP11_SQL)


def test_targets_and_prefixes(spark, docs):
    rows = [(i, " ".join(f"w{i}" for _ in range(1 + (i * 7919) % (2000 if i % 50 == 0 else 90))), None if i % 11 == 0 else f"s{'🙂' if i % 7 == 0 else i % 5}") for i in range(600)]
    found = mixing.mix(docs([(*r, 0, "t", 0, 0, "x") for r in rows], WIDE))
    out = found.documents.collect()
    assert sorted(r.doc_id for r in out) == list(range(600))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be"))))}
    want = shares(sizes, weights)
    taken = defaultdict(int)
    for r in out:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= len(sizes) for s in sizes) and sum(taken.values()) == int(1.5 * sum(sizes.values()))
    # by hand: each source's queue is its shuffled documents, twice; the mix has a prefix of it
    queue = defaultdict(list)
    for i, text, source in sorted(rows, key=lambda r: md5(f"mix:{r[0]}:{r[1]}".encode()).hexdigest()):
        queue[source].append((i, len(text.split())))
    got = {r.doc_id: r.taken for r in out}
    for source, items in queue.items():
        left, mine = taken[source], defaultdict(int)
        for i, n in items * 2:
            mine[i] += min(n, left)
            left -= min(n, left)
        assert all(got[i] == mine[i] for i, _ in items)
    packets = found.packets.collect()
    assert sum(p.words for p in packets) == sum(taken.values())
    assert sum(not math.isclose(p.finish, p.stop / want[p.source]) for p in packets) <= 1  # the one that the budget cuts
    whole = [p for p in packets if p.finish <= 1]
    assert sum(p.words for p in whole) >= sum(taken.values()) - len(sizes)  # the order is fair: all but a word of each source by time 1


@pytest.mark.parametrize("run", [1000, 7])
def test_equal_rows_and_nulls(spark, docs, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN", run)
    rows = [(None, None, None)] * 30 + [(None, "a b c", "x")] * 50 + [(1, "a b c", "x")] * 20 + [(2, " \t\n", "y"), (3, "", "y")] + [(4, "word " * 40000, "z"), (5, "one", "z")]
    out = mixing.mix(docs([(*r, 0, "t", 0, 0, "x") for r in rows], WIDE)).documents.collect()
    assert len(out) == len(rows)
    sums = defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        sums[r.source][0] += r.taken
        sums[r.source][1] = r.source_size
        sums[r.source][2] = r.target
    assert sums[None] == [0, 0, 0.0] and sums["y"] == [0, 0, 0.0]
    assert all(abs(t - target) <= 4 for t, _, target in sums.values())
    assert sum(s[0] for s in sums.values()) == int(1.5 * (210 + 40001))


def test_buckets_and_runs_change_nothing(spark, data, monkeypatch):
    want = sorted(map(tuple, queries.op11_mixing(spark, data).collect()))
    monkeypatch.setattr(mixing, "BUCKET", 3)
    assert sorted(map(tuple, queries.op11_mixing(spark, data).collect())) == want


def test_empty_and_given_weights(spark, docs):
    none = docs([], "doc_id string, text string, source string")
    assert mixing.mix(none).documents.count() == 0 and mixing.mix(none).packets.count() == 0
    assert mixing.mix(docs([("a", None, "s")], none.schema)).documents.collect()[0].taken == 0
    given = docs([("s", 3.0), (None, 1.0)], "source string, weight double")
    rows = [(f"{k}{i}", "a b c d", k) for k in ("s", None, "other") for i in range(100)]
    out = mixing.mix(docs(rows, none.schema), weight_of=given, share=0.5).documents.collect()
    assert {k: sum(r.taken for r in out if r.source == k) for k in ("s", None, "other")} == {"s": 450, None: 150, "other": 0}


def test_native(spark, data):
    found = mixing.mix(spark.read.parquet(f"{data}/documents.parquet"))
    for df in found:
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
