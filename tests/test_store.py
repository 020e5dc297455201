import json
import threading

import pytest

from corpusloom.sources import records as L
from corpusloom.sources import store

SHAPE = "chunk_id string, v int"


def rows_of(spark, ids, v):
    return spark.createDataFrame([(i, v) for i in ids], SHAPE)


def test_metadata_is_checked_on_open_and_write(spark, tmp_path):
    path = str(tmp_path / "c")
    store.upsert(spark, path, rows_of(spark, ["a", "b"], 1), buckets=4, describe={"model": "m1", "space": "cosine"})
    assert store.collection(spark, path, model="m1", space="cosine", buckets=4).count() == 2
    for wrong in ({"model": "m2"}, {"space": None}, {"buckets": 8}, {"dimension": 3}):
        with pytest.raises(ValueError, match="other metadata"):
            store.collection(spark, path, **wrong)
    with pytest.raises(ValueError, match="other metadata"):
        store.upsert(spark, path, rows_of(spark, ["c"], 1), describe={"model": "m2"})
    manifest = store.described(spark, path)
    assert manifest["commit"] == 1 and manifest["describe"] == {"model": "m1", "space": "cosine"} and [f["name"] for f in manifest["schema"]["fields"]] == ["chunk_id", "v"]


def test_two_writers_lose_no_row(spark, tmp_path):
    path = str(tmp_path / "c")
    store.upsert(spark, path, rows_of(spark, ["start"], 0), buckets=2)  # so that both touch the same buckets
    failed, gate = [], threading.Barrier(3)

    def write(name):
        try:
            gate.wait()
            for n in range(3):
                store.upsert(spark, path, rows_of(spark, [f"{name}{n}{i}" for i in range(10)], n))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(name,)) for name in "xyz"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = sorted(r.chunk_id for r in store.collection(spark, path).collect())
    assert got == sorted(["start", *(f"{name}{n}{i}" for name in "xyz" for n in range(3) for i in range(10))])
    assert store.described(spark, path)["commit"] == 10


def test_vacuum(spark, tmp_path):
    path = str(tmp_path / "c")
    for v in range(4):
        store.upsert(spark, path, rows_of(spark, ["a", f"k{v}"], v), buckets=1)
    assert store.vacuum(spark, path) == []  # too young
    (tmp_path / "c" / "v00000009").mkdir()  # of a writer at work
    assert store.vacuum(spark, path, keep=2, older=0) == [1, 2] and store.vacuum(spark, path, older=0) == [3]
    assert sorted((r.chunk_id, r.v) for r in store.collection(spark, path).collect()) == [("a", 3), *((f"k{v}", v) for v in range(4))]
    assert (tmp_path / "c" / "v00000009").exists() and store.vacuum(spark, str(tmp_path / "none")) == []


RECORD = "k int, v string, nested struct<a: array<double>>"


def test_record_lines(spark, tmp_path):
    L.register(spark)
    lines = [{"k": i, "v": "é" * (i % 50), "nested": {"a": [i / 2]}, "other": 1} for i in range(500)]
    raw = "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode()
    (tmp_path / "a.jsonl").write_bytes(raw[: len(raw) // 2].rpartition(b"\n")[0] + b"\n" + b'{"k": 1, "v": "torn')
    rest = raw[len(raw[: len(raw) // 2].rpartition(b"\n")[0]) + 1 :]
    (tmp_path / "b.json").write_bytes(b"\n" + rest + b'{"k"')
    (tmp_path / "_c.json").write_bytes(b"not read")
    for size in (1 << 24, 700):
        df = spark.read.format("record_lines").schema(RECORD).option("rangeBytes", size).load(str(tmp_path))
        assert sorted((r.k, r.v, r.nested.a[0]) for r in df.collect()) == [(i, "é" * (i % 50), i / 2) for i in range(500)]
        assert size > 1000 or df.rdd.getNumPartitions() > 20
    assert spark.read.format("record_lines").schema(RECORD).load(str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("line", [b"{broken", b"[1]", b'{"k": "text"}', b"\xff\xfe"])
def test_broken_whole_lines_raise(spark, tmp_path, line):
    L.register(spark)
    (tmp_path / "a.jsonl").write_bytes(b'{"k": 1}\n' + line + b"\n")
    with pytest.raises(Exception, match="a.jsonl at byte 9"):
        spark.read.format("record_lines").schema(RECORD).load(str(tmp_path)).collect()


def test_stream_over_a_log_with_a_torn_tail(spark, tmp_path):
    L.register(spark)
    log, out = tmp_path / "in" / "log.jsonl", tmp_path / "out"
    log.parent.mkdir()

    def step(data):
        with open(log, "ab") as f:
            f.write(data)
        stream = spark.readStream.format("record_lines").schema("k int").load(str(log.parent))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.k for r in spark.read.schema("k int").parquet(str(out)).collect())

    assert step(b'{"k": 1}\n{"k": 2}\n{"k"') == [1, 2]
    assert step(b': 3}\n{"k": 4}\n') == [1, 2, 3, 4]
    assert step(b"") == [1, 2, 3, 4]


def test_released_calls_equal_the_window(spark, tmp_path):
    import random

    from corpusloom.streaming import throttle

    rng, folder = random.Random(5), tmp_path / "calls"
    folder.mkdir()
    calls = sorted((rng.random() * 300, i, rng.choice("abc"), rng.choice([5, 20, 60, 500])) for i in range(120))
    want = {}
    for name in "abc":
        now = [0.0]
        window = throttle.SlidingWindow(4, 100, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
        for at, i, client, n in calls:
            if client == name:
                now[0] = max(now[0], at)
                if n <= 100:
                    window.acquire(n)
                want[i] = now[0] if n <= 100 else None
    for part in (calls[:70], calls[70:]):  # the state goes on from one run to the next
        (folder / f"{part[0][1]}.json").write_text("".join(json.dumps(dict(zip(("requested_at", "call_id", "client", "tokens"), c))) + "\n" for c in part))
        stream = throttle.released(spark.readStream.schema("client string, call_id long, requested_at double, tokens long").json(str(folder)), 4, 100)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 120 and {r.call_id: r.released_at and round(r.released_at, 6) for r in rows} == {i: t and round(t, 6) for i, t in want.items()}


def test_references_without_a_section_raise(spark):
    from corpusloom.operators.evaluation import spans_from_index

    index = spark.createDataFrame([("p", "A > B", 1, 0, 5), ("p", "A > B", 2, 5, 9)], "source_id string, heading_path string, variant int, char_start long, char_end long")
    refs = spark.createDataFrame([(1, "S1", "expected", "p", "A > B", None), (2, "S1", "expected", "p", "A > B", 2)], "case_id long, slot string, role string, source_id string, heading_path string, variant int")
    assert sorted((r.case_id, r.char_start) for r in spans_from_index(refs, index, "case_id").collect()) == [(1, 0), (1, 5), (2, 5)]
    with pytest.raises(Exception, match="no section for 3 p A > C"):
        spans_from_index(spark.createDataFrame([(3, "S1", "expected", "p", "A > C", None)], refs.schema), index, "case_id").collect()
