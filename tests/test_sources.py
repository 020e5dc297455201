import hashlib
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.operators import validation as V
from corpusloom.operators.evaluation import cost_usd, failure_stage, passage_spans
from corpusloom.operators.markdown import DocumentError
from corpusloom.plans.answering import AnswerError, answer, parse_answer, render, split_template
from corpusloom.sources import documents as D
from corpusloom.sources import html as H
from corpusloom.sources import store
from corpusloom.sources.failures import backoff, classify
from corpusloom.streaming import records, throttle


def test_html():
    title, text = H.to_text("<html><head><title> A  b </title><style>x{}</style></head><body><h1>One</h1><p>a &amp; b<br>c</p><ul><li>d</li></ul><script>no</script></body>")
    assert (title, text) == ("A b", "# One\n\na & b\nc\n\n- d\n") and H.to_text("") == ("", "")


def test_scan(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# Ä\r\n".encode())
    (tmp_path / "b.HTML").write_bytes(b"<title>T</title><p>x</p>")
    rows = sorted(tuple(r)[1:] for r in D.scan(spark, str(tmp_path)).collect())
    assert rows == [("T", "x\n"), ("a", "# Ä\r\n")]
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    with pytest.raises(Exception, match="no reader for .pdf"):
        D.scan(spark, str(tmp_path)).collect()
    with pytest.raises(DocumentError):
        D.default_readers().of("x/noextension")


def test_invalid_bytes_raise(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="a.md"):
        D.scan(spark, str(tmp_path)).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"source_id": "1", "file": "in/a.md"}, {"source_id": "2", "file": "excluded/b.md"}]}))
    rows = D.manifest(spark, str(tmp_path / "m.json"))
    assert rows.filter("source_id = '1'").first().file == "in/a.md"
    with pytest.raises(Exception, match="excluded document"):
        rows.collect()


def test_record_log(spark, tmp_path):
    log = store.RecordLog(str(tmp_path / "r.jsonl"), lambda line: line.replace("secret", "[REDACTED]"))
    assert log.read() == []
    log.append({"k": 1, "v": "secret"})
    with open(log.path, "ab") as f:
        f.write(b'{"k": 1, "v": "torn')
    assert log.read() == [{"k": 1, "v": "[REDACTED]"}]
    log.append({"k": 1, "v": "é"})
    rows = log.frame(spark, "k int, v string")
    assert [tuple(r) for r in store.latest(rows, ["k"]).select("k", "v").collect()] == [(1, "é")]
    with open(log.path, "ab") as f:
        f.write(b"broken\n")
    with pytest.raises(ValueError, match="line 3"):
        log.read()


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "c")
    assert store.collection(spark, path) is None
    make = lambda *rows: spark.createDataFrame(rows, "chunk_id string, chunker_config string, v int")
    store.upsert(spark, path, make(("a", "x", 1), ("b", "x", 1)), config="x")
    store.upsert(spark, path, make(("b", "x", 2), ("c", "x", 2)), config="x")
    assert sorted(tuple(r) for r in store.collection(spark, path).collect()) == [("a", "x", 1), ("b", "x", 2), ("c", "x", 2)]
    with pytest.raises(Exception, match="another configuration"):
        store.upsert(spark, path, make(("d", "y", 1)), config="x")
    assert store.collection(spark, path).count() == 3


def test_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "c")
    make = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "chunk_id string, v int")
    store.upsert(spark, path, make([], 0))
    assert store.collection(spark, path) is None
    want = {}
    for v, ids in enumerate([[f"c{i}" for i in range(200)], ["c7"], ["c7", "c8", "new"], [], [None, "c9"], [None]]):
        store.upsert(spark, path, make(ids, v), buckets=16 if v == 0 else 64)  # a collection keeps its number of buckets
        want |= dict.fromkeys(ids, v)
        got = store.collection(spark, path).collect()
        assert len(got) == len(want) and {r.chunk_id: r.v for r in got} == want
    sizes = [len(list((tmp_path / "c").glob(f"v{n:08d}/*/__bucket=*"))) for n in (1, 2, 3)]
    assert sizes[0] == 16 and sizes[1] == 1 and 1 <= sizes[2] <= 3
    torn = tmp_path / "c" / "v00000009" / "__buckets=16" / "__bucket=0"  # a write that was never committed
    torn.mkdir(parents=True)
    assert store.collection(spark, path).count() == len(want)
    make(["a"], 0).write.parquet(f"{tmp_path}/whole/v00000001")
    with pytest.raises(ValueError, match="not cut into buckets"):
        store.collection(spark, f"{tmp_path}/whole")


def test_cache_split(spark):
    texts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "c")], "seq int, text string")
    cache = texts.filter("text = 'a'").select(store.cache_key(F.lit("m"), F.lit("t"), F.col("text")).alias("key"), F.array(F.lit(1.0)).alias("vector"))
    hits, misses = store.split_by_cache(texts, cache, "m", "t")
    assert [r.text for r in hits.collect()] == ["a"] and sorted((r.seq, r.text) for r in misses.collect()) == [(1, "b"), (3, "c")]


def test_stream_keeps_the_latest(spark, tmp_path):
    folder, schema = tmp_path / "in", "k int, v string, seq long"
    folder.mkdir()

    def step(name, *rows):
        (folder / name).write_text("".join(json.dumps(dict(zip(("k", "v", "seq"), r))) + "\n" for r in rows))
        records.follow(spark, str(folder), schema, str(tmp_path / "t"), str(tmp_path / "cp"), ["k"]).awaitTermination()
        return sorted((r.k, r.v) for r in store.collection(spark, str(tmp_path / "t")).collect())

    assert step("1.json", (1, "a", 0), (1, "b", 1), (2, "x", 2)) == [(1, "b"), (2, "x")]
    assert step("2.json", (2, "old", 1), (1, "c", 3), (3, "n", 4)) == [(1, "c"), (2, "x"), (3, "n")]


def test_throttle():
    now = [0.0]
    window = throttle.SlidingWindow(2, 100, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert [window.acquire(n) for n in (60, 30, 10)] == [0.0, 0.0, 60.0]
    with pytest.raises(ValueError):  # more than the budget never fits
        window.acquire(500)
    assert window.acquire(40, requests=2) == 60.0 and window.acquire(1) == 60.0
    assert throttle.plan_calls(["x" * 40, "y" * 40, "z" * 400, "w"], 10, 90, 40) == [["x" * 40, "y" * 40], ["z" * 400], ["w"]]


def test_dedup_hits(spark):
    rows = [("q", i, s, h) for i, s, h in ((1, 0.9, "a"), (2, 0.9, "b"), (3, 0.8, "a"), (4, 0.7, "c"), (5, 0.6, "a"))]
    found = R.dedup_hits(spark.createDataFrame(rows, "query_id string, id int, score double, h string"), "h", 2).orderBy("rank").collect()
    assert [(r.id, r["rank"], r.duplicate_ids, r.duplicates_dropped) for r in found] == [(1, 1, [3, 5], 2), (2, 2, [], 2)]


def test_top_k_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    asked = rows.filter("vec_id in (1, 4)")
    assert [(r.id, r.score) for r in R.top_k(asked, rows, 2).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    assert R.top_k(asked, rows.limit(0), 2).count() == 0 and R.top_k(asked.limit(0), rows, 2).count() == 0
    with pytest.raises(Exception, match="no direction"):
        spark.createDataFrame([([0.0],)], "v array<double>").select(R.l2_normalized(F.col("v"))).collect()


def test_passage_spans(spark):
    docs = spark.createDataFrame([(1, "xx abc yy abc"), (2, "none"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "abc"), (8, "c y"), (9, ""), (10, "abc")], "item_id long, text string")
    for block in (10, 1000):
        rows = sorted(tuple(r) for r in passage_spans(docs, items, block_chars=block).collect())
        assert rows == [(1, 7, 3, 6), (1, 8, 5, 8), (1, 10, 3, 6)]


def test_failure_order(spark):
    names = "label string, section int, evidence int, gate boolean, n int, cuts boolean, first int, cites boolean"
    rows = [("incorrect", 0, 0, True, 0, False, None, False), ("false_refusal", 1, 0, True, 1, True, 1, False), ("incorrect", 1, 0, False, 1, False, 1, False), ("incorrect", 1, 1, False, 2, True, 3, True), ("hallucination", None, None, False, None, None, None, None), ("partially_correct", 1, 1, False, 2, False, 1, False), ("correct", 1, 1, False, 1, False, 1, False), (None, 0, 0, False, 0, False, None, False)]
    df = spark.createDataFrame(rows, names)
    found = [r.s for r in df.select(failure_stage(*[F.col(c) for c in df.columns]).alias("s")).collect()]
    assert found == ["retrieval_miss", "refusal", "chunking", "ranking", "refusal", "generation", None, None]


def test_cost(spark):
    df = spark.createDataFrame([(1000, 100, 50, 0.3, 2.5), (1, 1, 1, None, 2.5)], "p int, o int, t int, i double, u double")
    found = [r.c for r in df.select(cost_usd(*[F.col(c) for c in df.columns]).alias("c")).collect()]
    assert found[0] == pytest.approx(0.000675) and found[1] is None


def test_validation(spark):
    rows = spark.createDataFrame([("g", "en", "x"), ("g", "vi", "x"), ("h", "en", "x"), ("i", "en", "x"), ("i", "vi", "y")], "g string, language string, s string")
    assert sorted(r.g for r in V.asymmetric_groups(rows, "g", "language", ["s"]).collect()) == ["h", "i"]
    evidence = spark.createDataFrame([("1", "a  b"), ("1", "zz")], "source_id string, quote string")
    sections = spark.createDataFrame([("1", "x a b y")], "source_id string, text string")
    assert [r.quote for r in V.unmatched_quotes(evidence, sections, ["source_id"]).collect()] == ["zz"]
    V.frozen({"a": b"x"}, {"a": hashlib.sha256(b"x").hexdigest()})
    with pytest.raises(V.IntegrityError):
        V.frozen({"a": b"y"}, {"a": hashlib.sha256(b"x").hexdigest()})
    assert V.differing({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == ["b", "c"]


def test_chunk_violations(spark):
    docs = spark.createDataFrame([("1", "abcdef")], "source_id string, text string")
    good = [("1:f:0000", "1", 0, 3, "abc"), ("1:f:0001", "1", 3, 6, "def")]
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, source_id string, char_start int, char_end int, display_text string")
    assert V.chunk_violations(frame(good), docs, "f", 3).count() == 0
    assert sorted(r.rule for r in V.chunk_violations(frame([("1:g:0001", "1", 0, 4, "abc")]), docs, "f", 3).collect()) == ["gap", "not_a_slice", "too_long", "wrong_id"]


def test_answers():
    good = {"insufficient": False, "answer": "x [1] [9]", "cited_passages": [2], "missing_information": " "}
    assert parse_answer(json.dumps(good)) == good
    for bad in ("no", "[]", json.dumps(good | {"cited_passages": [True]}), json.dumps(good | {"answer": " "}), json.dumps({"answer": ""})):
        with pytest.raises(AnswerError):
            parse_answer(bad)
    assert render(split_template("Q: {{question}} P: {{passages}}", ("question", "passages")), {"question": "{{passages}}", "passages": "p"}) == "Q: {{passages}} P: p"
    asked = []
    llm = lambda prompt: asked.append(prompt) or json.dumps(good)
    hits = [{"score": 0.9, "text": "a"}, {"score": 0.8, "text": "b"}]
    found = answer("why?", hits, 0.5, llm)
    assert (found["answer"], found["citations"], found["dropped_markers"], found["insufficient"]) == ("x [1]", [1, 2], [9], False) and len(asked) == 1
    shut = answer("tại sao?", hits, 0.95, llm)
    assert shut["insufficient_reason"] == "retrieval_gate" and shut["language"] == "vi" and len(asked) == 1


def test_failures():
    assert classify(429, details=[{"@type": "type/QuotaFailure", "violations": [{"quotaId": "RequestsPerDayPerProject"}]}]) == ("quota", False)
    assert classify(429) == ("quota", True) and classify(503) == ("unavailable", True) and classify(400) == ("other", False)
    assert [backoff(n, None, 0) for n in (1, 2, 3)] == [1, 2, 4] and backoff(1, 30, 0.5) == 30 and backoff(20, None, 0) == 120


def test_atomic_manifest(tmp_path):
    store.write_manifest(str(tmp_path / "m" / "run.json"), {"é": 1})
    assert json.loads((tmp_path / "m" / "run.json").read_text(encoding="utf-8")) == {"é": 1} and os.listdir(tmp_path / "m") == ["run.json"]


def test_slices_hold_few_rows_and_bytes():
    from corpusloom.sources.shared import slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["x" * 3000] * 10_000)], names=["id", "text"])
    parts = list(slices([batch, batch.slice(0, 0), batch.slice(0, 1)]))
    assert max(p.num_rows for p in parts) <= 200 and max(p.nbytes for p in parts) <= 2_000_000
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch, batch.slice(0, 1)]))
    assert [p.num_rows for p in slices([pa.RecordBatch.from_arrays([pa.array(["y" * 5_000_000] * 3)], names=["text"])])] == [1, 1, 1]


def _steps(monkeypatch, made, function, rows):
    """How many rows each batch has that an operator makes of one batch in a Python worker."""
    from pyspark.sql import SparkSession

    works = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, work, *a, **k: works.append(work) or SparkSession.getActiveSession().createDataFrame([], a[0]))
    function(rows)
    return [b.num_rows for b in works[0](iter([made]))]


@pytest.mark.parametrize("name", ["html", "sections", "chunks", "normalized"])
def test_workers_make_rows_in_small_parts(spark, monkeypatch, name):
    """A batch of 3,000 rows is never turned into Python objects at once."""
    from corpusloom.operators import chunking, markdown
    from corpusloom.sources import html

    text = {"html": "<p>a</p>", "normalized": "# w\n\n# t\n\ntext\n"}.get(name, "# t\n\ntext\n")
    of = {"html": lambda d: html.html_documents(d, "id", "text"), "sections": lambda d: markdown.sections_frame(d, "id"), "chunks": lambda d: chunking.header_chunks(d, id_col="id"), "normalized": lambda d: markdown.normalize_frame(d, "id")}[name]
    made = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(3000)]), pa.array([text] * 3000)], names=["id", "text"])
    found = _steps(monkeypatch, made, of, spark.createDataFrame([], "id string, text string"))
    assert sum(found) == 3000 and max(found) <= 200
