import numpy as np
import pytest

import corpus_pipeline as P
from corpusloom.llm import toxicity

from .test_decontaminate import brute as brute_overlaps
from .test_lines import brute as brute_lines
from .test_simhash import brute_components, brute_fingerprint
from .test_tokens_packing import check_packing


@pytest.fixture(scope="module")
def stages(spark, data):
    """Each stage's rows, from the table on."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, data), name)
        out[name] = docs
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    for name, _ in P.STAGES[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes and stages[name].count() > 0


def test_toxicity_drops_what_is_rejected(spark, data, stages):
    model = toxicity.train(stages["documents"], spark.read.parquet(f"{data}/labels.parquet"))
    scores = toxicity.score(stages["documents"], model)
    assert set(texts(stages["toxicity"])) == {r.doc_id for r in scores.filter("not rejected").collect()}


def test_lines(stages):
    before = texts(stages["toxicity"])
    gone = brute_lines(before.items())
    expected = {}
    for i, t in before.items():
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if kept.split() or kept == t:
            expected[i] = kept
    assert texts(stages["line_dedup"]) == expected and gone
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"].collect())


def test_one_of_each_component_stays(stages):
    label = brute_components({i: brute_fingerprint(t) for i, t in texts(stages["line_dedup"]).items()})
    assert set(texts(stages["simhash"])) == {i for i, low in label.items() if i == low}


def test_contaminated_documents_go(spark, data, stages):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    before = texts(stages["simhash"])
    bad = {d for d, _ in brute_overlaps(before, items)}
    assert set(texts(stages["decontamination"])) == set(before) - bad


def test_packing(stages):
    used, least = check_packing(stages["packing"].collect(), texts(stages["decontamination"]))
    assert used <= 1.05 * least + 1


def test_run_is_the_last_stage(spark, data, stages):
    key = lambda r: (r.doc_id, r.piece)
    rows = sorted(P.run(spark, data).collect(), key=key)
    assert [(key(r), r.ids_crc32) for r in rows] == [(key(r), r.ids_crc32) for r in sorted(stages["packing"].collect(), key=key)]


def test_planted_cases(spark, data, tmp_path):
    """Copies, near copies, a leaked passage, a repeated passage and clean documents, among the table's own rows."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"{a}{b}" for a, b in zip(rng.choice(["lorem", "ipsum", "dolor", "amet"], n), rng.integers(0, 10**6, n)))
    copy, near, passage = words(120), words(150), words(60)
    item = spark.read.parquet(f"{data}/benchmark.parquet").filter("length(text) > 100").first().text
    rows = [(10**6 + k, t) for k, t in enumerate([copy, copy, near, near + " end", f"{words(40)}\n{passage}", f"{words(40)}\n{passage}", f"{words(30)} {item} {words(30)}", words(80), words(90)])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], spark.read.parquet(f"{data}/documents.parquet").schema)
    for _, stage in P.STAGES[1:-1]:
        docs = P.written(stage(spark, docs, data), "x")
    left = texts(docs)
    assert set(left) == {10**6 + k for k in (0, 2, 4, 5, 7, 8)}
    assert passage in left[10**6 + 4] and passage not in left[10**6 + 5]


