import random
import zlib

import numpy as np

from corpusloom.llm import toxicity as X

BAD = ["idiot", "trash", "moron", "scum"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "re", "st", "ed", "in", "ou", "le"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), int(toxic)))
    return rows


def test_held_out_accuracy_and_scores(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = X.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    found = {r.doc_id: r for r in X.score(docs, model).withColumn("held_out", X.held_out()).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {r[0] for r in held} == {i for i, r in found.items() if r.held_out} and len(held) > 200
    wrong = sum((found[i].score >= 0.3) != bool(t) for i, _, _, t in held)
    assert wrong <= 0.03 * len(held)
    assert sum(found[i].rejected != bool(t) for i, _, _, t in held) <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = X.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.rejected}


def test_training_ignores_held_out_labels_and_order(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, _, y in rows], "doc_id long, toxic int")
    a = X.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    b = X.train(docs.drop("toxic").repartition(7), flipped)
    assert np.array_equal(a.out, b.out) and a.thresholds == b.thresholds


def test_bounds_of_the_sample(spark):
    docs = spark.createDataFrame(corpus(200, 3), "doc_id long, text string, lang string, toxic int")
    model = X.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), rows=10)
    assert model.constant is not None and model.threshold > 1  # too few rows to learn from: nothing is rejected


def test_scorer_equals_a_plain_one():
    model = X.fit([r[1] for r in corpus(200, 4)], [r[3] for r in corpus(200, 4)], ["en"] * 200)
    texts = [r[1] for r in corpus(60, 5)] + ["", None, "x", "word " * 5000]
    small, plain = X.Scorer(model, most=40), model.score(X.model_logits(model, texts))
    assert np.allclose(np.concatenate([small(texts[i : i + 7]) for i in range(0, len(texts), 7)]), plain, atol=1e-5)


def test_edges(spark):
    shape = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame([(1, None, None, "s"), (None, "", "xx", "s"), (1, "a b", "en", "s")], shape)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        model = X.train(docs, lab)
        rows = X.score(docs, model).collect()
        assert len(rows) == 3 and all(0 <= r.score <= 1 and not r.rejected for r in rows)
        assert X.drop_toxic(docs, model).count() == 3
    assert X.score(docs.limit(0), model).count() == 0


def test_thresholds():
    assert X._best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == 0.5
    assert X._best_threshold(np.array([0.9, 0.8]), np.array([1, 1])) is None


def test_a_very_long_text_does_not_end_the_sample(spark):
    rows = corpus(300, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    first = docs.filter(~X.held_out()).orderBy(X.F.xxhash64("doc_id")).first().doc_id
    chars = sum(len(t) for _, t, _, _ in rows)
    for size in (chars + 10, chars - 10):  # one that never fits, and one that would leave no room for the others
        long = spark.createDataFrame([(i, t if i != first else "word " * (size // 5), lang, y) for i, t, lang, y in rows], docs.schema)
        model = X.train(long.drop("toxic"), long.select("doc_id", "toxic"), chars=chars)
        assert model.constant is None and X.score(long, model).filter("rejected").count() > 30


def test_calibration_is_finite_where_logits_separate():
    logits, truth = np.concatenate([np.linspace(-90, -60, 500), np.linspace(5, 40, 80)]), np.repeat([0.0, 1.0], [500, 80])
    scale, shift = X.calibrated(logits, truth)
    p = 1 / (1 + np.exp(-(scale * logits + shift)))
    assert 0 < scale < 5 and abs(shift) < 50 and p[:500].max() < 0.3 < p[500:].min()
    flat = X.calibrated(np.zeros(10), np.repeat([0.0, 1.0], 5))
    assert np.isfinite(flat).all()


def test_pieces_of_words():
    flat, starts = X.pieces_of(["idiot", "idiots.", "", "id", "idiot"])
    parts = np.split(flat, starts[1:])
    assert [len(p) for p in parts] == [4, 5, 1, 1, 4] and parts[0][1:].tolist() == parts[1][1:4].tolist() and parts[0].tolist() == parts[4].tolist()


def test_query_on_held_out_rows_of_a_larger_table(spark):
    import os

    import pytest

    import corpus_pipeline
    from corpusloom.llm import queries

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no larger tables here")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in queries.op8_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = [r for r in held if labels[r.doc_id]], [r for r in held if not labels[r.doc_id]]
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.toxic(spark, docs, folder).select("doc_id").collect()}
    assert sum(r.doc_id not in left for r in toxic) >= 0.9 * len(toxic) and sum(r.doc_id not in left for r in clean) <= 0.02 * len(clean)
