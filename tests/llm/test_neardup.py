import random

import corpus_pipeline as P
from corpusloom.llm import neardup


def sets(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(texts, least=0.8):
    """The ids that stay."""
    ids, own = sorted(texts), {i: sets(t) for i, t in texts.items()}
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and len(own[i] & own[j]) >= least * len(own[i] | own[j]):
                    label[i], changed = label[j], True
    return {i for i in ids if label[i] == i}


def near_copies():
    """Rewrapped copies with changed words, of similarities around 0.8 and above, beside their originals."""
    rng, texts = random.Random(4), {}
    for n, changes in ((100, (0, 1, 2, 3)), (300, (1, 2, 4, 6, 9))):
        for _ in range(12):
            words = [f"{rng.choice(['Lorem', 'ipsum', 'dolor'])}{rng.randrange(10**6)}" for _ in range(n)]
            texts[len(texts)] = " ".join(words)
            for k in changes:
                copy = list(words)
                for at in rng.sample(range(n), k):
                    copy[at] = f"other{rng.randrange(10**6)}"
                width = rng.randrange(7, 15)
                texts[len(texts)] = "\n".join(" ".join(copy[i : i + width]) for i in range(0, n, width))
    return texts


def test_stage_drops_rewrapped_near_copies(spark, data):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], spark.read.parquet(f"{data}/documents.parquet").schema)
    left = {r.doc_id for r in P.near_duplicates(spark, docs, data).collect()}
    assert left == brute(texts) and len(left) < len(texts) / 2
    for options in ({"tile": 2}, {"filter_bits": 64}):
        assert {r.doc_id for r in neardup.keep_representatives(docs, **options).collect()} == left


def test_edges(spark, docs):
    df = docs([(1, None, 0), (2, " \n", 0), (3, "a b", 0), (4, "A\tb", 0), (None, "a b", 0), (5, "a c", 0), (5, "a c", 1)], "doc_id long, text string, id int")
    kept = neardup.keep_representatives(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "5", "None"]
    assert neardup.keep_representatives(df.limit(0)).count() == 0


def test_stage_joins_fingerprints_and_similarity(spark, docs):
    """A chain of which one link is found by similarity and the other by fingerprints and similarity; empty texts are one class."""
    words = [f"w{k}" for k in range(400)]
    a, b = " ".join(words), " ".join(words[:-1] + ["other"])
    c = " ".join(words[30:-1] + ["other"])
    df = docs([(3, a), (2, b), (9, c), (4, ""), (5, None), (6, "x y"), (None, a), (7, "unlike all of the others here")], "doc_id long, text string")
    assert {r.doc_id for r in neardup.keep_representatives(df).collect()} == {2, 4, 6, 7, None}
    assert neardup.keep_representatives(df.limit(0)).count() == 0
