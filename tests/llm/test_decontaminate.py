import random
from collections import Counter

from corpusloom.llm import decontaminate as D
from corpusloom.llm import queries

VOCABULARY = [f"w{i}" for i in range(5000)]


def test_query_finds_every_verbatim_item(spark, data):
    found = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, data).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    assert found == brute(texts, items)
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x and x in t} <= found


def brute(texts, items, least_words=12, least_share=0.75, penalty=2.0):
    """Every alignment of every item with every text that some mask could hit."""
    words, out = D.Words(), set()
    own = {d: words.of(t) for d, t in texts.items()}
    for i, x in items.items():
        item = words.of(x)
        masks = [m for m in D.MASKS if len(m) <= len(item)] or (["1" * len(item)] if len(item) else [])
        for d, text in own.items():
            places = {}
            for q, w in enumerate(text.tolist()):
                places.setdefault(w, []).append(q)
            shifts = Counter(q - p for p, w in enumerate(item.tolist()) for q in places.get(w, ()))
            for shift in (s for s, n in shifts.items() if n >= min(8, len(item))):
                low, high = max(0, -shift), min(len(item), len(text) - shift)
                equal = item[low:high] == text[low + shift : high + shift]
                hit = any(equal[p : p + len(m)][[c == "1" for c in m]].all() for m in masks for p in range(len(equal) - len(m) + 1))
                if hit:
                    s, e = D.best_run(equal, penalty)
                    if e - s >= min(least_words, len(item)) and equal[s:e].sum() >= least_share * (e - s):
                        out.add((d, i))
    return out


def test_substitutions_are_tolerated():
    rng = random.Random(3)
    hit = 0
    for _ in range(200):
        item = [rng.choice(VOCABULARY) for _ in range(30)]
        text = [rng.choice(VOCABULARY) for _ in range(100)]
        changed = [w if rng.random() > 0.1 else "zz" for w in item]
        index = D.Index([(1, " ".join(item))], D.MASKS)
        hit += bool(D.matches(D.Texts([" ".join(text + changed + text)], D.Words()), index, 12, 0.75, 2.0))
        assert not D.matches(D.Texts([" ".join(text)], D.Words()), index, 12, 0.75, 2.0)
    assert hit >= 190


def test_case_and_punctuation_do_not_matter(spark, docs):
    item = " ".join(VOCABULARY[:20])
    df = docs([(1, f"x {item.upper().replace(' ', ', ')}! y", 0), (2, " ".join(VOCABULARY[:9]), 0), (3, None, 0), (4, "", 0), (None, f"{item} - {item}", 0), (1, item, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "w3 w4"), (11, "--"), (7, item)], "item_id long, text string")
    for block in (3, 10**6):
        rows = sorted((str(r.doc_id), r.item_id, r.start, r.n_words, r.n_equal) for r in D.overlaps(df, items, block_words=block).collect())
        assert set(rows) == {("1", 7, 1, 20, 20), ("1", 7, 0, 20, 20), ("1", 10, 4, 2, 2), ("1", 10, 3, 2, 2), ("2", 10, 3, 2, 2), ("None", 7, 0, 20, 20), ("None", 10, 3, 2, 2)}
        clean = D.drop_contaminated(df, items, block_words=block)
        assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4]
    assert D.overlaps(df.limit(0), items).count() == 0 and D.overlaps(df, items.limit(0)).count() == 0
    assert D.drop_contaminated(df, items.limit(0)).count() == 6


def test_short_items_with_substitutions():
    """Against a brute force without masks: every place where three quarters of an item's words are equal."""
    rng = random.Random(9)
    for n in range(8, 20):
        items = [[rng.choice(VOCABULARY[:300]) for _ in range(n)] for _ in range(12)]
        index = D.Index([(k, " ".join(x)) for k, x in enumerate(items)], D.MASKS)
        texts, expected = [], set()
        for k, item in enumerate(items):
            for changes in (0, 1, 2, 2, n // 4, n // 4 + 2):
                changed = list(item)
                for at in rng.sample(range(n), changes):
                    changed[at] = rng.choice(["zz", *VOCABULARY[:300]])
                before, after = ([rng.choice(VOCABULARY[:300]) for _ in range(rng.randrange(20))] for _ in range(2))
                texts.append(before + changed + after)
        for d, text in enumerate(texts):
            for k, item in enumerate(items):
                if any(4 * sum(a == b for a, b in zip(item, text[p:])) >= 3 * n for p in range(len(text) - n + 1)):
                    expected.add((d, k))
        found = set(D.matches(D.Texts([" ".join(t) for t in texts], D.Words()), index, 12, 0.75, 2.0))
        runs = {(d, k) for d, k in found - expected}  # parts of 12 words and more of a longer item
        assert expected <= found and len(expected) >= 55 and (n > 12 or not runs)
    one = D.Index([(1, "a b c d e f g")], D.MASKS)  # under eight words, all have to be equal
    assert D.matches(D.Texts(["x a b c d e f g", "x a b c d e f h"], D.Words()), one, 12, 0.75, 2.0) == {(0, 0): (1, 7, 7)}


def test_blocks_give_the_same_overlaps_in_one_scan(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    whole, parted = D.overlaps(docs, items), D.overlaps(docs, items, block_words=200)
    assert sorted(whole.collect()) == sorted(parted.collect()) and whole.count()
    assert parted._jdf.queryExecution().toString().count("FileScan parquet") == whole._jdf.queryExecution().toString().count("FileScan parquet")
    kept = D.drop_contaminated(docs, items, block_words=200)
    bad = {r.doc_id for r in whole.collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad


def test_repeated_words_and_very_long_texts():
    index = D.Index([(1, "spam " * 3000), (2, " ".join(VOCABULARY[:40]))], D.MASKS)
    text = " ".join(["spam"] * 4000 + VOCABULARY[100:50_000 % 5000 + 100] * 3 + VOCABULARY[:40] + ["spam"] * 500)
    found = D.matches(D.Texts([text, "", "spam"], D.Words()), index, 12, 0.75, 2.0)
    assert {k: v[2] for k, v in found.items()} == {(0, 0): 3000, (0, 1): 40}
    ties = D.matches(D.Texts([" ".join(VOCABULARY[:40] * 3)], D.Words()), index, 12, 0.75, 2.0)
    assert ties == {(0, 1): (0, 40, 40)} or ties[0, 1][1:] == (40, 40)
