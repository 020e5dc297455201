import numpy as np
import xxhash

from corpusloom.llm import queries, simhash
from corpusloom.llm.common import forest


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """doc -> smallest doc reachable over pairs of at most two differing bits."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


TEXTS = ["", None, " \t\n", "One", "one TWO", "a b c", "A B C", "É é ß  words İ", "x " * 300, "the quick brown fox jumps over the lazy dog " * 9, "the quick brown fox jumps over the lazy cat " * 9, "tail\x1cof\x85odd\xa0spaces here"]


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_query_equals_brute_force(spark, data):
    rows = queries.op1_simhash(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints)


def planted(seed, n=400):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = base.copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return sorted(set(np.concatenate([base, near, [np.uint64(0), np.uint64(2**64 - 1), np.uint64(3)]]).tolist()))


def test_no_link_is_lost_in_any_lanes_or_tiles(spark):
    prints = planted(3)
    arr = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2)
    a, b = forest(i, j)
    expected = dict(zip(a.tolist(), b.tolist()))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), k) for k, p in enumerate(prints)], "fp long, rep long").repartition(3)
    for options in ({"lanes": 4}, {"lanes": 4, "tile": 1}, {"lanes": 2, "tile": 7}, {"lanes": 8}, {}):
        rows = simhash.hamming_links(df, 2, **options).collect()
        a, b = forest(np.array([r.src for r in rows]), np.array([r.dst for r in rows]))
        assert dict(zip(a.tolist(), b.tolist())) == expected


def test_edge_rows(spark, docs):
    rows = [(5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "other words entirely here"), (7, None), (8, ""), (7, None)]
    df = docs([(i, t, t) for i, t in rows], "doc_id long, text string, fp string")
    found = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert found == [("3", 3), ("5", 3), ("7", 7), ("7", 7), ("8", 7), ("None", 3), ("None", None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "7", "None", "None"]


def test_chains_become_one_component(spark):
    from corpusloom.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (9, 9)], "src long, dst long").repartition(5)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert connected_components(edges.limit(0)).count() == 0


def test_very_long_text(spark, docs):
    from corpusloom.llm import simhash

    long = " ".join(f"w{k % 977}" for k in range(300_000))
    df = docs([(1, long), (2, long.upper()), (3, long + " end"), (4, "other words")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert simhash.simhash(df).filter("doc_id = 1").first().fp == np.uint64(brute_fingerprint(long)).astype(np.int64)
