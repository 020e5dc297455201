from collections import Counter

from corpusloom.llm import quality, queries
from tests.oracle import connect, same


def brute(words, k=5):
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    count = Counter(windows)
    return len({p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + k)})


def test_repeated_words():
    for text in ("", "a b c d e", "a b c d e a b c d e", "a a a a a a", "a b c d e x a b c d e f " * 3, "x " * 50 + "y z"):
        words = text.split()
        assert quality.repeated_words([w.encode() for w in words]) == brute(words)


def test_many_kinds_stay_exact():
    words = [str(i % 7000) for i in range(15000)]
    assert quality.repeated_words([w.encode() for w in words]) == brute(words)


def test_query_equals_sql(spark, data):
    same(queries.op2_quality(spark, data), connect(data), queries.OP2_SQL)


def test_edges(spark, docs):
    df = docs([(1, None, "x"), (2, "", "x"), (None, "w " * 12, "x"), (2, "", "x"), (3, "good clean words that all differ from each other here today", "x")], "doc_id long, text string, fail_bits string")
    rows = quality.apply_policy(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in rows) == [("1", 0, True, False), ("2", 0, True, False), ("2", 0, True, False), ("3", 11, False, True), ("None", 12, True, False)]
    assert quality.apply_policy(df.limit(0)).count() == 0


def test_policies_and_ablations(spark, data):
    rows = quality.ledger(spark.read.parquet(f"{data}/documents.parquet")).cache()
    bits = [r.fail_bits for r in rows.collect()]
    names = {name: bit for bit, name, _ in quality.RULES}
    for policy in quality.POLICIES:
        mask = quality.policy_mask(policy)
        assert rows.filter(quality.keeps(policy)).count() == sum(not b & mask for b in bits)
        for r in quality.ablations(rows, policy).collect():
            bit = 1 << names[r.rule]
            assert (r.fails, r.alone, r.kept_without) == (sum(bool(b & mask & bit) for b in bits), sum(b & mask == bit for b in bits), sum(not b & mask & ~bit for b in bits))
