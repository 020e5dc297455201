from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import linededup as L


def brute(rows, least=0.8, size=8):
    """(doc, line) pairs that go."""
    at = defaultdict(list)
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.split():
                at[L.normalised(line)].append((doc, n))
    keys, group = sorted(at), {}
    sets, holding = [L.shingles(k, size) for k in keys], defaultdict(list)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holding[g])
        for j, n in common.items():
            if n >= least * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for g in s:
            holding[g].append(i)
    for i, k in enumerate(keys):
        group.setdefault(find(i), []).extend(at[k])
    return {p for places in group.values() for p in sorted(set(places))[1:] if p[0] is not None}


def found(df, **options):
    return {(r.doc_id, n) for r in L.duplicate_lines(df, **options).collect() for n in r.lines}


def test_query_table_equals_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in df.collect()])
    assert found(df) == expected and expected


LINE = "this is a line of some length that many of the documents share with one another in the corpus {}"


def test_hot_groups_in_small_tiles(spark, docs):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "\n".join([f"own line number {i} of this very document {i * 7919}", LINE.format(words[i % 40]), LINE.format("same")])) for i in range(160)]
    df = docs([(i, t, 0) for i, t in rows], "doc_id long, text string, lines int").repartition(7)
    for options in ({}, {"tile": 3}, {"filter_bits": 64}):
        got = found(df, **options)
        assert {p for p in got if p[1] > 0} == {(i, n) for i in range(160) for n in (1, 2)} - {(0, 1)}
        assert {p for p in got if p[1] == 0} <= brute(rows)


def test_near_lines_need_the_stated_similarity(spark, docs):
    base = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"
    near, far = base.replace("hotel", "hotels"), base[:60] + base[60:][::-1]
    df = docs([(1, base), (2, near), (3, far), (4, base.upper() + "  ")], "doc_id long, text string")
    assert found(df) == {(2, 0), (4, 0)}


def test_documents(spark, docs):
    shared = LINE.format("x")
    rows = [(1, f"{shared}\nfirst own line of the document here"), (2, f"short\n{shared}\n"), (3, shared), (4, None), (5, ""), (None, shared), (6, "short\nshort"), (7, f"{shared}\n{shared}"), (1, f"{shared}\nfirst own line of the document here")]
    df = docs([(i, t, "k") for i, t in rows], "doc_id long, text string, lines string")
    out = L.dedup_lines(df, count_as="lost")
    got = [(str(r.doc_id), r.text, r.lost) for r in out.collect()]
    assert out.columns == [*df.columns, "lost"]
    assert sorted(r[2] for r in got) == [0, 0, 0, 0, 0, 1, 1, 2, 2]
    assert {(r[0], r[1]) for r in got} == {("1", rows[0][1]), ("2", "short\n"), ("3", ""), ("4", None), ("5", ""), ("None", shared), ("6", ""), ("7", "")}
    left = {str(r.doc_id) for r in L.dedup_lines(df, drop_emptied=True).collect()}
    assert left == {"1", "2", "4", "5", "None"}
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    a = "the quick brown fox jumps over the lazy dog and runs away from all of them at once"
    b = a.replace("lazy", "lame")
    marks = L.signatures([a, b, "tiny"], 8, 200)
    x, y = L.shingles(a, 8), L.shingles(b, 8)
    assert abs((marks[0] == marks[1]).mean() - len(x & y) / len(x | y)) < 0.12
    assert (L.signatures([b, a], 8, 200)[1] == marks[0]).all() and marks.dtype == np.uint32


def test_query_compares_every_line_with_a_word(spark, data, docs, tmp_path):
    from corpusloom.llm import queries

    chinese, url = "这是一个在许多文档中重复出现的没有空格的长句子用来测试去重", "https://example.org/" + "abcdef0123456789" * 4
    table = spark.read.parquet(f"{data}/documents.parquet")
    planted = [(10**6 + k, f"Menu\nown line number {k}\n{chinese}{'' if k else '。'}\n{url}\n \nok", "en", "s", 1) for k in range(3)]
    table.union(spark.createDataFrame(planted, table.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    gone = brute(rows.items())
    assert {(10**6 + k, n) for k in (1, 2) for n in (0, 2, 3, 5)} <= gone
    expected = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows.items() if t is not None}
    got = {r.doc_id: r.text for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: t for i, t in got.items() if t is not None} == expected


def test_rows_of_one_id_with_other_texts(spark, docs):
    a, b = LINE.format("one"), "quite another sentence that two documents of the table have in common with each other"
    df = docs([(1, a), (2, f"{b}\nown words of two"), (2, f"yet more of them\n{a}"), (3, b), (3, f"{a}\n{b}")], "doc_id long, text string")
    for options in ({}, {"filter_bits": 64}):
        left = sorted((r.doc_id, r.text) for r in L.dedup_lines(df, **options).collect())
        assert left == [(1, a), (2, f"{b}\nown words of two"), (2, "yet more of them"), (3, ""), (3, "")]


def test_very_long_lines_and_scripts_without_spaces(spark, docs):
    long, text = "word " * 60_000, "在许多文档中重复出现的没有空格的长句子" * 400
    df = docs([(1, long), (2, f"{long}\n{text}"), (3, f"x\n{text}。"), (4, "\n".join(["x"] * 3000)), (5, "y")], "doc_id long, text string")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_recall_at_the_least_similarity(spark, docs):
    rng = np.random.default_rng(4)
    rows, want = [], 0
    for k in range(300):
        a = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 200))
        b = a[: (cut := int(rng.integers(60, 140)))] + "#" * int(rng.integers(1, 14)) + a[cut + 8 :]
        x, y = L.shingles(L.normalised(a), 8), L.shingles(L.normalised(b), 8)
        want += len(x & y) >= 0.8 * len(x | y)
        rows += [(2 * k, a), (2 * k + 1, b)]
    assert want > 200 and len(found(docs(rows, "doc_id long, text string"))) >= 0.98 * want


def test_half_a_million_lines_in_one_text(spark, docs):
    import time

    many = "\n".join(["the same line of a log file, again and again"] * 480_000 + [md5(str(i).encode()).hexdigest()[:16] for i in range(20_000)])
    df = docs([(1, many, "a", 1, "b", 2), (2, "the same line of a log file, again and again\nown", "a", 1, "b", 2), (3, None, "a", 1, "b", 2)], "doc_id long, text string, gone string, of int, version string, lost int")
    start = time.monotonic()
    out = {r.doc_id: r for r in L.dedup_lines(df, count_as="n").collect()}
    took = time.monotonic() - start
    kept = out[1].text.split("\n")
    assert kept[0] == "the same line of a log file, again and again" and len(kept) + out[1].n == 500_000 and out[1].n == 479_999 and out[2].text == "own" and out[3].text is None
    assert (out[2].gone, out[2].of, out[2].version, out[2].lost) == ("a", 1, "b", 2) and took < 240


def test_removal_is_linear_in_the_lines(spark, docs, monkeypatch):
    import time

    text = "\n".join(["x"] * 500_000)
    gone = docs([(1, list(range(1, 500_000)))], "doc_id long, lines array<int>")
    df = docs([(1, text), (2, "y")], "doc_id long, text string")
    marks = gone.crossJoin(df.filter("doc_id = 1").select(F.xxhash64("text").alias("version"))).select("doc_id", "version", "lines")
    monkeypatch.setattr(L, "duplicate_lines", lambda *a, **k: marks)
    start = time.monotonic()
    assert {r.doc_id: r.text for r in L.dedup_lines(df).collect()} == {1: "x", 2: "y"}
    assert time.monotonic() - start < 30
