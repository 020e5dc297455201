import itertools
import pathlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import mph, phrases, queries
from tests.oracle import connect, same

WIDE = "doc_id long, text string, lang string, level int, a string, phrase string, n int, kind string"


def brute(rows, least, longest=5, top=2000, percent=100):
    f = {}
    for lang, text in rows:
        own = f.setdefault(lang if lang is not None else "und", Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), a, own[p[:k]], own[p[k:]], score))
        out += [(lang, i + 1, x[2].decode(), *x[3:6], n, x[6]) for i, x in enumerate(sorted(left)[:top])]
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    words = ["New", "York", "times", "the", "of", "Ünï", "a\x1fb", "c#", "É", "😀", "x", "y", "in", "spite"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", "\x0c", "\r\n"]
    fixed = ["new york times", "in spite of the", "x x x x x x", "É É É É"]
    return [(rng.choice(["en", "de", None, "und", "e n"]), "".join((rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words)) + rng.choice(ends) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op13_collocations(spark, folder).cache()
    assert found.count() > 0
    same(found, connect(folder), queries.OP13_SQL)


@pytest.mark.parametrize("least, percent, top", [(20, 100, 2000), (8, 60, 5), (1, 100, 2000)])
def test_against_brute_force(spark, docs, least, percent, top, monkeypatch):
    rows = made(least, 60 if least == 1 else 400) + [("en", None), ("fr", ""), ("fr", " . , "), (None, "lone")]
    df = docs([(i, text, lang, 0, "x", "y", 1, "z") for i, (lang, text) in enumerate(rows)], WIDE)
    found = sorted(map(tuple, phrases.collocations(df, least=least, percent=percent, top=top).collect()))
    assert found == brute(rows, least, percent=percent, top=top) and found


def test_small_blocks(spark, docs):
    """Many blocks and more rounds of sums change nothing."""
    rows = made(3)
    df = docs([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string").repartition(9)
    assert phrases.tokens("A.B c\td".encode()) == [b"a", b"\xff", b"b", b"c", b"d"]
    with pytest.MonkeyPatch.context() as m:  # these two are used on the driver
        m.setattr(phrases, "BLOCK", 5)
        m.setattr(phrases, "FAN", 2)
        assert sorted(map(tuple, phrases.collocations(df, least=15).collect())) == brute(rows, 15)


def test_empty_and_rare(spark, docs):
    schema = "doc_id long, text string, lang string"
    for rows in ([], [(1, "a b c", "en")], [(1, None, None)], [(1, "word. " * 300, "en")]):
        assert phrases.collocations(docs(rows, schema)).count() == 0
    long = docs([(1, "alpha beta " * 300_000, "en")], schema)  # one text of 600,000 words
    out = phrases.collocations(long).collect()
    assert sorted(map(tuple, out)) == brute([("en", "alpha beta " * 300_000)], 100)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    table = mph.Table(keys)
    slots = table.find(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and np.array_equal(table.keys[slots], keys)
    others = rng.integers(1 << 63, (1 << 64) - 1, 50_000, dtype=np.uint64)
    assert (table.find(others) == -1).all()
    assert len(mph.Table(keys[:0])) == 0 and (mph.Table(keys[:0]).find(keys[:3]) == -1).all() and mph.Table(keys[:1]).find(keys[:2]).tolist() == [0, -1]
    with pytest.raises(ValueError):
        mph.Table(np.array([5, 5], np.uint64))


def test_packed_counts():
    rng = np.random.default_rng(2)
    total, want = None, np.zeros(1000, np.int64)
    for top, share in ((3, 1.0), (300, 0.01), (70_000, 0.5), (1 << 40, 0.02), (1, 0.0)):
        values = np.where(rng.random(1000) < share, rng.integers(0, top, 1000), 0)
        total, want = phrases.added_to(total, phrases.packed(values)), want + values
        assert np.array_equal(phrases.added_to(None, phrases.packed(values)), values)
    assert np.array_equal(total, want) and len(phrases.packed(np.zeros(1 << 16, np.int32))) == 24


def test_large_corpus(spark, docs):
    """A sketch has places for the pairs of its corpus, so that few others become candidates; rows of sequences stay small."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 900, 40)) + " new york", "en") for i in range(30_000)]
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    with pytest.MonkeyPatch.context() as m:  # the fewest places of a sketch; the driver makes sketches
        m.setattr(phrases, "PLACES", 1 << 16, raising=False)
        frequent = phrases.candidates(docs(rows, "doc_id long, text string, lang string").coalesce(1), least=10, longest=2).count()
    found = [p for p in shared.iterdir() if p not in before]
    keys = sum(spark.read.parquet(str(p / "keys")).count() for p in found if (p / "keys").exists())
    own = spark.read.parquet(*(str(p / "words" / "kind=sequence") for p in found if (p / "words" / "kind=sequence").exists())).selectExpr("max(length(payload)) AS longest", "sum(length(payload)) AS all").first()
    pairs = Counter(p for _, text, _ in rows for p in itertools.pairwise(text.split()))
    assert frequent == sum(n >= 10 for n in pairs.values()) > 0
    assert keys < len(pairs) / 20 and own["all"] > 4_000_000 and own["longest"] < 500_000
    assert [phrases.Sketch(n, 100).places // (1 << 22) for n in (0, 10**8, 10**9)] == [1, 1, 9] and phrases.Sketch(10**10, 100).places // phrases.Sketch(10**10, 100).piece <= phrases.PIECES
