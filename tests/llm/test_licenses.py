import random
import time
from collections import Counter

import pytest

from corpusloom.llm import licenses as L
from corpusloom.llm import queries


def test_patience_is_an_alignment():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(L.patience(a, a)) == len(a)


def test_longest_increasing():
    rng = random.Random(2)
    for _ in range(100):
        pairs = list(enumerate(rng.sample(range(9), 7)))
        best = max((sum(1 for k in range(7) if m >> k & 1) for m in range(128) if (s := [pairs[k][1] for k in range(7) if m >> k & 1]) == sorted(s)))
        found = L.longest_increasing(pairs)
        assert len(found) == best and [j for _, j in found] == sorted(j for _, j in found)


def test_every_whole_notice_is_found(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    short = [(n, t) for n, t in L.TEMPLATES if len(t) < 80]
    expected = Counter((d, n) for d, t in texts.items() for n, x in short for _ in range(t.count(x)))
    assert Counter((r.doc_id, r.license) for r in queries.op6_licenses(spark, data).collect()) == expected and expected


def test_changed_and_cut_notices():
    scanner = L.Scanner(L.TEMPLATES, 0.8)
    words = L.TEMPLATES[3][1].split()
    fill = ["filler"] * 40
    for step in (8, 11, 17):
        changed = [w if k % step else "other" for k, w in enumerate(words)]
        found = scanner.scan(" ".join(fill + changed + fill))
        assert [f[0] for f in found] == ["MIT"] and found[0][1] in (40, 41) and found[0][3] >= 0.8 * found[0][4]
    assert scanner.scan(" ".join(words[: len(words) // 2])) == []
    assert [f[0] for f in scanner.scan("Released under the MIT License. " * 3)] == ["MIT"] * 3


def test_prefilter_loses_nothing():
    rng = random.Random(6)
    scanner = L.Scanner(L.TEMPLATES, 0.8)
    for _ in range(150):
        k = rng.randrange(len(scanner.words))
        words = scanner.words[k]
        kept = [w for w in words if rng.random() > 0.15]
        text = ["x"] * rng.randrange(30) + kept + ["y"] * rng.randrange(30)
        if len(L.patience(words, kept)) >= scanner.needed(k):
            assert scanner.scan(" ".join(text)), (L.TEMPLATES[k], kept)


def test_edges(spark, docs):
    notice = "All rights reserved."
    df = docs([(1, None, 1), (2, "", 1), (None, notice, 1), (3, f"{notice} {notice}", 1), (3, notice, 1), (4, "... !!", 1)], "doc_id long, text string, license int")
    rows = sorted((str(r.doc_id), r.license, r.first_word, r.end_word, r.coverage) for r in L.scan(df).collect())
    assert rows == [("3", "reserved", 0, 3, 1.0), ("3", "reserved", 0, 3, 1.0), ("3", "reserved", 3, 6, 1.0), ("None", "reserved", 0, 3, 1.0)]
    assert L.scan(df.limit(0)).count() == 0


def test_neighbours_keep_their_names():
    scanner = L.Scanner(L.TEMPLATES, 0.8)
    names = lambda text: [f[0] for f in scanner.scan(text)]
    for name, text in L.TEMPLATES:
        assert names(f"some words before {text} and after") == [name], (name, text)
    assert names(f"1. {L._BSD} {L._BSD_END}") == ["BSD-2-Clause"]
    assert names("Released under the BSD License.") == ["unidentified"]
    assert names("Licensed under CC BY-SA 4.0.") == ["CC-BY-SA-4.0"] and names("Licensed under CC BY-SA 3.0.") == ["CC-BY-SA-3.0"]
    assert names("This work is licensed under the GNU General Public License, version 2") == ["GPL-2.0-only"]
    assert names("GNU General Public License, version 2") == [] and names("licensed under the GNU General Public License, version 2") != ["GPL-3.0-only"]
    assert names(L.TEMPLATES[3][1].split(" THE SOFTWARE IS")[0] + " no more") == []


NEIGHBOURS = {
    "Licensed under the Apache License, Version 1.1.": ["unidentified"], "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"], "Licensed under CC BY 3.0.": ["CC-BY-3.0"], "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
    "Licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0-only"], "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0-only"],
    "Released under the X11 License.": ["unidentified"], "Released under the BSD License.": ["unidentified"], "Released under the MIT License.": ["MIT"],
    "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0"],
}


@pytest.mark.parametrize("text", NEIGHBOURS)
def test_neighbours_are_not_confused(text):
    assert [f[0] for f in L.Scanner(L.TEMPLATES, 0.8).scan(text)] == NEIGHBOURS[text]


def test_mixtures_end_in_time():
    """Random mixtures of parts of the templates: each scan ends, and what it reports does not overlap."""
    rng, scanner, templates = random.Random(7), L.Scanner(L.TEMPLATES, 0.8), [t.split() for _, t in L.TEMPLATES]
    for _ in range(3000):
        text = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(templates)
            if rng.random() < 0.6:
                words = words[(a := rng.randrange(len(words))) : rng.randrange(a, len(words)) + 1]
            words = [w for w in words if rng.random() > 0.1] if rng.random() < 0.4 else list(words)
            if rng.random() < 0.2:
                rng.shuffle(words)
            text += words
        start = time.perf_counter()
        found = scanner.scan(" ".join(text))
        assert time.perf_counter() - start < 5 and all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_very_long_text_and_ties(spark, docs):
    filler, notice = "lorem ipsum dolor " * 60_000, "Released under the MIT License."
    found = L.scan(docs([(1, f"{filler}{notice} {filler}{notice}"), (1, notice), (1, notice)], "doc_id long, text string")).collect()
    assert sorted((r.license, r.first_word) for r in found) == [("MIT", 0), ("MIT", 0), ("MIT", 180_000), ("MIT", 360_005)]
