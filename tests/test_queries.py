import html
import itertools
import json
import math
import random
import re

import pytest

from corpusloom.catalogue import ORACLES, QUERIES
from corpusloom.plans.corpus import _paged
from corpusloom.plans.vectors import _arms, _hits

from .oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    same(QUERIES[name](spark, data), connect(data), ORACLES[name])


def test_coverage_matrix_of_unlabelled_and_null_groups(spark, tmp_path):
    spark.createDataFrame([(1, "en", "a"), (2, "en", "a"), (3, "en", None), (4, None, "b"), (5, "de", "b"), (None, "de", "b")], "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, None), (4, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    same(QUERIES["coverage_matrix"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["coverage_matrix"])


@pytest.mark.parametrize("text", ["Erßie ist", "ŉ ǰ ΐ", "ﬃ ß", "ᾀᾳ ῳx", "𐐨ß 😀", "straße", "", None])
def test_judge_prompts_capitals(spark, tmp_path, text):
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same(QUERIES["judge_prompts"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["judge_prompts"])


def test_every_query_without_sql_is_tested_here():
    assert set(QUERIES) - set(ORACLES) == {"answer_flow", "bootstrap_ci", "chunk_header_aware", "compare_all_metrics", "compare_metrics", "html_to_text_sections"}


def test_chunk_header_aware(spark, data):
    """Chunks are trimmed spans of their pages, in order, no longer than the arm allows, and lose no word but those of headings."""
    pages = {r.doc_id: r.text for r in _paged(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    chunks = sorted(QUERIES["chunk_header_aware"](spark, data).collect(), key=lambda r: (r.doc_id, r.char_end))
    assert len({r.chunk_id for r in chunks}) == len(chunks) > len(pages) / 2
    seen = {i: bytearray(len(t)) for i, t in pages.items()}
    for r, after in zip(chunks, chunks[1:] + [None]):
        text = pages[r.doc_id]
        assert 0 <= r.char_start < r.char_end <= len(text) and text[r.char_start : r.char_end].strip() == text[r.char_start : r.char_end]
        assert r.char_end - r.char_start <= 1600 and r.heading_path.startswith(text[2 : text.index("\n")])
        if after and after.doc_id == r.doc_id:
            assert after.char_start > r.char_start
        seen[r.doc_id][r.char_start : r.char_end] = b"\1" * (r.char_end - r.char_start)
    for i, text in pages.items():
        at = 0
        for line in text.splitlines(keepends=True):
            if not line.startswith("#"):
                assert all(seen[i][at + n] or c.isspace() for n, c in enumerate(line))
            at += len(line)


def test_html_to_text_sections(spark, data):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    found = QUERIES["html_to_text_sections"](spark, data).collect()
    assert sorted(r.page_id for r in found) == sorted(pages)
    for r in found:
        page = pages[r.page_id]
        assert r.title == html.unescape(re.search("<title>(.*?)</title>", page, re.S)[1]).strip()
        shown = re.sub(r"<(script|style)\b.*?</\1>|<title>.*?</title>|<!--.*?-->|<[^>]*>", "", page, flags=re.S)
        article = re.sub("<[^>]*>", "", re.search("<article>(.*)</article>", page, re.S)[1])
        letters = lambda t: sum(not c.isspace() for c in html.unescape(t))
        assert letters(article) <= r.chars <= 2 * letters(shown) and r.sections >= 1


def _interval(pairs):
    """Ends of 10,000 resampled differences, drawn one by one."""
    draw, n = random.Random(42), len(pairs)
    deltas = []
    for _ in range(10_000):
        picked = [pairs[draw.randrange(n)] for _ in range(n)]
        deltas.append(sum(b for _, b in picked) / n - sum(a for a, _ in picked) / n)
    deltas.sort()
    return deltas[249], deltas[9749]


def test_bootstrap_ci(spark, data):
    pairs = [(float(r.a), float(r.b)) for r in _arms(spark, data).orderBy("query_id").collect()]
    (row,) = QUERIES["bootstrap_ci"](spark, data).collect()
    a, b = sum(x > y for x, y in pairs), sum(x < y for x, y in pairs)
    p = min(1, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))
    assert row.n == len(pairs) and (row.low, row.high, row.p) == pytest.approx((*_interval(pairs), p))


def test_compare_metrics(spark, data):
    """The test's p against all signs of the ranks."""
    pairs = [(r.rr_a, r.rr_b) for r in _arms(spark, data).orderBy("query_id").collect()]
    (row,) = QUERIES["compare_metrics"](spark, data).collect()
    assert row.n == len(pairs) and (row.a, row.b) == pytest.approx(tuple(sum(x) / len(pairs) for x in zip(*pairs)))
    assert (row.low, row.high) == pytest.approx(_interval(pairs))
    deltas = [y - x for x, y in pairs if x != y]
    sizes = sorted(abs(d) for d in deltas)
    ranks = [sum(i for i, s in enumerate(sizes, 1) if s == abs(d)) / sizes.count(abs(d)) for d in deltas]
    off = lambda signs: abs(sum(r for r, s in zip(ranks, signs) if s) - sum(ranks) / 2)
    every = [off(signs) for signs in itertools.product((False, True), repeat=len(ranks))]
    assert row.p == pytest.approx(sum(x >= off([d > 0 for d in deltas]) - 1e-9 for x in every) / len(every))


def test_compare_all_metrics(spark, data):
    found = QUERIES["compare_all_metrics"](spark, data).collect()
    assert len({(r.slice, r.metric) for r in found}) == len(found) and len({r.metric for r in found}) == 32
    for r in found:
        if r.delta is None:
            assert r.p is None and r.wording.startswith("not tested")
            continue
        assert r.delta == pytest.approx(r.b - r.a) and r.low <= r.high
        if r.kind == "binary":
            assert r.delta * r.n == pytest.approx(r.b_only - r.a_only)
            k = r.a_only + r.b_only
            assert r.p == pytest.approx(min(1, 2 * sum(math.comb(k, i) for i in range(min(r.a_only, r.b_only) + 1)) / 2**k))


def test_answer_flow(spark, data):
    top = {r.query_id: r.score for r in _hits(spark, data).filter("rank = 1").collect()}
    found = QUERIES["answer_flow"](spark, data).collect()
    assert sorted(r.query_id for r in found) == sorted(top)
    for r in found:
        result = json.loads(r.result)
        assert result["question"] == f"What does passage {r.query_id} say?"
        if top[r.query_id] >= 0.5:
            assert (result["citations"], result["dropped_markers"]) == ([1, 2], [9])
        else:
            assert not result.get("citations")


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
