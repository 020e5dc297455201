import pytest
from pyspark.sql import functions as F

from corpusloom.functions import citations as C
from corpusloom.functions import text as T
from corpusloom.functions.udfs import code_aware_markers, code_aware_uncited


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["a\r\nb\rc", "﻿x", "﻿﻿x", ""])
def test_unix_newlines(spark, text):
    assert one(spark, text, T.unix_newlines) == text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")


@pytest.mark.parametrize("text", ["  a\t b ", "a \x1c b  c", "", "　x\n\n"])
def test_collapse_whitespace(spark, text):
    assert one(spark, text, T.collapse_whitespace) == " ".join(text.split())


def reference_excerpt(text, limit=300):
    text = text.strip()
    if len(text) <= limit:
        return text
    cut = text[:limit]
    at = max(cut.rfind(" "), cut.rfind("\n"))
    return (cut[:at] if not text[limit].isspace() and at > 0 else cut).rstrip()


@pytest.mark.parametrize("text", ["short", "word " * 100, "x" * 400, "a" * 299 + " b", "a" * 300 + " b", "  " + "ab\n" * 200, " " * 400])
def test_excerpt(spark, text):
    assert one(spark, text, T.excerpt) == reference_excerpt(text)


def test_links(spark):
    assert one(spark, "see [a](u) ![b](v \"t\") [c](x(y)z) [d] (e)", T.strip_links) == "see a b c [d] (e)"


def test_markers_and_sentences(spark):
    text = "One two three four five. Six [2][1] seven [0] eight nine ten [2]!\nEleven"
    assert one(spark, text, T.markers) == C.extract_markers(text) == [2, 1]
    assert one(spark, text, T.sentences) == C.split_sentences(text)
    assert one(spark, text, T.uncited_sentences) == C.uncited_sentences(text) == 1


@pytest.mark.parametrize(
    "text, found",
    [("`[1]` [2]", [2]), ("```\n[1]\n```\n[2]", [2]), ("```\n[1]", []), ("``a ` [1]`` [3]", [3]), ("~~~\n[1]\n```\n~~~\n[4]", [4]), ("` [5]", [5])],
)
def test_markers_outside_code(spark, text, found):
    assert C.extract_markers(text) == found
    assert one(spark, text, code_aware_markers) == found


def test_code_aware_uncited(spark):
    assert one(spark, "one two three four five `[1]`. one two three four five [1].", code_aware_uncited) == 1


def test_resolve_citations():
    assert C.resolve("a [1] b `[9]` c  [9] d [0].", [3, 1], 3) == ("a [1] b `[9]` c d [0].", [1, 3], [9])
    assert C.resolve("none", [], 5) == ("none", [], [])


def test_language(spark):
    import unicodedata

    assert one(spark, "plain", T.detect_language) == "en"
    assert one(spark, "tiếng Việt", T.detect_language) == "vi"
    assert one(spark, unicodedata.normalize("NFD", "tiếng"), T.detect_language) == "vi"


def test_redact_and_tokens(spark):
    assert one(spark, "k AIza" + "a" * 35 + " own", lambda t: T.redact(t, "own")) == "k [REDACTED] [REDACTED]"
    assert [one(spark, t, T.estimated_tokens) for t in ("", "abcd", "abcde")] == [1, 1, 2]


def test_names(spark):
    assert one(spark, "--fixed 1600/model:a--", T.collection_name) == "fixed-1600-model-a"


def test_passage_body(spark):
    df = spark.createDataFrame([("A > B\n\nbody", "A > B"), ("body", "A > B"), ("body", "")], "t string, h string")
    assert [r.x for r in df.select(T.passage_body(F.col("t"), F.col("h")).alias("x")).collect()] == ["body"] * 3
