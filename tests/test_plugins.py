import pytest

from corpusloom.operators import chunking as C
from corpusloom.operators import markdown as M
from corpusloom.operators import plugins as P
from corpusloom.plans import corpus


@pytest.fixture(scope="module")
def pages(spark, data):
    P.register(spark, chunkers={"halves": lambda t: [(0, len(t) // 2, "first"), (len(t) // 2, len(t), "second")], "outside": lambda t: [(0, len(t) + 1, "")]}, normalizers={"shout": lambda t: {"text": t.upper()}})
    return corpus._paged(spark.read.parquet(f"{data}/documents.parquet"))


def test_lateral_equals_the_operator(spark, pages):
    pages.createOrReplaceTempView("plug_pages")
    got = spark.sql("SELECT doc_id, window, char_start, char_end, heading_path, body, cuts_code FROM plug_pages, LATERAL chunk(text)")
    columns = ["doc_id", "char_start", "char_end", "heading_path", "body", "cuts_code"]
    want = {tuple(r) for r in C.header_chunks(pages).select(*columns).collect()}
    assert want <= {tuple(r) for r in got.select(*columns).collect()}  # numbering drops repeated passages
    ids = ["doc_id", "chunk_id", "char_start", "char_end", "content_hash"]
    assert sorted(map(tuple, P.chunked(pages, "chunk", "header-1600").select(*ids).collect())) == sorted(map(tuple, C.header_chunks(pages).select(*ids).collect()))


def test_windows_equal_the_operator(spark, data, pages):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = ["doc_id", "char_start", "char_end", "display_text"]
    assert sorted(map(tuple, P.chunked(docs, "window_chunk", "fixed-1600").select(*columns).collect())) == sorted(map(tuple, C.number_chunks(C.fixed_windows(docs), "fixed-1600").select(*columns).collect()))


def test_own_chunkers_and_normalizers(spark, pages):
    df = spark.createDataFrame([(1, "abcd"), (2, None), (3, ""), (4, "😀é")], "doc_id long, text string")
    assert sorted((r.doc_id, r.display_text, r.heading_path) for r in P.chunked(df, "halves", "h").collect()) == [(1, "ab", "first"), (1, "cd", "second"), (4, "é", "second"), (4, "😀", "first")]
    with pytest.raises(Exception, match="a chunk from 0 to 5"):
        P.chunked(df.filter("doc_id = 1"), "outside", "o").collect()
    df.createOrReplaceTempView("plug_docs")
    assert {tuple(r) for r in spark.sql("SELECT doc_id, n.text FROM plug_docs, LATERAL shout(plug_docs.text) AS n").collect()} == {(1, "ABCD"), (2, ""), (3, ""), (4, "😀É")}
    rows = spark.sql("SELECT doc_id, n.text, n.error FROM plug_docs, LATERAL normalize_page(plug_docs.text) AS n").collect()
    for r in rows:
        try:
            assert r.text == M.normalize({1: "abcd", 4: "😀é"}.get(r.doc_id, ""))["text"]
        except M.DocumentError as e:
            assert r.error == str(e) and r.text is None
