import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as cli
from corpusloom.sources import documents as D
from corpusloom.sources.docx import to_markdown
from corpusloom.sources.models import Caller, ModelError, ProviderError, QuotaError, Reply

GOOD = json.dumps({"insufficient": False, "answer": "It is so [1].", "cited_passages": [1], "missing_information": ""})


def good(prompt):
    return Reply(GOOD, prompt_tokens=10, output_tokens=5)


def refusing(prompt):
    return Reply(json.dumps({"insufficient": True, "answer": "", "cited_passages": [], "missing_information": "the year"}))


def busy(prompt):
    raise ProviderError(429, "slow down", retry_after="7")


def test_attempts_then_fallback():
    waits = []
    caller = Caller(busy, good, attempts=3, sleep=waits.append, jitter=lambda: 0.5)
    assert caller("x") == GOOD and waits == [7.0, 7.0]
    assert caller.totals == {"calls": 4, "retries": 2, "fallbacks": 1, "waited": 14.0, "prompt_tokens": 10, "output_tokens": 5, "missing_counts": 0} and len(caller.errors) == 3
    with pytest.raises(QuotaError):
        Caller(busy, busy, attempts=1, sleep=waits.append)("x")


def test_errors_that_are_not_tried_again():
    def broken(prompt):
        raise ProviderError(400, "bad request")

    caller = Caller(broken, good, sleep=lambda s: None)
    with pytest.raises(ModelError, match="400"):
        caller("x")
    assert caller.totals["calls"] == 1 and caller.totals["fallbacks"] == 0
    for reply in (Reply("half", finish="length"), Reply("  ")):
        with pytest.raises(ModelError):
            Caller(lambda p, r=reply: r)("x")


def test_command_line(tmp_path, capsys):
    hits = tmp_path / "hits.json"
    hits.write_text(json.dumps([{"score": 0.9, "text": "It is so.", "title": "A page"}]))
    here = f"{__name__}:"
    call = lambda model, *more: cli.main(["ask", "Is it so?", "--hits", str(hits), "--model", here + model, *more])
    assert call("good") == 0 and capsys.readouterr().out == "It is so [1].\n\n[1] A page\n"
    assert call("refusing") == 3 and "missing: the year" in capsys.readouterr().out
    assert call("good", "--threshold", "0.95", "--json") == 3 and json.loads(capsys.readouterr().out)["insufficient_reason"] == "retrieval_gate"
    assert call("nothing") == 2 and cli.main(["ask", "x", "--hits", "/none", "--model", here + "good"]) == 2
    assert cli.main(["run", "no_such_query", "/none"]) == 2


def docx(body):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_docx(spark, tmp_path):
    p = lambda text, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda text: f"<w:tc>{p(text)}</w:tc>"
    body = p("A  title", '<w:pStyle w:val="Heading1"/>') + p("Some text.") + p("an item", "<w:numPr/>") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2|3')}</w:tr></w:tbl>" + p("  ")
    assert to_markdown(docx(body)) == ("A title", "# A title\n\nSome text.\n\n- an item\n\n| a | b |\n|---|---|\n| 1 | 2\\|3 |\n")
    with pytest.raises(ValueError, match="not a DOCX"):
        to_markdown(b"plain")
    (tmp_path / "x.docx").write_bytes(docx(body))
    assert [(r.title, r.text[:9]) for r in D.scan(spark, str(tmp_path)).collect()] == [("A title", "# A title")]
    (tmp_path / "y.docx").write_bytes(docx(p(" ")))
    with pytest.raises(Exception, match="no text"):
        D.scan(spark, str(tmp_path)).collect()


def test_chunks_of_a_file(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "A > B", "x"), ("c2", "", "y")], "chunk_id string, heading_path string, display_text string")
    D.write_chunks(rows, str(tmp_path / "chunks"))
    back = D.load_chunks(spark, str(tmp_path / "chunks"), "chunk_id string, heading_path array<string>, display_text string")
    assert sorted(back.collect()) == sorted(rows.collect()) and back.filter(F.col("heading_path") == "A > B").count() == 1
