"""HTML as Markdown-like text, with the standard library's parser, over Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import released, slices

_BLOCKS = set("address article aside blockquote br div dl dt dd fieldset figure footer form header hr li main nav ol p pre section table tr ul".split())
_SILENT = {"script", "style", "template", "noscript"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.silent = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "title":
            self.in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag in ("td", "th"):
            self.parts.append(" | ")
        elif tag in _BLOCKS:
            self.parts.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in _BLOCKS or re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.parts.append(re.sub(r"\s+", " ", data))


def to_text(html: str) -> tuple[str, str]:
    """(title, text) of a page; the text ends in one line end, and is empty where the page says nothing."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = [line.strip() for line in "".join(parser.parts).split("\n")]
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")
    return " ".join("".join(parser.title).split()), body + "\n" if body else ""


def html_documents(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, text) of each row; null pages give null text."""

    def convert(batches):
        for batch in slices(batches):
            out = [(None, None) if h is None else to_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=[id_col, "title", "text"])

    rows = pages.select(id_col, html_col)
    return rows.mapInArrow(lambda batches: released(convert(batches)), f"{id_col} {rows.schema[id_col].dataType.simpleString()}, title string, text string")
