"""Chunkers and normalizers as table functions of SQL: ``SELECT ... FROM documents, LATERAL chunk(text)``.

A chunker is any Python function of a text that yields rows (char_start, char_end, heading_path); it gets a name in a registry,
and every name is a table function of the session. A normalizer is a function of a text that returns the fields of
``NORMALIZED``. Null and empty texts have no chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import markdown as M
from .chunking import SPAN, FixedSize, HeaderAware, _header_rows, number_chunks

Cut = Callable[[str], Iterable[tuple[int, int, str]]]
NORMALIZED = "text string, document_name string, source_url string, wrapper_title string"


def header_function(arm: HeaderAware = HeaderAware()):
    """A table function (SPAN) of header-aware chunks."""

    class Chunks:
        def eval(self, text: str):
            if text:
                yield from _header_rows(text, arm)

    return F.udtf(Chunks, returnType=SPAN, useArrow=True)


def cut_function(cut: Cut):
    """A table function (window, char_start, char_end, heading_path, display_text) of a chunker; spans outside the text raise."""

    class Chunks:
        def eval(self, text: str):
            for n, (start, end, path) in enumerate(cut(text) if text else ()):
                if not 0 <= start < end <= len(text):
                    raise ValueError(f"a chunk from {start} to {end} of a text of {len(text)} characters")
                yield n, start, end, path, text[start:end]

    return F.udtf(Chunks, returnType="window int, char_start int, char_end int, heading_path string, display_text string", useArrow=True)


def windows(arm: FixedSize = FixedSize()) -> Cut:
    """Fixed windows as a chunker: trimmed, none empty, the last one reaches the end."""
    spaces = T.SPACES

    def cut(text: str):
        step = arm.size - arm.overlap
        for n in range(1 + -(-max(len(text) - arm.size, 0) // step)):
            part = text[n * step : n * step + arm.size]
            start = n * step + len(part) - len(part.lstrip(spaces))
            end = n * step + len(part.rstrip(spaces))
            if start < end:
                yield start, end, ""

    return cut


def normalizer_function(normalize: Callable[[str], dict] = M.normalize):
    """A table function (NORMALIZED and error) of a normalizer: one row, where ``error`` says why a text is no such page."""

    class Normalized:
        def eval(self, text: str):
            try:
                page = normalize(text or "")
            except M.DocumentError as e:
                yield None, None, None, None, str(e)
            else:
                yield page["text"], page.get("document_name"), page.get("source_url"), page.get("wrapper_title"), None

    return F.udtf(Normalized, returnType=f"{NORMALIZED}, error string", useArrow=True)


def register(spark: SparkSession, chunkers: dict[str, Cut] | None = None, normalizers: dict[str, Callable[[str], dict]] | None = None) -> list[str]:
    """Table functions ``chunk`` (header-aware), ``window_chunk`` and ``normalize_page``, and those of your own by name; all names."""
    found = {"chunk": header_function(), "window_chunk": cut_function(windows()), "normalize_page": normalizer_function()}
    found |= {name: cut_function(cut) for name, cut in (chunkers or {}).items()}
    found |= {name: normalizer_function(f) for name, f in (normalizers or {}).items()}
    for name, function in found.items():
        spark.udtf.register(name, function)
    return sorted(found)


def chunked(docs: DataFrame, function: str, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of a registered function with ids and hashes; ``name`` becomes part of the ids."""
    spark = docs.sparkSession
    rows = spark.sql(f"SELECT d.id AS `{id_col}`, c.* FROM {{docs}} AS d, LATERAL {function}(d.text) AS c", docs=docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return number_chunks(rows, name, id_col)
