"""Document files: a registry of readers by extension, manifests, and records of normalized documents."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.markdown import DocumentError
from .docx import to_markdown
from .html import to_text

Reader = Callable[[bytes, str], tuple[str | None, str]]


def read_markdown(data: bytes, name: str) -> tuple[str | None, str]:
    """Text as it stands; bytes that are not UTF-8 raise."""
    return None, data.decode("utf-8")


def read_plain(data: bytes, name: str) -> tuple[str | None, str]:
    return None, data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿").strip("\n") + "\n"


def read_html(data: bytes, name: str) -> tuple[str | None, str]:
    return to_text(data.decode("utf-8"))


def read_docx(data: bytes, name: str) -> tuple[str | None, str]:
    return to_markdown(data)


class Readers(dict):
    """Readers by lower-case extension; an unknown one raises."""

    def of(self, path: str) -> Reader:
        extension = "." + path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
        if extension not in self:
            raise DocumentError(f"no reader for {extension or 'files without extension'}: {path}")
        return self[extension]


def default_readers() -> Readers:
    """Markdown, plain text, HTML and DOCX; readers of other formats (PDF) are added by their extension."""
    return Readers({".docx": read_docx, ".md": read_markdown, ".markdown": read_markdown, ".txt": read_plain, ".html": read_html, ".htm": read_html})


def scan(spark: SparkSession, path: str, readers: Readers | None = None, glob: str | None = None) -> DataFrame:
    """(path, title, text) of the files below ``path``; files that can't be read, or hold no text, raise with their path."""
    readers = readers or default_readers()

    def read(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    title, text = readers.of(name)(data.as_py(), name)
                except ValueError as e:  # bytes that are not text, or no file of the format
                    raise DocumentError(f"{name}: {e}") from e
                if not text.strip():
                    raise DocumentError(f"{name}: no text")
                rows.append((name, " ".join((title or "").split()) or name.rpartition("/")[2].rpartition(".")[0], text))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*rows)) or [[]] * 3)], names=["path", "title", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = files.option("pathGlobFilter", glob) if glob else files
    return files.load(path).select("path", "content").mapInArrow(read, "path string, title string, text string")


def manifest(spark: SparkSession, path: str, excluded: list[str] = ()) -> DataFrame:
    """Documents that a manifest accepts; one that is excluded by id, or stands in an ``excluded`` folder, raises when read."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
    bad = F.col("source_id").isin(list(excluded)) | F.array_contains(F.split("file", "/"), "excluded")
    return rows.withColumn("file", F.when(bad, F.raise_error(F.concat(F.lit("excluded document in the manifest: "), "file"))).otherwise(F.col("file")))


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII characters as they are."""
    df.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; a broken line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


SEPARATOR = " > "


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines; ``heading_path`` is an array there."""
    write_records(chunks.withColumn("heading_path", F.when(F.col("heading_path") == "", F.array().cast("array<string>")).otherwise(F.split("heading_path", SEPARATOR))), path)


def load_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks as they were before ``write_chunks``; ``schema`` has the heading path as array<string>."""
    return read_records(spark, path, schema).withColumn("heading_path", F.array_join("heading_path", SEPARATOR))
