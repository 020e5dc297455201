"""DOCX files as Markdown text, with the standard library alone: headings by their styles, list items, tables as rows of cells."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Characters a part may hold unpacked; more is taken for a bomb.
MOST = 200_000_000


def _paragraph(p) -> str:
    parts = []
    for node in p.iter():
        if node.tag == f"{_W}t":
            parts.append(node.text or "")
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            parts.append("\n")
        elif node.tag == f"{_W}tab":
            parts.append("\t")
    return "".join(parts).strip()


def _style(p) -> tuple[int, bool]:
    """(heading level or 0, whether it is a list item)."""
    style = p.find(f"{_W}pPr/{_W}pStyle")
    name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
    level = name.removeprefix("heading")
    found = 1 if name == "title" else int(level) if level != name and level.isdigit() else 0
    return min(found, 6), p.find(f"{_W}pPr/{_W}numPr") is not None


def to_markdown(data: bytes) -> tuple[str | None, str]:
    """(title: the first heading, text). What is no DOCX file raises ValueError."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            part = archive.getinfo("word/document.xml")
            if part.file_size > MOST:
                raise ValueError("the document is too large")
            body = ElementTree.fromstring(archive.read(part)).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"not a DOCX file: {e}") from e
    title, blocks = None, []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and (text := _paragraph(node)):
            level, item = _style(node)
            if level:
                text = " ".join(text.split())
                title = title or text
            blocks.append(f"{'#' * level} {text}" if level else f"- {text}" if item else text)
        elif node.tag == f"{_W}tbl":
            rows = [[" ".join(_paragraph(cell).split()).replace("|", "\\|") for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            if rows:
                blocks.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
    return title, "\n\n".join(blocks) + "\n" if blocks else ""
