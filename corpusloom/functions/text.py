"""Text functions as Spark columns: everything here stays inside the JVM and whole-stage code generation.

Offsets count code points and are half open. White space is what Python's ``str.isspace`` takes for it, spelled out, since
``\\s`` means less in Java's expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0  -     　"
#: The same, character by character, for trimming.
SPACES = "".join(chr(c) for c in (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
MARKER = r"\[(\d+)\]"
#: Fixed value: what is taken for a link or image. Its text is group 1; the address has one level of parentheses, the title is optional.
LINK = r'!?\[([^\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+"[^"\n]*")?\)'
#: Letters that only Vietnamese uses (and every vowel with a tone mark).
VIETNAMESE = "ăâđêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ"
REDACTED = "[REDACTED]"
#: The shape of the provider's API keys.
API_KEY = r"AIza[0-9A-Za-z_\-]{35}"


def unix_newlines(text: Column) -> Column:
    """CRLF and CR as LF, without one leading byte order mark."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\A﻿", "")


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


#: Letters whose upper case in Java is several letters (ß as SS), with their single capital where Unicode has one, else as they are.
_CAPITALS = {c: "ẞ" if c == "ß" else t if len(t := c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter, so that no length changes, as SQL engines with Unicode's simple mapping have it."""
    capitals = F.create_map(*[F.lit(x) for pair in _CAPITALS.items() for x in pair])
    by_letter = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(capitals, c), F.upper(c))), "")
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(by_letter)


def trimmed_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end, text) of ``text[start:end]`` moved inward over white space."""
    part = F.substring(text, start + 1, end - start)
    lead = F.length(part) - F.length(F.ltrim(part, F.lit(SPACES)))
    kept = strip(part)
    return F.struct((start + lead).alias("char_start"), (start + lead + F.length(kept)).alias("char_end"), kept.alias("text"))


def strip_links(text: Column) -> Column:
    """Links and images as their text; for text without code fences."""
    return F.regexp_replace(text, LINK, "$1")


def passage_body(embed_text: Column, heading: Column) -> Column:
    """The text without the heading line and the empty line that precede it for embedding."""
    head = F.concat(heading, F.lit("\n\n"))
    return F.when((heading != "") & F.startswith(embed_text, head), F.substring(embed_text, F.length(head) + 1, F.length(embed_text))).otherwise(embed_text)


def excerpt(text: Column, limit: int = 300) -> Column:
    """A prefix of the stripped text of at most ``limit`` characters that ends at a word's end where there is one."""
    t = strip(text)
    cut = F.substring(t, 1, limit)
    inside = ~F.rlike(F.substring(t, limit + 1, 1), F.lit(f"[{SPACE}]"))
    back = F.regexp_extract(cut, r"(?s)\A(.+)[ \n]", 1)
    ended = F.when(inside & (back != ""), back).otherwise(cut)
    return F.when(F.length(t) <= limit, t).otherwise(F.rtrim(ended, F.lit(SPACES)))


def sentences(text: Column) -> Column:
    """Stripped sentences, none empty: a new line begins after a mark that ends one, with its citation markers, and each line is one."""
    lines = F.split(F.regexp_replace(text, rf"([.!?](?:[ \t]*{MARKER})*)(?:[{SPACE}]|\z)", "$1\n"), "\n")
    return F.filter(F.transform(lines, strip), lambda s: s != "")


def markers(text: Column) -> Column:
    """Citation numbers from 1 on, each once, as they first appear; for text without code."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda n: n.try_cast("int"))
    return F.array_distinct(F.filter(found, lambda n: n >= 1))


def uncited_sentences(text: Column, least_words: int = 5) -> Column:
    """How many sentences of ``least_words`` words or more have no marker; for text without code."""
    bare = F.filter(sentences(text), lambda s: ~F.rlike(s, F.lit(r"\[0*[1-9]\d*\]")))
    return F.size(F.filter(bare, lambda s: F.size(F.regexp_extract_all(F.regexp_replace(s, MARKER, ""), F.lit(r"(?U)\w+"), F.lit(0))) >= least_words))


def remove_markers(text: Column, numbers: list[int]) -> Column:
    """Without the given markers and the blanks before them; for text without code."""
    return F.regexp_replace(text, rf"[ \t]*\[0*(?:{'|'.join(map(str, numbers))})\]", "") if numbers else text


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, and one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4.0).cast("int"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(model: Column, task: Column, text: Column) -> Column:
    return sha256(F.concat_ws("|", model, task, text))


def redact(text: Column, key: str | None = None) -> Column:
    """Without the configured key and anything of the shape of a key."""
    if key:
        text = F.replace(text, F.lit(key), F.lit(REDACTED))
    return F.regexp_replace(text, API_KEY, REDACTED)


def has_vietnamese(text: Column) -> Column:
    """For text in composed form (see ``normal_form``)."""
    return F.rlike(text, F.lit(f"[{VIETNAMESE}{VIETNAMESE.upper()}]"))


def detect_language(text: Column) -> Column:
    """'vi' for text with any Vietnamese letter, else 'en'. Only text with combining marks goes through Python."""
    from .udfs import nfc

    composed = F.when(F.rlike(text, F.lit(r"\p{M}")), nfc(text)).otherwise(text)
    return F.when(has_vietnamese(composed), F.lit("vi")).otherwise(F.lit("en"))


def collection_name(name: Column) -> Column:
    """A name of letters, digits, dots, dashes and underscores that begins and ends with a letter or digit."""
    return F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9._-]+", "-"), r"\A[^a-zA-Z0-9]+|[^a-zA-Z0-9]+\z", "")


def run_id(at: Column, split: Column, arm: Column, mode: Column, commit: Column) -> Column:
    return F.concat_ws("-", F.date_format(at, "yyyyMMdd"), split, arm, mode, F.substring(commit, 1, 7))
