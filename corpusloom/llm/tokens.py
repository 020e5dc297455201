"""Token ids of whole texts by vocabulary files of the ``tokenizers`` library.

``tokenizers`` itself defines every id. For byte-level vocabularies whose ids follow the order of their merges, the same merges
are run by ``tiktoken``'s core, which is four times as fast; that order is verified when a file is opened. Texts with any
character for which the two libraries might cut differently go to ``tokenizers``, as does every text of another vocabulary.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

import numpy as np

from .common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPACE = r"\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿"
#: Characters beyond these, or the opening of a special token, send a text to ``tokenizers``.
_OTHER = re.compile(rf"[{_SPACE}\x00İƻ-\U0010ffff]|<\|")
#: How these two vocabularies cut texts (for Latin texts, in the syntax of ``re``).
_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BARE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BARE_CUT = re.compile(r"[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")  # words first, as most pieces are words
_END = "</w>"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; pass a path of your own to the operators to use another."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """ids of texts as bytes of little-endian unsigned 32-bit integers; ``most`` bounds the memo of lower-case words."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.words, self.most = _Words(self), most
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.core = self._core(json.load(f))

    @classmethod
    def of(cls, path: str, owner: str) -> "Encoder":
        """One encoder for each vocabulary and Python worker, as long as the worker serves its owner."""
        held = kept(owner)
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _core(self, file: dict):
        import tiktoken

        model, pre = file["model"], file.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        self.bare = model.get("end_of_word_suffix") == _END
        if self.bare:
            kinds = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
            known = kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _BARE} and steps[0]["invert"] and not steps[1]["use_regex"]
        else:
            known = not file.get("normalizer") and not model.get("end_of_word_suffix") and [s["type"] for s in steps] == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]
        if model.get("type") != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or not known:
            return None
        vocab, at = model["vocab"], _bytes_of()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        first = 512 if self.bare else 256
        if made != list(range(first, first + len(made))):
            return None
        # the end of a word is written as the byte 0, which these texts don't have
        ranks = {}
        for token, k in vocab.items():
            if k < first + len(made):
                end = self.bare and token.endswith(_END)
                raw = bytes(at[c] for c in (token[: -len(_END)] if end else token))
                if not (self.bare and b"\0" in raw):
                    ranks[raw + b"\0" if end else raw] = k
        if self.bare:
            ranks[b"\0"] = vocab["Ā"]
        return tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00" if self.bare else _SPACED, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.core is None or _OTHER.search(text):
            return self.whole(text)
        if self.bare:
            if not unicodedata.is_normalized("NFC", text):
                return self.whole(text)
            if len(self.words) > self.most:
                self.words.clear()
            return b"".join(map(self.words.__getitem__, _BARE_CUT.findall(text.lower())))
        return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes() if text else b""


def _ids(values: list[int]) -> bytes:
    return struct.pack(f"<{len(values)}I", *values)


class _Words(dict):
    """ids of words cut from lower-case texts."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = _ids(self.encoder.core._core_bpe.encode_single_piece((word + "\0").encode("utf-8")))
        return ids
