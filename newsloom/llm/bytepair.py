"""Byte-level BPE ids of texts, long texts in parts.

The ids are those of the tokenizer file with special tokens in a text recognised. The vocabulary comes as ranks, whose
merges are the same; a single space between two words always begins a new piece of the pattern, so long texts are cut there.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array

import numpy as np

#: Characters of a text that are encoded at once at least.
PART = 1 << 20
SPECIAL = "<|endoftext|>"
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BytePair:
    """Ids as runs of little-endian unsigned numbers: two bytes each where the vocabulary allows it, else four."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or vocabulary_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = len(ranks) + 1
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.kind = np.dtype(self.code).newbyteorder("<")
        self.encoding = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def plain(self, text: str) -> bytes:
        ids = self.encoding.encode(text, allowed_special="all") if SPECIAL in text else self.encoding.encode_ordinary(text)
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        if len(text) <= PART:
            return self.plain(text)
        parts, at = [], 0
        while at < len(text):
            border = _BORDER.search(text, at + PART)
            upto = border.start() if border else len(text)
            parts.append(self.plain(text[at:upto]))
            at = upto
        return b"".join(parts)


_held: dict[str | None, BytePair] = {}


def encoder(path: str | None = None) -> BytePair:
    """One encoder for each Python worker and vocabulary."""
    if path not in _held:
        _held[path] = BytePair(path)
    return _held[path]
