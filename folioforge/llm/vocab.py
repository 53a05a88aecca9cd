"""Byte-level BPE vocabularies of public tokenizers: exact encoding and counting, segment by segment.

The files are read on the driver from a path given as a parameter and sent to the workers (under 1 MB each).
"""

from __future__ import annotations

import base64
import os
from pathlib import Path

import numpy as np

#: Where the tokenizers' files are; every function that reads one takes its path.
TOKENIZERS = os.environ.get("FOLIOFORGE_TOKENIZERS", "/opt/tokenizers")

# How the byte-level BPE vocabularies split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The Unicode white space of that splitter (Python's \s also has U+001C to U+001F).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: White space, then what isn't: no piece of SPLIT has white space after anything else, so such segments encode on their own.
SEGMENT = rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file (`base64 id` lines)."""
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Memo(dict):
    """Values of `make`, kept for short keys; beyond `most` entries those go that weren't asked for since the last half of them came."""

    def __init__(self, make, most: int = 300_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if 2 * len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def tiktoken_of(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Exact ids of texts as int32 bytes; each distinct segment is encoded once as long as the memo holds it."""

    def __init__(self, ranks: dict[bytes, int]):
        import re

        enc = tiktoken_of(ranks).encode_ordinary
        self.split = re.compile(SEGMENT).findall
        self.memo = Memo(lambda s: np.array(enc(s), dtype=np.int32).tobytes())

    def bytes_of(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.split(text)))


class Counter:
    """Exact numbers of tokens of texts, by the same segments."""

    def __init__(self, ranks: dict[bytes, int]):
        import re

        enc = tiktoken_of(ranks).encode_ordinary
        self.split = re.compile(SEGMENT).findall
        self.memo = Memo(lambda s: len(enc(s)))

    def count(self, text: str | None) -> int:
        return sum(map(self.memo.__getitem__, self.split(text))) if text else 0
