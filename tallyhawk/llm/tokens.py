"""Token ids of public tokenizer files, with a cache of word pieces.

The byte-level files split text at white space before merging, so a text is a
row of pieces (one optional space and a run of other characters, or a run of
white space) that are encoded independently. Each worker keeps the ids of the
pieces it has met, up to ``CACHE_PIECES``; prose repeats most of them. Texts
that hold a special token's string go through the tokenizer itself.
"""

from __future__ import annotations

import re

import numpy as np

#: White space of the tokenizer's own pattern (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CACHE_PIECES = 400_000
_LOADED: dict = {}


class PieceEncoder:
    """Ids of a byte-level BPE file, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        byte_of = _byte_alphabet()
        skip = set(self.special)
        ranks = {bytes(byte_of[c] for c in token): i
                 for token, i in spec["model"]["vocab"].items() if token not in skip}
        self.core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        out = []
        for piece in _PIECES.findall(text):
            got = cache.get(piece)
            if got is None:
                got = cache[piece] = np.array(self.core.encode_ordinary(piece), dtype="<u2").tobytes()
            out.append(got)
        return b"".join(out)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others count up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]
