"""Byte-pair encoding by a tokenizer file of the byte-level kind.

Merging is done by ``tiktoken`` on the vocabulary of the tokenizer file (a token's id is its merge
rank there), which is several times faster than the tokenizer itself and gives the same ids. Files
whose ids aren't ranks, or whose results differ on a probe, and texts that hold a special token's
string use the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Fixed value: the split pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's 1 Zebra, née 'Quux' —  x\n\n y\t42nd naïve #€!? don't go 中文 123456"


class Encoder:
    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        marks = _byte_marks()
        with open(tokenizer_file, encoding="utf-8") as f:
            vocab = {t: i for t, i in json.load(f)["model"]["vocab"].items() if t not in special}
        self.fast = None
        if all(c in marks for t in vocab for c in t):
            self.fast = self._ranked({bytes(marks[c] for c in t): i for t, i in vocab.items()})

    def _ranked(self, ranks: dict[bytes, int]):
        import tiktoken

        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return fast if fast.encode_ordinary(PROBE) == self.tok.encode(PROBE, add_special_tokens=False).ids else None

    def ids(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty give none."""
        if not text:
            return []
        if self.fast is None or (self.special and self.special.search(text)):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def raw(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return np.array(self.ids(text), "<u4").tobytes()


def _byte_marks() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)
