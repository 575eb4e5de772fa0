"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import json
import re

import numpy as np

#: Pre-tokens of the byte-level vocabulary: a fixed value, as its files state it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone split alike whatever version of Unicode a library has.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞€]*")


def _bytes_of_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """ids(text) as the tokenizers library gives them for the file at path, without added special tokens.

    Most texts go through tiktoken with the file's own vocabulary, where ranks are ids; a text with special-token strings or
    rarer characters goes through tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        letters = _bytes_of_letters()
        ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = tuple(special)

    def ids(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def array(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), dtype="<u4")
