"""Ids of a byte-level BPE tokenizer file, equal to those of the ``tokenizers`` library.

Texts made of common characters are cut into pre-tokens by one regular
expression and each distinct pre-token is merged once per worker (a bounded
cache); any other text goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from conflictlake.llm.common import kept_by_worker

CACHE_ENTRIES = 150_000

# Fixed values of the byte-level pre-tokenizer: contractions, letters, digits, others, space.
_PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Where Python's character classes equal the pre-tokenizer's: ASCII, Latin letters, common punctuation.
_RARE = re.compile("[^\t-\r\x20-\x7eÀ-ÖØ-öø-ňŊ-ƿ‐-‧]")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Merged(dict):
    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self._encode(piece)).tobytes()
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[piece] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        of = _byte_of()
        ranks = {bytes(of[c] for c in tok): i for tok, i in spec["model"]["vocab"].items()
                 if all(c in of for c in tok)}
        self._path, self._exact = path, None
        core = tiktoken.Encoding("llm", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._merged = _Merged(core._encode_single_piece)
        self._special = [t["content"] for t in spec["added_tokens"]]
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self._plain = plain and not spec["model"].get("ignore_merges")

    def _library(self, text: str) -> list[int]:
        if self._exact is None:  # few texts need it
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._path)
            self._exact.no_padding()
            self._exact.no_truncation()
        return self._exact.encode(text, add_special_tokens=False).ids

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self._plain or _RARE.search(text) or any(s in text for s in self._special):
            return np.array(self._library(text), "<u4").tobytes()
        return b"".join(map(self._merged.__getitem__, _PIECES.findall(text)))

    def count(self, text: str) -> int:
        return len(self.id_bytes(text)) // 4


@kept_by_worker(4)
def load(path: str) -> ByteBpe:
    """One tokenizer per worker process and file."""
    return ByteBpe(path)
