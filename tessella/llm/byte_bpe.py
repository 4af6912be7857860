"""Byte-level BPE ids of the 50k vocabulary.

The tiktoken file holds the same merges as the JSON file of the tokenizers library and is encoded
three times as fast; tests compare the two. The string of the special token inside a text counts as
that token, which is the JSON tokenizer's default.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np

SPECIAL = {"<|endoftext|>": 50256}
#: Runs longer than this go to the JSON file's library, whose matcher has no stack to exhaust.
LONG_RUN = re.compile(r"\s{5000}|\S{50000}")


def tokenizer_digest(name: str = "byte_bpe_50k") -> str:
    """Identifies the tokenizer in stored results: SHA-256 over both files that ids come from, the
    pattern that splits texts and this rule set."""
    import public_tokenizers

    got = hashlib.sha256(f"{public_tokenizers.PATTERN}|no added ids, special strings by default".encode())
    for kind in ("tiktoken", "json"):
        with open(public_tokenizers.path(f"{name}.{kind}"), "rb") as f:
            got.update(hashlib.sha256(f.read()).digest())
    return got.hexdigest()


class ByteBpe:
    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.json = public_tokenizers.path(f"{name}.json")

    def encode(self, text: str) -> np.ndarray:
        """All ids, without added ones."""
        if LONG_RUN.search(text):
            return np.array(_library(self.json).encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def encode_bytes(self, text: str) -> bytes:
        return self.encode(text).tobytes()

    def count(self, text: str) -> int:
        return len(self.encode(text))


@lru_cache(1)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def byte_bpe() -> ByteBpe:
    """One per Python worker."""
    return ByteBpe()
