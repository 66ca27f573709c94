"""Encoding whole texts to ids of a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np

#: A text may take the plain path if white space never stands beside white space and
#: all characters are of blocks whose classes do not depend on a Unicode version.
_ODD = re.compile(r"\s\s|[^\x09\x0a\x0d\x20-\x7e¡-ɏ‐-‟…€]")
#: The byte-level pre-tokenizer's pattern without its look-ahead, which such texts don't need.
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


class Encoder:
    """Texts to ids by the tokenizer at `path` (special strings in a text are text).

    With `ranks_path`, the same vocabulary as ranks, plain texts are encoded by a
    faster implementation of the same algorithm; all others, and all texts without
    it, by the tokenizer itself. The ids are the same.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=_PLAIN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not _ODD.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
