"""Token ids of a byte-level vocabulary file, for packing and binary output.

The vocabulary is read once on the driver (about 2 MB) and travels with the job, so
executors need no local copy. Texts made of common Latin characters take the fast
encoder; any other text, or one that spells the end-of-text token, takes the
reference encoder. Both give the same ids.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the split pattern of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_odd = re.compile("[^\t\n\r -~¡-¬®-ɏ‐-―‘-„…€]|<\\|endoftext\\|>")
_byte_of: dict[str, int] = {}


def _bytes_of(token: str) -> bytes:
    """Undo the printable alphabet of byte-level vocabularies."""
    if not _byte_of:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        _byte_of.update({chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)})
    return bytes(_byte_of[c] for c in token)


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class ByteTokenizer:
    """ids(text) as unsigned 32-bit numbers; a null text counts as empty."""

    def __init__(self, vocabulary: str):
        import tiktoken

        special = {x["content"] for x in json.loads(vocabulary).get("added_tokens", [])}
        ranks = {_bytes_of(t): i for t, i in json.loads(vocabulary)["model"]["vocab"].items() if t not in special}
        self._fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._vocabulary, self._reference = vocabulary, None

    @property
    def _exact(self):
        """The reference encoder, about 50 MB, loaded for the first text that needs it."""
        if self._reference is None:
            from tokenizers import Tokenizer

            self._reference = Tokenizer.from_str(self._vocabulary)
            self._reference.no_padding()
            self._reference.no_truncation()
        return self._reference

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if _odd.search(text):
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast.encode_ordinary(text), np.uint32)


_loaded: dict[int, ByteTokenizer] = {}


def loaded(vocabulary: str) -> ByteTokenizer:
    """One tokenizer for each Python worker and vocabulary."""
    key = hash(vocabulary)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteTokenizer(vocabulary)
    return _loaded[key]


