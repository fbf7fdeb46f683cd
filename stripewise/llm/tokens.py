"""Byte-level BPE token ids of texts, fast where the vocabulary allows it."""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np

#: The pattern by which byte-level BPE of this family splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a Python worker remembers the ids of; then it forgets them all.
REMEMBERED = 100_000

_SPACED = re.compile(r" (?:\s|\Z)")
_BREAK = re.compile(r" (?=\S)")
_loaded: dict[str, "TextIds"] = {}


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a sign: printable ones as themselves, the
    others, in order, as the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Word -> bytes of the ids of the word with a space before it."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        return out


class TextIds:
    """ids(text): little-endian unsigned 32-bit ids as bytes, equal to those that the
    `tokenizers` library gives for the file with add_special_tokens=False.

    Before a space with a non-space behind it the splitting pattern always breaks, so words
    are encoded apart and remembered. Where ids number the merges in order, the byte-pair
    merging is done by tiktoken, which is faster; texts that hold a special token, and files
    of another build, go through `tokenizers`.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.fast = None
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec["normalizer"] is None:
            signs, vocab = _byte_of_sign(), spec["model"]["vocab"]
            merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
            if all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
                import tiktoken

                ranks = {bytes(signs[c] for c in w): i for w, i in vocab.items() if w not in self.special}
                self.fast = tiktoken.Encoding(
                    "file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
                ).encode_ordinary
        self.words = _Words(self.fast)

    @cached_property
    def slow(self):
        """The library's tokenizer, loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = _BREAK.split(text) if _SPACED.search(text) else text.split(" ")
        words = self.words
        first = np.array(self.fast(parts[0]), dtype="<u4").tobytes()
        return first + b"".join([words[w] for w in parts[1:]])


def text_ids(path: str) -> TextIds:
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = TextIds(path)
    return _loaded[path]
