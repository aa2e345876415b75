"""Token ids of whole texts by a word-level BPE file of ``tokenizers``.

The file's rules cut a text at white space first, lower-case it and cut words,
single digits and runs of signs; merges never cross such a cut. So the ids of
a text are the ids of its words in order, and a word is looked up in a bounded
dictionary before its merges are run. Words of ASCII and Latin letters
(``FAST``) are cut here by the same rules and given to the model; every other
word, and one with the start of a special token's string, goes through the
whole tokenizer by itself.

Null text reads as empty text. Bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sluice.llm import tokens as tk

CACHED_WORDS = 400_000
CACHED_CHARS = 64               # a longer word is not kept

# The cuts of word_bpe_49k.json for the characters of FAST
# (\p{L}, \p{N} and \s of those code points, lower case).
LETTERS = "a-zªµºß-öø-ÿĀ-įı-ſ"
NUMBERS = "0-9²³¹¼-¾"
BLANKS = " \t\n\x0b\x0c\r\u0085 "
CUT = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
FAST = re.compile("[\x00-įı-ſ]*")
SPLIT = re.compile("[ \t\n\x0b\x0c\r]+")
SPECIAL = "<|"


def byte_symbols() -> list[str]:
    """The printable character that byte-level files write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [other.get(b, chr(b)) for b in range(256)]


class Seen(dict):
    """Word -> number of the word; a new word is numbered by ``learn``."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> int:
        self[word] = n = self.learn(word)
        return n


class WordBpe:
    """Words to ids, with the words seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs the tasks
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self.forget()

    def forget(self) -> None:
        self.code = Seen(self.learn)
        self.flat, self.ends = array("I"), array("q", [0])
        self.long: list[str] = []

    def learn(self, word: str) -> int:
        self.flat.extend(self.word_ids(word))
        self.ends.append(len(self.flat))
        if len(word) > CACHED_CHARS:
            self.long.append(word)
        return len(self.ends) - 2

    def word_ids(self, word: str) -> list[int]:
        if FAST.fullmatch(word) and SPECIAL not in word:
            mapped = "".join([self.symbols[b] for b in word.encode()])
            return [t.id for t in self.model.tokenize(mapped)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def words(self, text: str) -> list[str]:
        if (text.isascii() or FAST.fullmatch(text)) and SPECIAL not in text:
            return CUT.findall(text.lower())
        out: list[str] = []
        for w in SPLIT.split(text):
            if FAST.fullmatch(w) and SPECIAL not in w:
                out += CUT.findall(w.lower())
            else:
                out.append(w)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        words: list[str] = []
        counts = []
        for t in texts:
            found = self.words(t)
            counts.append(len(found))
            words += found
        if len(self.code) > CACHED_WORDS:
            self.forget()
        at = np.fromiter(map(self.code.__getitem__, words), dtype=np.int64, count=len(words))
        ends = np.array(self.ends)
        size = np.diff(ends)[at] if len(at) else np.zeros(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(upto[-1]) + np.repeat(ends[at] - upto[:-1], size)
        ids = np.array(self.flat, dtype=np.uint32)[place]
        for w in self.long:
            del self.code[w]
        self.long.clear()
        text_ends = upto[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        return ids, np.diff(text_ends)


_LOADED: dict[str, WordBpe] = {}


def loaded(name: str) -> WordBpe:
    """The tokenizer of a file of ``public_tokenizers`` (or of a path), once
    for each Python worker."""
    if name not in _LOADED:
        import public_tokenizers
        _LOADED[name] = WordBpe(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _LOADED[name]


def text_slices(col: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a text column, about ``SLICE_BYTES`` at a time."""
    raw, off = tk.column_bytes(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + tk.SLICE_BYTES, "right")) - 1))
        yield i, [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[i:j], off[i + 1:j + 1])]
        i = j
