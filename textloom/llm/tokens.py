"""Token ids of whole texts by the tokenizers library, with a bounded cache.

A byte-level BPE parts a text before a space that stands between two
characters which are not white space, whatever else the text holds, and around
a line's end between two such characters.  So a text is the concatenation of
such pieces' ids, a line's first word being a piece with the line's end before
it.  A piece parts further into the
pre-tokenizer's words, each of which the library's model encodes by itself.  A
worker encodes a frequent piece or word once; each cache has two generations
of ``limit`` entries at most and outlives the task.  Texts with the
special token's string, and tokenizers of another kind, go to the library
whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LONGEST, _ENDS = 64, frozenset(".,")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in prints else next(rest)) for b in range(256))


class _Cache(dict):
    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, key: str) -> bytes | None:
        found = self.old.get(key)
        if found is None:
            found = self.encode(key)
        if found is not None and len(key) <= LONGEST:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """``encode(text)`` gives the ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        said = json.loads(self.tokenizer.to_str())
        pre = said["pre_tokenizer"] or {}
        self.plain = said["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.special = [t["content"] for t in said["added_tokens"]]
        self.tokenize, self.code = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        self.letters = dict(enumerate(_byte_letters()))
        self.space = self.letters[32]
        self.words, self.pieces = _Cache(self._word, limit // 4), _Cache(self._piece, limit)

    def ids(self, text: str) -> bytes:
        """As the library encodes the text as a whole."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """One word of the pre-tokenizer."""
        if word[0] == " " and word[1:].isalpha():
            return self.pieces[word[1:]]
        found = self.tokenize(word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters))
        return array(self.code, [t.id for t in found]).tobytes()

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))

    def _piece(self, piece: str) -> bytes | None:
        """A piece and the space before it, or a line's end and the piece behind it; None if the text needs a more careful way."""
        if piece.isalpha():
            found = self.tokenize(self.space + (piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)))
            return array(self.code, [t.id for t in found]).tobytes()
        if piece[-1:] in _ENDS and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.words[piece[-1]]
        if piece[:1] == "\n":
            return None if not piece[1:] or piece[1].isspace() or piece[-1].isspace() else self._split(piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self._split(" " + piece)

    def _joined(self, text: str) -> bytes | None:
        """A text that parts at each of its spaces; None if one stands beside white space."""
        head, *rest = text.split(" ")
        if head and not head[-1].isspace():
            found = list(map(self.pieces.__getitem__, rest))
            if None not in found:
                return self._split(head) + b"".join(found)
        return None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or any(s in text for s in self.special):
            return self.ids(text)
        if "\n" in text and (found := self._joined(text.replace("\n", " \n"))) is not None:
            return found
        if " \n" not in text and (found := self._joined(text)) is not None:
            return found
        head, *rest = _BETWEEN.split(text)
        return self._split(head) + b"".join(self.pieces[p] or self._split(" " + p) for p in rest)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, limit: int = 250_000) -> Encoder:
    """This process's encoder: workers are used again, and keep what they have cached; the largest limit asked for holds."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, limit)
    found = _ENCODERS[path]
    found.pieces.limit = max(found.pieces.limit, limit)
    return found
