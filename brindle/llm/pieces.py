"""Whole-text encoding with the tokenizers library, one cached piece at a time.

A byte-level pre-tokenizer never lets a token cross from a visible character into white space, so the pieces of a text
that start at white space are encoded independently; equal pieces give equal ids. Pieces are encoded by the tokenizer's own
pre-tokenizer and model and kept in a bounded table. Texts with unusual white space are encoded in one call instead. The
ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``; texts that hold the literal of an added token are
encoded in one call too. Tests hold both against each other.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: White space, or what some library may take for it, besides the blank, line feed, tab and carriage return: single bytes in
#: Latin-1, and others.
_RARE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_WIDE = re.compile("[\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
_CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: A Latin word, which the pre-tokenizer leaves whole with the blank before it, and a mark after it.
_WORD = re.compile("( ?[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]+)([.,]?)")
#: A Latin word and the run of marks after it, which the pre-tokenizer parts; an apostrophe may begin an ending.
_MARKED = re.compile("([A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]+)([!-&(-/:-@[-`{-~]+)")

# Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, as characters from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def unusual(text: str) -> bool:
    """Whether a text holds one of these; plain searches and a copy take a fraction of a pattern's time."""
    if any(c in text for c in _RARE):
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WIDE.search(text) is not None
    return False


def split(text: str) -> list[str] | None:
    """Pieces that concatenate to the text, or None where it has to be encoded in one call."""
    if unusual(text):
        return None
    return _CHUNK.findall(text)


def plain(text: str) -> bool:
    """Whether blanks and line feeds, each between visible characters, are the only white space."""
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\t" in text or "\r" in text or unusual(text))


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer of a vocabulary file."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: Pieces that a worker keeps, some 70 MB.
PIECES = 1 << 19


class _Table(dict):
    def __init__(self, limit: int, make, lead: str, marks: dict[str, bytes] | None = None) -> None:
        """marks: table of runs of marks, where what follows a word doesn't change the word's value."""
        super().__init__()
        self.limit, self.make, self.lead, self.marks = limit, make, lead, marks

    def __missing__(self, key: str) -> bytes:
        if self.marks is not None and (m := _MARKED.fullmatch(key)):
            value = self[m[1]] + self.marks[m[2]]
        else:
            value = self.make(key if key[:1] == "\n" else self.lead + key)
        if len(self) < self.limit:
            self[key] = value
        return value


class PieceEncoder:
    """Encodes texts to arrays of ids. One per Python worker; see encoder()."""

    def __init__(self, path: str, pieces: int = PIECES) -> None:
        self.tokenizer = tokenizer(path)
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._raw = _Table(pieces, self._piece_ids, "")  # keyed by the piece itself
        self._ids = _Table(pieces, self._piece_ids, " ", self._raw)  # keyed by the piece without its leading blank

    def _tokens(self, piece: str) -> list:
        if piece[:1] == " " and (word := piece[1:]).isascii() and word.isalpha():
            return self.model.tokenize("\u0120" + word)  # the character of the blank
        if word := _WORD.fullmatch(piece):
            found = self.model.tokenize(word[1].encode().decode("latin-1").translate(_BYTES))
            return found + self.model.tokenize(word[2]) if word[2] else found
        return [t for part, _ in self.pre.pre_tokenize_str(piece) for t in self.model.tokenize(part)]

    def _piece_ids(self, piece: str) -> bytes:
        return array(self.dtype.char, [t.id for t in self._tokens(piece)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian ids of the text, of the width self.dtype."""
        if not text:
            return b""
        if any(a in text for a in self._added):
            return self._whole(text)
        if plain(text):
            first, *rest = text.replace("\n", " \n").split(" ")
            return (self._piece_ids(first) if first else b"") + b"".join(map(self._ids.__getitem__, rest))
        pieces = split(text)
        if pieces is None:
            return self._whole(text)
        return b"".join([self._ids[p[1:]] if p[0] == " " and p[1:2] not in ("", " ", "\n", "\t", "\r") else self._raw[p] for p in pieces])


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, pieces: int = PIECES) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; workers are reused, so its table of pieces serves many tasks."""
    if (path, pieces) not in _encoders:
        _encoders[path, pieces] = PieceEncoder(path, pieces)
    return _encoders[path, pieces]
