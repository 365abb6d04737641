"""Tokenisation with the ``tokenizers`` library that encodes each distinct word once per worker.

A byte-level tokenizer splits text before every single space that stands between two visible characters, and
never merges across that point. So a text may be cut there, each piece encoded alone, and the ids joined: the
result equals that of the whole text. Texts with runs of white space are cut at the safe spaces only, and texts
that hold a special token's string are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

SAFE = re.compile(r"(?<=\S) (?=\S)")
MARKS = ".,;:!?"
#: Fixed value: the published word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class NotCut(Exception):
    """A piece that borders on further white space, so that the text must not be cut there."""


class CachedEncoder(dict):
    """Maps a piece, which follows a space in its text, to its ids as little-endian 32-bit numbers.

    There are two generations: what is asked for moves to the young one, and when that is full it becomes the old one, whose pieces
    that nobody asked for since are dropped. So words in use stay. Each generation has at most half of ``limit`` entries and ``most_bytes``.
    """

    def __init__(self, path: str, limit: int = 1_000_000, most_bytes: int = 256 << 20):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.most_bytes = Tokenizer.from_file(path), limit, most_bytes
        self.model, self.letters = self.tokenizer.model, dict(enumerate(byte_letters()))
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the young generation, about
        self.parts: dict[str, bytes] = {}  # words that stand without a space before them: marks, line ends, what follows them
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(WORDS)
        self.marks = {m: self.whole(m) for m in MARKS}
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, spelled: str) -> bytes:
        """The ids of one word of the tokenizer's own split."""
        spelled = spelled.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def part(self, word: str) -> bytes:
        """The ids of a word from what is known already, else from the model."""
        if word[0] == " " and word[1:].isalpha():
            return self[word[1:]]
        if (ids := self.parts.get(word)) is None:
            ids = self.word(word)
            if len(word) <= 16:
                self.parts[word] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        if piece[-1:] in self.marks and (word := piece[:-1]).isalpha():  # the letters, then the mark
            ids = self[word] + self.marks[piece[-1]]
            if len(word) < 9:  # short ones return often
                self[piece] = ids
                self.held += 200 + 2 * len(piece) + len(ids)
            return ids
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise NotCut
        return self.made(piece)

    def made(self, piece: str) -> bytes:
        """The ids of a piece that the young generation does not have."""
        if (ids := self.old.get(piece)) is None:
            if piece.isalpha():  # a space and letters are one word for the model
                ids = array("I", [t.id for t in self.model.tokenize("Ġ" + piece)]).tobytes() if piece.isascii() else self.word(" " + piece)
            elif "\n" in piece:  # the end of a line and the beginning of the next: seldom seen again
                head, _, tail = piece.partition("\n")
                if head and tail.isalpha() and not head[-1].isspace():
                    return self[head] + self.line_end + self.part(tail)
                return b"".join([self.part(w) for w in self.split.findall(" " + piece)])
            else:
                ids = b"".join([self.part(w) for w in self.split.findall(" " + piece)])
        if len(piece) <= 64 and not piece[-1].isspace():
            self[piece] = ids
            self.held += 200 + 2 * len(piece) + len(ids)
        return ids

    def turn(self) -> None:
        """Make room when the young generation is full."""
        if len(self) > self.limit // 2 or self.held > self.most_bytes // 2:
            self.old = dict(self)
            self.clear()
            self.held = 0
        if len(self.parts) > self.limit // 8:
            self.parts.clear()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        self.turn()
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise NotCut
            ids = b"".join(map(self.__getitem__, rest))
        except NotCut:
            first, *rest = SAFE.split(text)
            ids = b"".join([self[piece] if piece in self else self.made(piece) for piece in rest])
        return (self.part(first) if first.isalpha() else self.whole(first)) + ids
