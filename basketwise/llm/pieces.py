"""Cutting a text into the pieces inside which byte-pair merges happen, with one bounded table of results per worker.

A text is cut at single blanks first: a blank between two words always starts the next piece, so each word with its
blank can be cut and encoded on its own, and the result kept. Where a word comes out empty or has white space at its
edge (runs of blanks, blank next to newline) that argument fails, and the whole text is cut by the pattern instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import regex


#: A pair of ids is kept as one number, left << PAIR | right.
PAIR = 24


class Irregular(Exception):
    """A text in which blanks do not part the pieces one by one."""


class Bounded(dict):
    """A table of results in two generations; when the young one is full, it becomes the old one."""

    def __init__(self, make: Callable[[str], object], limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Vocabulary:
    """A byte-level vocabulary file: ids, merges, cutting pattern and special strings."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = regex.compile(pattern).findall
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.byte_id = [ids[letters[b]] for b in range(256)]
        self.merges = []  # by rank: left, right, made
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((ids[left], ids[right], ids[left + right]))
        self.rank = {left << PAIR | right: rank for rank, (left, right, _) in reversed([*enumerate(self.merges)])}
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in ids.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    # fixed values: the printable ranges of Latin-1 stand for themselves, all others follow from 256 on
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


class Cutter:
    """Results for each piece of a text. of_piece: the result of one piece of the pattern; total: joins results."""

    def __init__(self, vocabulary: Vocabulary, of_piece: Callable[[str], object], total: Callable):
        self.v, self.total = vocabulary, total
        self.pieces = Bounded(of_piece, 100_000)
        self.words = Bounded(self.of_word)

    def of_word(self, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            raise Irregular
        if word.isalpha():  # one run of letters is one piece
            return self.pieces.make(" " + word)
        if word[:-1].isalpha() and word[-1] in ".,!?;:":
            return self.total([self.pieces.make(" " + word[:-1]), self.pieces[word[-1]]])
        return self.total([self.pieces[p] if len(p) < 4 else self.pieces.make(p) for p in self.v.cut(" " + word)])

    def of_text(self, text: str):
        """The joined results of one text that holds no special string."""
        if not text:
            return self.total([])
        first, *rest = text.split(" ")
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise Irregular
            return self.total([*map(self.pieces.__getitem__, self.v.cut(first)), *map(self.words.__getitem__, rest)])
        except Irregular:
            return self.total(map(self.pieces.__getitem__, self.v.cut(text)))
