"""Splits text as a byte-level BPE pre-tokenizer does and encodes it through bounded caches.

A single space between two non-space characters always begins a pre-token, so
text can be cut there and equal pieces share one cache entry.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import regex

# Unicode White_Space, and the published pre-tokenizer pattern of byte-level BPE.
WS = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
)
PLAIN_MARKS = frozenset(".,;:!?")
CLEAN_SPACE = regex.compile(rf"(?<=[^{WS}]) (?=[^{WS}])")

#: Entries of one cache generation; two are held, so what is in use survives a change.
PIECES_KEPT = 400_000
WORDS_KEPT = 400_000
LONGEST_KEPT = 64
#: Entries a cache keeps when its task ends, as the worker process lives on into other stages.
IDLE_KEPT = 50_000


class PieceEncoder:
    """Text to ids as little-endian uint16 bytes.

    ``encode_word`` maps the UTF-8 bytes of one pre-token to such bytes;
    ``special`` are strings that stand for an id wherever they occur.
    """

    def __init__(self, encode_word: Callable[[str], bytes], special: dict[str, bytes]) -> None:
        self.encode_word = encode_word
        self.special = special
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.cache = _Pieces(self)

    def rest(self) -> None:
        """Keeps the entries met first, which are the common ones, and frees the others."""
        self.old_words, self.words = {}, dict(islice((self.old_words or self.words).items(), IDLE_KEPT))
        kept = dict(islice((self.cache.old or self.cache).items(), IDLE_KEPT))
        self.cache = _Pieces(self)
        self.cache.update(kept)

    def closed(self, text: str, spaced: bool) -> bytes:
        """Ids of ``text`` whose both ends are certain; ``spaced``: a space stands before it."""
        if not text:
            return self.whole(" ") if spaced else b""
        parts = text.split(" ")
        try:
            if spaced:
                return b"".join(map(self.cache.__getitem__, parts))
            first = parts[0]
            if not first or first[-1].isspace():
                raise _UncleanError
            return self.whole(first) + b"".join(map(self.cache.__getitem__, parts[1:]))
        except _UncleanError:
            pass
        units = CLEAN_SPACE.split(text if not spaced else " " + text)
        return self.whole(units[0]) + b"".join(self.whole(" " + u) for u in units[1:])

    def whole(self, text: str) -> bytes:
        """Ids of ``text``, special strings first."""
        for mark, code in self.special.items():
            if mark in text:
                return code.join(self.whole(x) for x in text.split(mark))
        return b"".join([self.words.get(w) or self._word(w) for w in WORDS.findall(text)])

    def spaced_piece(self, piece: str) -> bytes:
        """Ids of a space and a piece; letters with at most one mark behind them need no pattern."""
        if piece.isalpha():
            return self.encode_word(" " + piece)
        body, last = piece[:-1], piece[-1]
        if body.isalpha() and last in PLAIN_MARKS:
            return self.cache[body] + self.whole_word(last)
        return self.whole(" " + piece)

    def whole_word(self, w: str) -> bytes:
        return self.words.get(w) or self._word(w)

    def _word(self, w: str) -> bytes:
        code = self.old_words.get(w) or self.encode_word(w)
        if len(w) <= LONGEST_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.old_words, self.words = self.words, {}
            self.words[w] = code
        return code


class _UncleanError(Exception):
    pass


class _Pieces(dict):
    """Ids of a piece with the space before it; pieces that touch white space are refused."""

    def __init__(self, owner: PieceEncoder) -> None:
        self.owner = owner
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _UncleanError
        code = self.old.get(piece) or self.owner.spaced_piece(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECES_KEPT:
                self.old = dict(self)
                self.clear()
            self[piece] = code
        return code
