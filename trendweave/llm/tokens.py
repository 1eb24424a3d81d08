"""Tokenizing with public vocabularies, exact, each distinct piece encoded once per worker and then looked up.

A text whose code points are all below 256 is cut at the vocabulary's own pre-token bounds, which no merge
crosses (the classes of letters, digits and white space are written out for that range); its case is
folded first where the vocabulary folds it.  Any other text is cut where white space follows a visible
character, or, with white space beyond ASCII in it, not at all; a text that holds the string of an added token
is encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = "\\t-\\r \x85\xa0"
SHORTS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Pre-tokens of the two families of vocabularies, for code points below 256.
WORD_ENDS = re.compile(f"{SHORTS}|[{LETTERS}]+|[{DIGITS}]|[^{BLANKS}{LETTERS}{DIGITS}]+")
BYTE_LEVEL = re.compile(f"{SHORTS}| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
BEYOND = re.compile("[^\x00-\xff]")
UNIT = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
WIDE = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WIDE_SPACE = re.compile(f"[{''.join(map(chr, WIDE))}]")
MOST_PIECES = 500_000
LONG_PIECE = 64


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """piece -> its ids as bytes; the pieces used last are kept, at most twice MOST_PIECES."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_specials and t.special)]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        self.fold = self.tokenizer.normalizer is not None
        self.cut = WORD_ENDS if self.fold else BYTE_LEVEL
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.bytewise = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, piece: str) -> bytes:
        """Ids of ASCII letters, with a space before them or not: one pre-token, so the library's model is asked alone."""
        return np.array([t.id for t in self.model.tokenize(piece.replace(" ", "Ġ"))], "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.word(piece) if self.bytewise and piece.isascii() and piece.removeprefix(" ").isalpha() else self.encoded(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= MOST_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.added.search(text):
            return self.encoded(text)
        if text.isascii() or not BEYOND.search(text):
            return b"".join(map(self.__getitem__, self.cut.findall(text.lower() if self.fold else text)))
        if WIDE_SPACE.search(text):
            return self.encoded(text)
        return b"".join(map(self.__getitem__, UNIT.findall(text)))


@cache
def pieces(path: str, plain_specials: bool = False) -> Pieces:
    return Pieces(path, plain_specials)


def encode(path: str, texts: list[str], end_id: int, plain_specials: bool = False) -> list[bytes]:
    """The ids of each text and ``end_id``, as little-endian unsigned 32-bit integers.

    The strings of special tokens in a text become those tokens, as in the library; plain_specials: they are ordinary text.
    """
    known, end = pieces(path, plain_specials), int(end_id).to_bytes(4, "little")
    return [known.ids(text) + end for text in texts]
