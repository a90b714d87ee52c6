"""Token ids of whole texts, as bytes of little-endian unsigned 32-bit integers.

The tokenizer lower-cases, cuts a text into words (letters, single digits, other signs) and encodes each word by
itself, so a text's ids are those of its words, one after the other. Words repeat; each Python worker keeps the ids
of those it has met lately. Texts with signs beyond the Latin blocks are cut at ASCII white space only, across which
the tokenizer joins nothing, and leave normalising to it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
KEPT = 40_000_000  # bytes of pieces and words in each of two generations
ENTRY = 160  # bytes that an entry takes beside the signs and ids
_PLAIN = re.compile("[\\t\\n\\r -~\u00a1-\u012f\u0131-\u017f]*")
_LETTER, _NUMBER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The vocabulary file's own rule for words, spelled out for the plain signs.
_WORDS = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^ \\t\\n\\r{_LETTER}{_NUMBER}]+")
_SPACE = re.compile("[ \\t\\n\\r]+")
#: Byte-level vocabularies write a byte as a printable sign: itself where it has one, else the next from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SIGNS = [chr(b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)]
_ENCODERS: dict[str, Encoder] = {}


class Kept(dict):
    """What ``make`` gives for a key, kept for the keys met lately: two generations of about KEPT bytes each."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older, self.room = make, {}, KEPT

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self.room -= len(key) + len(got) + ENTRY
        if self.room < 0:
            self.older = dict(self)
            self.clear()
            self.room = KEPT
        if len(key) + len(got) < KEPT // 16:  # longer ones hardly come again
            self[key] = got
        return got


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces, self.others = Kept(self._piece), Kept(self._whole)

    def _word(self, word: str) -> bytes:
        signs = word if word.isascii() else "".join([_SIGNS[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        words = _WORDS.findall(piece)
        # A word is a piece of its own, kept with the others.
        return self._word(piece) if len(words) == 1 and words[0] == piece else b"".join([self.pieces[w] for w in words])

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:  # "<|" may begin a special token
            return b"".join(map(self.pieces.__getitem__, text.lower().split()))
        return b"".join(map(self.others.__getitem__, _SPACE.split(text)))


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for the vocabulary file."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
