"""Ids of stretches of text, each encoded once while it stays in a bounded store."""

from __future__ import annotations

import gc
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from itertools import chain

MARKS = ".,;:!?"
#: Letters up to here have been letters in every version of Unicode that a tokenizer may know.
LAST_LETTER = "ɏ"

_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies show the other bytes as the characters from 256 on, in order.
BYTE_ALPHABET = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def shown(text: str) -> str:
    """The text as a byte-level vocabulary spells it."""
    return text.encode().decode("latin-1").translate(BYTE_ALPHABET)


def letters_only(text: str) -> bool:
    return text.isalpha() and (text.isascii() or max(text) <= LAST_LETTER)


@contextmanager
def no_collection():
    """Without Python's cycle collector, which would walk the stores' millions of strings for nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class StretchStore:
    """learn() gives ids, packed, of stretches that are not held.

    When the store is full, the stretches that were needed by more than one batch stay.
    """

    def __init__(self, limit: int, learn: Callable[[list[str]], Iterable[tuple[str, bytes]]]):
        self.limit, self.learn = limit, learn
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """Packed ids of each text, given as its stretches."""
        with no_collection():
            return self._ids(texts)

    def _ids(self, texts: list[list[str]]) -> list[bytes]:
        need = set(chain.from_iterable(texts))
        missing = need.difference(self.known)
        held = need - missing
        self.again |= held
        if len(self.known) + len(missing) > self.limit:
            if 2 * len(self.again) > self.limit:
                self.again = held
            self.known = {w: self.known[w] for w in self.again}
        self.known.update(self.learn(list(missing)))
        get = self.known.__getitem__
        return [b"".join(map(get, stretches)) for stretches in texts]


class PreTokenModel:
    """Asks the model alone for pre-tokens that are known to be letters or marks only.

    One pre-token's ids do not depend on its neighbours. Whatever is not of that kind goes
    through the whole tokenizer.
    """

    def __init__(self, tok, code: str, limit: int, fold: bool, before: str = ""):
        self.tok, self.model, self.code, self.limit = tok, tok.model, code, limit
        self.fold, self.before = fold, before
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> Iterable[tuple[str, bytes]]:
        for a in range(0, len(texts), 8192):
            part = texts[a : a + 8192]
            encoded = self.tok.encode_batch_fast([self.before + t for t in part], add_special_tokens=False)
            yield from ((t, array(self.code, e.ids).tobytes()) for t, e in zip(part, encoded, strict=True))

    def _letters(self, word: str) -> bytes | None:
        if self.fold:
            if word.isascii():
                word = word.lower()
            elif word != word.lower() or not unicodedata.is_normalized("NFC", word):
                return None
        ids = self.letters.get(word)
        if ids is None:
            text = self.before + word
            tokens = self.model.tokenize(text if not self.before and text.isascii() else shown(text))
            ids = self.letters[word] = array(self.code, [t.id for t in tokens]).tobytes()
        return ids

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            encoded = self.tok.encode(marks, add_special_tokens=False)
            self.marks[marks] = array(self.code, encoded.ids).tobytes()
        return self.marks[marks]

    def learn(self, missing: list[str]) -> Iterable[tuple[str, bytes]]:
        if len(self.letters) > self.limit:
            self.letters = {}
        if len(self.marks) > 4096:
            self.marks = {"": b""}
        rest = []
        for w in missing:
            base = w.rstrip(MARKS)
            ids = self._letters(base) if letters_only(base) else None
            if ids is None:
                rest.append(w)
            else:
                yield w, ids + self._marks(w[len(base) :])
        yield from self.whole(rest)
