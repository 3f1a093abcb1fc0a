"""Token ids by the tokenizers library, with a cache of words.

The tokenizer used here never joins text across ASCII white space, drops the
white space itself, lower-cases, and splits letters from marks, so a text's ids
are its words' ids in order, and a word's are those of its letters and of the
marks behind them. They come from the library once and are then looked up; the
cache keeps two generations of bounded size. Of Latin letters the normal form is
known, so they go to the library's model itself, past its normalizer and regular
expressions, where the tokenizer proves to be of that kind.
"""

from __future__ import annotations

import os
from functools import lru_cache
from unicodedata import normalize

import numpy as np

#: The default tokenizer: a file name within the installed vocabulary package, or a path.
TOKENIZER = "word_bpe_49k.json"
GENERATION = 500_000
#: Bytes of a word up to which it is kept, which bounds the cache's memory.
KEPT = 64
#: A text on which word-wise ids must be the library's: a tokenizer that joins over white space or does not lower-case is refused.
PROBE = "Hello, WORLD! It's (some) text: 12% of it, e.g. <tag> été... end."
#: Marks that the tokenizer splits off letters before them.
MARKS = b".,!?;:#$%&*|"
#: The last of the letters whose normal form is the lower-cased letter (Latin, extended A and B).
LATIN = "\u024f"
#: A byte's character in vocabularies of bytes: printable ones stand for themselves, others for those from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """word -> its ids as little-endian uint32 bytes."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.model = self.tokenizer.model
        #: Whether words of Latin letters go to the model itself.
        self.direct = True
        self.older: dict[bytes, bytes] = {}

    def _latin(self, word: bytes) -> bytes | None:
        """The ids of a word of Latin letters; None for others."""
        if word.isalpha():
            low = word.decode().lower()
        else:
            text = word.decode()
            if not text or max(text) > LATIN:
                return None
            low = "".join(map(str.lower, text))  # letter by letter: a final sigma is like any other
            if not (text.isalpha() and low.isalpha() and max(low) <= LATIN):
                return None
            low = low.encode().decode("latin-1").translate(BYTES)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(low)])

    def __missing__(self, word: bytes) -> bytes:
        out = self.older.get(word)
        head = word.rstrip(MARKS)
        if out is None and self.direct and (out := self._latin(head)) is not None and head != word:
            out += self[word[len(head) :]]
        if out is None and head and head != word and normalize("NFC", head.decode()).lower().isalpha():
            out = self[head] + self[word[len(head) :]]  # letters and marks are split before they are encoded
        elif out is None and word.isalpha() and not word.islower():
            out = self[word.lower()]  # ASCII letters alone; the tokenizer lower-cases
        elif out is None:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            out = np.array(ids, "<u4").tobytes()
        if len(word) <= KEPT:
            if len(self) >= GENERATION:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


@lru_cache(maxsize=2)
def _cache(name: str) -> _Words:
    words = _Words(name)
    for words.direct in (True, False):
        words.clear()
        ids = np.frombuffer(b"".join(map(words.__getitem__, PROBE.encode().split())), "<u4").tolist()
        if ids == words.tokenizer.encode(PROBE, add_special_tokens=False).ids:
            return words
    raise ValueError(f"{name} does not tokenize word by word")


@lru_cache(maxsize=2)
def vocabulary_size(name: str = TOKENIZER) -> int:
    return _cache(name).tokenizer.get_vocab_size(with_added_tokens=True)


def encode(text: str | None, end_id: int, name: str = TOKENIZER) -> bytes:
    """The ids of a text and the end id, as little-endian uint32."""
    body = b"".join(map(_cache(name).__getitem__, text.encode().split())) if text else b""
    return body + end_id.to_bytes(4, "little")
