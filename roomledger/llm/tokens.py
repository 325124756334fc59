"""Token ids of whole texts by a public tokenizer, word by word."""

from __future__ import annotations

import re
from array import array
from functools import cache

#: Words whose ids are kept per Python worker. More words are encoded each time they come up.
KEPT_WORDS = 1_000_000
_MANY_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿß]+").fullmatch


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of ``tokenizers`` for a vocabulary that never joins words across white space.

    That holds where white space is dropped before merging, as in ``word_bpe_49k.json``:
    the ids of a text are those of its words in turn. So each word is encoded once per
    worker, in lower case as the vocabulary has it. Words of Latin letters only are one piece and go to the merge model directly;
    all others, and texts with the strings of special tokens, go through the whole
    tokenizer. ``tests/llm`` compare both ways over whole tables.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.letters = _byte_letters()
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.known = _Known(self.word)

    def _piece(self, letters: str) -> bytes:
        spelt = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(spelt)]).tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if _MANY_LETTERS(text):
            return self._piece(text.lower())
        stem, end = text[:-1], text[-1]
        if end in ".,!?;:" and _MANY_LETTERS(stem):
            return self.known[stem.lower().encode()] + self.known[end.encode()]
        return self._text(text)

    def _text(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        raw = text.encode()
        if any(s in raw for s in self.special):
            return self._text(text)
        return b"".join(map(self.known.__getitem__, raw.lower().split()))


class _Known(dict):
    """Ids by word, filled on demand up to ``KEPT_WORDS`` words."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word)
        if len(self) < KEPT_WORDS:
            self[word] = ids
        return ids


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker."""
    return WordEncoder(path)
