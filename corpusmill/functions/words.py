"""The tokens of ``functions.text`` on Arrow batches: every distinct word is expanded once in a worker.

``text.py`` says what a token is in column expressions; here the same rules run over a
vocabulary, so that a text costs one look-up a word.  Tests hold the two against each other.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from corpusmill.functions import text as T

# \w is exactly letters, digits and the underscore, so with the other joining signs it is a word's alphabet.
_WORD = re.compile(r"[\w$\-/.]+")
_JOINING = "_$-/."
_COMPONENTS = regex.compile(T.COMPONENTS, regex.V1)
_SEARCH = {True: regex.compile(r"[^\p{L}\p{N}_]+"), False: regex.compile(r"[^\p{L}\p{N}]+")}
_FOLD = str.maketrans(T.FOLD_FROM, T.FOLD_TO)


class Vocabulary(dict):
    """Word as it stands in a text -> numbers of its search tokens, in order."""

    MOST = 1 << 18  # words remembered; more start afresh, but numbers of terms stay

    def __init__(self, underscore: bool = True):
        super().__init__()
        self.underscore, self.terms, self.numbers, self.sizes = underscore, [], {}, {}

    @staticmethod
    def tokens(word: str) -> list[str]:
        """A word in lower case, then its distinct components in order; none for joining signs alone."""
        word = word.strip(_JOINING)
        if not word:
            return []
        whole = word.lower()
        if word.isascii() and word.isalpha() and (word == whole or word[1:].islower()):
            return [whole]  # one component, which is the word
        return [whole, *sorted({p.lower() for p in _COMPONENTS.split(word)} - {"", whole})]

    def expand(self, word: str) -> list[str]:
        """The search tokens of a word's tokens."""
        tokens = self.tokens(word)
        self.sizes[word] = sum(len(t.encode()) + 1 for t in tokens)
        return [t for x in tokens for t in ([x] if x.isascii() and x.isalnum() else _SEARCH[self.underscore].split(x.lower().translate(_FOLD))) if t]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.MOST:
            self.clear()
        found = []
        for term in self.expand(word):
            number = self.numbers.get(term)
            if number is None:
                number = self.numbers[term] = len(self.terms)
                self.terms.append(term)
            found.append(number)
        self[word] = value = tuple(found)
        return value

    def sequence(self, text: str | None) -> np.ndarray:
        """Numbers of a text's search tokens in order."""
        if not text:
            return np.zeros(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.__getitem__, _WORD.findall(text))), np.int32)

    def measured(self, text: str) -> tuple[np.ndarray, int]:
        """The sequence of a text, and the bytes its tokens take joined by spaces."""
        found = _WORD.findall(text)
        sequence = np.fromiter(chain.from_iterable(map(self.__getitem__, found)), np.int32)
        return sequence, max(sum(map(self.sizes.__getitem__, found)) - 1, 0)

    def trim(self, most: int = 1 << 20) -> None:
        """Start afresh between batches once there are ``most`` terms, so that a worker's memory has a bound."""
        if len(self.sizes) > self.MOST:  # a word remembered without its size would have none
            self.clear()
            self.sizes.clear()
        if len(self.terms) > most:
            self.clear()
            self.terms, self.numbers = [], {}


def nested(values: np.ndarray, *counts: np.ndarray) -> pa.Array:
    """``values`` as lists, the innermost of ``counts[0]`` elements each, those again in lists, and so on."""
    out: pa.Array = pa.array(values)
    for n in counts:
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), out)
    return out
