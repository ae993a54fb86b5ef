"""Tokenizer access for executors: exact ids and counts behind bounded worker caches.

A tokenizer whose pre-tokenizer never crosses white space encodes a text as the
concatenation of its white-space-separated words. Workers keep the ids of words
they have met; a word met for the first time is cut into pre-tokens, whose ids
are kept as well. Whatever is outside the alphabet for which that equivalence is
known (see ``PLAIN``) goes to the library as it stands. Special strings and ASCII
separator controls, which Python but not the tokenizers take for white space, are
dealt with where they stand, so a long text never goes to the library as a whole
because of one of them.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

from .common import serve

#: Entries of a cache's newer half; what has not been met since the last turn goes with the older one.
CACHE_WORDS = 200_000
LONGEST = 64

PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-įı-ſ]+")
ODD = re.compile("[\x1c-\x1f]")
#: Unicode's white space, which is what the tokenizers cut at.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def public_path(name: str) -> str:
    """Place of a public tokenizer file, or ``name`` itself if it is a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[int, int]:
    """Byte value -> printable code point, the published rule of byte-level BPE."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


class Cache(dict):
    """A bounded cache before ``compute``: entries met again stay, the others go after two turns.

    Texts have many words that occur once. Emptying a full cache as a whole would
    lose the frequent words with them, so a full half becomes the older half.
    """

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Ids of whole texts under a word BPE (lower case, white space dropped)."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.words = Cache(self.word)
        self.pieces = Cache(self.piece)

    def exact(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        if len(word) > LONGEST or not PLAIN.fullmatch(word):
            return self.exact(word)
        word = word.lower()
        # Letters, with or without one mark at the end, are what the pattern would cut them into.
        if word.isalpha():
            return self.pieces[word]
        if word[:-1].isalpha() and not word[-1].isalnum():
            return self.pieces[word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, WORD_PIECES.findall(word)))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        words = BLANK.split(text) if ODD.search(text) else text.split()
        # A word with a special string in it has more than plain pieces.
        if any(s in text for s in self.special):
            return b"".join(self.exact(w) if any(s in w for s in self.special) else self.words[w] for w in words)
        return b"".join(map(self.words.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder, kept until the worker serves another operator."""
    serve("words", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class _Frequent(dict):
    """Tier one: the broadcast table; what it lacks goes on to tier two.

    Keys stand without the ``prefix`` that the place in the text gives them.
    """

    def __init__(self, table: dict[str, int], counter: TokenCounter, prefix: str):
        cut = len(prefix)
        super().__init__((k[cut:], n) for k, n in table.items() if k.startswith(prefix) and (cut or k[:1] != " "))
        self.rest, self.prefix = counter.rest, prefix

    def __missing__(self, chunk: str) -> int:
        return self.rest[self.prefix + chunk]


class TokenCounter:
    """Token counts of whole texts under a byte-level BPE.

    A text is cut where white space begins. Tier one, looked up first, is
    ``table``, the broadcast pre-token -> count table; what it lacks goes to tier
    two, this worker's cache, which is filled by cutting a chunk into pre-tokens
    and encoding those that tier one lacks.
    """

    #: The published pre-token pattern of byte-level BPE.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")

    def __init__(self, path: str, table: dict[str, int]):
        self.tokenizer = library(path)
        self.model = self.tokenizer.model
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.alphabet = byte_alphabet()
        self.table = table
        self.rest = Cache(self.chunk)
        self.first, self.spaced = _Frequent(table, self, ""), _Frequent(table, self, " ")

    def exact(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> int:
        n = self.table.get(piece)
        if n is not None:
            return n
        if len(piece) > LONGEST:
            return self.exact(piece)
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet)))

    def chunk(self, chunk: str) -> int:
        body = chunk[1:] if chunk[:1] == " " else chunk
        if len(chunk) > LONGEST or not all(PLAIN.fullmatch(x) for x in body.split("\n") if x):
            return self.exact(chunk)
        return sum(map(self.piece, self.PIECES.findall(chunk)))

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            # The library cuts at special strings first; each is one token.
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if ODD.search(text):
            return self.exact(text)
        if "  " in text or text[-1].isspace():
            chunks = self.CHUNKS.findall(text)
            return sum(self.spaced[c[1:]] if c[0] == " " and len(c) > 1 and not c[1].isspace() else self.rest[c] for c in chunks)
        # One space before a word belongs to the word, so the spaces are the cuts.
        first, *rest = text.split(" ")
        return (self.first[first] if first else 0) + sum(map(self.spaced.__getitem__, rest))
