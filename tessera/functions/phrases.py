"""Tokens with their places, and phrases of several words found among them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import AT_ONCE, DIGITS_FROM, DIGITS_TO, HIDDEN, LETTERS_FROM, LETTERS_TO

# Arabic vowel marks, which stay inside a word and do not count.
MARKS = "\u064b-\u0652\u0670\u0654\u0655"
WORD = re.compile(rf"[^\W_]+(?:[{MARKS}][^\W_]*)*")
MARK = re.compile(f"[{MARKS}]")
SAME = str.maketrans(DIGITS_FROM + LETTERS_FROM + HIDDEN, DIGITS_TO + LETTERS_TO + " " * len(HIDDEN))
SPANS = "array<struct<phrase:string,start:int,stop:int>>"
FOUND = pa.list_(pa.struct([("phrase", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


class Token(NamedTuple):
    text: str
    start: int
    stop: int


def normalized(text: str) -> str:
    """``text.normalize`` of one string: as long as it was, letter by letter."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text.translate(SAME))


def tokenized(text: str) -> list[Token]:
    """The words of a text, folded, with their places in it."""
    return [Token(word, m.start(), m.end()) for m in WORD.finditer(normalized(text)) if (word := MARK.sub("", m.group()))]


class Vocabulary:
    """Phrases by their first word, the ones with most words first."""

    def __init__(self, phrases: Iterable[str]):
        self.by_first: dict[str, list[tuple[int, int, str, tuple[str, ...]]]] = {}
        for order, phrase in enumerate(phrases):
            words = tuple(t.text for t in tokenized(phrase))
            if words:
                self.by_first.setdefault(words[0], []).append((-len(words), order, phrase, words))

    def find(self, tokens: list[Token], blocked: set[int] = frozenset()) -> list[tuple[str, int, int]]:
        """(phrase, first token, token after its last) of phrases that overlap neither each other nor ``blocked`` tokens.

        Longer phrases are placed before shorter ones wherever they stand; of
        equally long ones the vocabulary's order decides, then the place.
        """
        words = [t.text for t in tokens]
        hits = []
        for at, word in enumerate(words):
            for rank, order, phrase, wanted in self.by_first.get(word, ()):
                if tuple(words[at : at + len(wanted)]) == wanted:
                    hits.append((rank, order, at, phrase))
        taken, out = set(blocked), []
        for rank, _, at, phrase in sorted(hits):
            own = range(at, at - rank)
            if taken.isdisjoint(own):
                taken.update(own)
                out.append((phrase, at, at - rank))
        return sorted(out, key=lambda x: x[1])


def spans(text: Column, phrases: Iterable[str]) -> Column:
    """(phrase, start, stop) of every phrase found in a text, in text order; a null text has none.  Few texts of a batch are Python strings at once."""
    vocabulary = Vocabulary(phrases)

    def one(t: str | None) -> list[dict]:
        tokens = tokenized(t or "")
        return [{"phrase": p, "start": tokens[a].start, "stop": tokens[b - 1].stop} for p, a, b in vocabulary.find(tokens)]

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([one(t) for t in batch.slice(a, AT_ONCE).to_pylist()], FOUND) for a in range(0, len(batch), AT_ONCE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], FOUND)

    return find(text)
