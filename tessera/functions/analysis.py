"""Signals of announcements over the full vocabulary: each word is claimed by the strongest reading, then scored and classified."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tessera.functions import text as texts
from tessera.functions import vocabulary as v
from tessera.functions.phrases import Token, Vocabulary, normalized, tokenized

URL = re.compile(r"https?://[^\s\"'<>)]+")
QUOTES = {"«": "»", "“": "”", '"': '"'}
SIGNALS = ArrayType(StructType().add("kind", StringType()).add("term", StringType()).add("start", IntegerType()).add("stop", IntegerType()))
#: Readings in the order in which they claim words; only the first two keep all others from theirs.
READINGS = {name: Vocabulary(words) for name, words in {
    "retrospective": v.RETROSPECTIVE, "attendance": v.ATTENDANCE, "place_context": v.PLACE_CONTEXT, "place_term": v.PLACES, "event_strong": v.STRONG, "event_weak": v.WEAK,
    "registration": v.REGISTRATION, "price": v.PRICES, "date": v.DATES, "time": v.TIMES,
}.items()}
CLOCKS, NUMERIC_DATE = [re.compile(p) for p in v.CLOCKS], re.compile(v.NUMERIC_DATE)
NUMBERS = {normalized(w) for w in v.NUMBER_WORDS}
Signal = tuple[str, str, int, int]


class _Text:
    """One text while its words are claimed."""

    def __init__(self, text: str):
        self.text, self.folded, self.tokens = text, normalized(text), tokenized(text)
        self.found: list[Signal] = []

    def near(self, at: int) -> Token | None:
        return self.tokens[at] if 0 <= at < len(self.tokens) else None

    def numeric(self, at: int) -> bool:
        return (t := self.near(at)) is not None and t.text.isdigit()

    def line(self, at: int) -> tuple[int, int]:
        return self.text.rfind("\n", 0, at) + 1, next((k for k in [self.text.find("\n", at)] if k >= 0), len(self.text))

    def take(self, kind: str, blocked: set[int], fits=lambda term, a, b: True) -> set[int]:
        """Signals of a kind among words that are not blocked; returns their words."""
        own: set[int] = set()
        for term, a, b in READINGS[kind].find(self.tokens, blocked):
            if fits(term, a, b):
                self.found.append((kind, term, self.tokens[a].start, self.tokens[b - 1].stop))
                own.update(range(a, b))
        return own

    def stated(self, a: int) -> bool:
        """Does the line of a daily wording state hours, by a word for them or a clock?"""
        begin, end = self.line(self.tokens[a].start)
        words = Vocabulary(v.OPENING).find([t for t in self.tokens if begin <= t.start < end])
        return bool(words) or any(p.search(self.folded[begin:end]) for p in CLOCKS)

    def clock(self, a: int, b: int) -> bool:
        """A number before the word for hours, and none after it, is a length."""
        before = self.near(a - 1)
        counted = before is not None and (before.text.isdigit() or before.text in NUMBERS)
        return self.numeric(b) or not counted

    def shaped(self, kind: str, term: str, patterns: list[re.Pattern]) -> None:
        self.found += [(kind, term, m.start(), m.end()) for p in patterns for m in p.finditer(self.folded)]

    def named(self, busy: set[int]) -> None:
        """The first name in quotes right after a word for an event."""
        heads = [(a, b) for kind in ("event_strong", "event_weak") for _, a, b in READINGS[kind].find(self.tokens, busy)]
        for _, b in sorted(heads):
            rest = self.text[self.tokens[b - 1].stop :].lstrip(" \t‌")
            end = rest.find(QUOTES[rest[0]], 1) if rest[:1] in QUOTES else -1
            if end > 1 and "\n" not in rest[:end]:
                at = len(self.text) - len(rest)
                self.found.append(("named_event", rest[1:end].strip(), at + 1, at + end))
                return


def analyze(text: str | None) -> list[Signal]:
    """(kind, term, start, stop) of every signal of a text, in text order; places are code points.

    What is over, then what invites, claims words for itself alone; opening hours
    claim them before dates and clocks.  Months that are ordinary words need a
    number beside them, and registration must be said outside of links.
    """
    t = _Text(text or "")
    claimed = t.take("retrospective", set())
    claimed |= t.take("attendance", claimed)
    hours = t.take("place_context", claimed, lambda term, a, b: term not in v.DAILY or t.stated(a))
    t.take("place_term", claimed)
    strong = t.take("event_strong", claimed)
    t.take("event_weak", claimed | strong)
    links = [(m.start(), m.start() + len(m.group().rstrip(".,;:!?،؛)]»"))) for m in URL.finditer(t.text)]
    t.found += [("url", "url", a, b) for a, b in links]
    booked = t.take("registration", claimed, lambda term, a, b: not any(x <= t.tokens[a].start and t.tokens[b - 1].stop <= y for x, y in links))
    priced = t.take("price", claimed)
    dated = t.take("date", claimed | hours, lambda term, a, b: term not in v.MONTHS_WITH_A_NUMBER or t.numeric(a - 1) or t.numeric(b))
    timed = t.take("time", claimed | hours, lambda term, a, b: t.clock(a, b))
    t.shaped("date", "numeric_date", [NUMERIC_DATE])
    t.shaped("time", "clock_time", CLOCKS)
    t.named(claimed | hours | booked | priced | dated | timed)
    return sorted(set(t.found), key=lambda s: (s[2], s[0], s[3], s[1]))


@F.pandas_udf(SIGNALS)
def _analyzed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names = ("kind", "term", "start", "stop")
    for batch in batches:
        yield batch.map(lambda t: [dict(zip(names, s, strict=True)) for s in analyze(t)])


def signals(text: Column) -> Column:
    """``analyze`` of each row."""
    return _analyzed(text)


def terms(found: Column, kind: str) -> Column:
    """How many different terms of a kind."""
    return F.size(F.array_distinct(F.transform(F.filter(found, lambda s: s["kind"] == kind), lambda s: s["term"])))


def score(found: Column) -> tuple[Column, Column]:
    """(event, place) less what speaks against: different terms count, repetitions do not."""

    def weight(kind: str) -> Column:
        first, more, most = v.WEIGHTS[kind]
        n = terms(found, kind)
        return F.when(n > 0, first + F.least(F.lit(most), more * (n - 1))).otherwise(0.0)

    once = lambda weights: sum((F.when(terms(found, k) > 0, w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    over = v.AGAINST * terms(found, "retrospective")
    return weight("event_strong") + weight("event_weak") + once(v.ONCE) - over, weight("place_term") + once(v.PLACE_ONCE) - over


def guard(text: Column) -> Column:
    """Why a text announces no single event, whatever its signals; null where nothing speaks against it."""
    low = texts.normalize(text)
    said = lambda pattern: low.rlike(pattern)
    return (
        F.when(said(v.COLLECTION) & ~said(v.STATED_DATE), "needs_evidence: multi_event_collection")
        .when(said(v.SERIES) & ~said(v.SPECIFIC), "needs_evidence: unspecified_series_activities")
        .when(said(v.PAST) & ~said(v.FUTURE) & ~said(v.YEAR), "non_event: retrospective_without_new_attendance")
        .when(said(v.PRODUCT) & ~said(v.ACTIVITY), "non_event: product_promotion")
    )


def classify(text: Column, found: Column) -> Column:
    """event, place or other, of a text and its signals.

    An event needs a term for one with a date, a clock or a registration, or an
    invitation beside a strong term that is named or placed; a place a term for
    one and what places say of themselves; and the score of its kind.
    """
    has = lambda kind: terms(found, kind) > 0
    event, place = score(found)
    dated = has("date") | has("time") | has("registration")
    path = ((has("event_strong") | has("event_weak")) & dated) | (has("attendance") & has("event_strong") & (has("named_event") | has("place_term")))
    return (
        F.when(guard(text).isNotNull(), "other").when(path, F.when(event >= v.THRESHOLD, "event").otherwise("other"))
        .when(has("place_term") & has("place_context") & (place >= v.THRESHOLD), "place").otherwise("other")
    )
