"""Signals of announcements: weighted vocabularies, classification, and fields read from lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as texts
from tessera.functions.phrases import tokenized
from tessera.functions.temporal import bound
from tessera.functions.vocabulary import PLACEHOLDERS

# English vocabularies and the weights of the score.
STRONG = ("workshop", "seminar", "concert", "festival", "webinar")
WEAK = ("class", "session", "meeting")
ATTENDANCE = ("join", "attend")
REGISTRATION = ("register", "registration", "ticket")
PLACE = ("cafe", "museum", "gallery")
PLACE_CONTEXT = ("menu", "visit", "open")
RETROSPECTIVE = ("enjoyed", "held", "attended")
URL = r"https?://[^\s\"'<>)]+"


def found(tokens: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.array_intersect(tokens, F.array(*map(F.lit, vocabulary)))


def signals(text: Column) -> Column:
    """Counts of distinct terms by kind, and whether there is a date, a clock, a price."""
    return bound(texts.tokens(text), lambda tokens: _signals(text, tokens))


def _signals(text: Column, tokens: Column) -> Column:
    size = lambda v: F.size(found(tokens, v))
    return F.struct(
        size(STRONG).alias("strong"), size(WEAK).alias("weak"), size(ATTENDANCE).alias("attendance"), size(REGISTRATION).alias("registration"),
        size(PLACE).alias("place"), size(PLACE_CONTEXT).alias("place_context"), size(RETROSPECTIVE).alias("retrospective"),
        text.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}").alias("date"), text.rlike(r"\b[0-9]{1,2}:[0-9]{2}\b").alias("time"),
        F.lower(text).rlike(r"\b[0-9]+(\.[0-9]+)? (usd|toman)\b").alias("price"), text.rlike("\"[^\"]+\"").alias("named"),
    )


def capped(n: Column, first: float, more: float, cap: float) -> Column:
    return F.when(n > 0, first + F.least(F.lit(cap), more * (n - 1))).otherwise(0.0)


def score(s: Column) -> tuple[Column, Column]:
    """(event, place): positive weights less two for each sign that it is over."""
    yes = lambda c, w: F.when(c, w).otherwise(0.0)
    past = 2.0 * s["retrospective"]
    event = capped(s["strong"], 2.0, 0.5, 1.0) + yes(s["weak"] > 0, 1.0) + yes(s["named"] & (s["strong"] > 0), 2.0) + yes(s["date"], 1.5) + yes(s["time"], 1.0) + yes(s["registration"] > 0, 1.5) + yes(s["attendance"] > 0, 1.0) + yes(s["price"], 0.5) - past
    place = capped(s["place"], 2.0, 0.5, 1.0) + yes(s["place_context"] > 0, 1.5) + yes(s["price"] & (s["place"] > 0), 0.5) - past
    return event, place


def classify(s: Column, threshold: float = 3.0) -> Column:
    """event by a term with date, clock or registration, or by attendance with a named strong term; else place, else other."""
    event, place = score(s)
    term = (s["strong"] + s["weak"]) > 0
    a = term & (s["date"] | s["time"] | (s["registration"] > 0))
    b = (s["attendance"] > 0) & (s["strong"] > 0) & s["named"]
    return F.when((a | b) & (event >= threshold), "event").when((s["place"] > 0) & (place >= threshold), "place").otherwise("other")


def labelled(text: Column, label: str) -> Column:
    """The rest of the first line that begins with a label and a separator."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^{label}[ \t]*[:=-][ \t]*(.+)$", 1)), F.lit(""))


def title(text: Column) -> Column:
    """A quoted name, else the first line."""
    return F.coalesce(F.nullif(F.regexp_extract(text, '"([^"]+)"', 1), F.lit("")), F.nullif(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit("")))


def urls(text: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({URL})"), 1)), 1, most)


def event_format(text: Column) -> Column:
    """online, in_person or hybrid by clauses; negated clauses do not count."""
    clauses = F.split(F.lower(text), r"[.;,\n]")
    said = lambda word: F.exists(clauses, lambda c: c.rlike(rf"\b{word}\b") & ~c.rlike(r"\b(not|no|was)\b"))
    online, there = said("online"), said("(in person|in-person|onsite)")
    return F.when(online & there, "hybrid").when(online, "online").when(there, "in_person")


def minutes(text: Column) -> Column:
    """A duration in minutes: hours, half hours and minutes."""
    low = F.lower(text)
    hours = F.regexp_extract(low, r"\b([0-9]+(?:\.5)?) ?hours?\b", 1)
    mins = F.regexp_extract(low, r"\b([0-9]+) ?min(?:ute)?s?\b", 1)
    some = (hours != "") | (mins != "")
    return F.when(some, F.coalesce(hours.try_cast("double"), F.lit(0.0)) * 60 + F.coalesce(mins.try_cast("double"), F.lit(0.0))).cast("long")


def admission(kind: Column, title_: Column, text: Column) -> Column:
    """Why a candidate is not shown, or null: it must be an event with a real title that its text supports."""
    placeholders = sorted({" ".join(t.text for t in tokenized(p)) for p in PLACEHOLDERS})

    def judged(key: Column) -> Column:
        return F.when(key.isNull() | (key == ""), "missing_title").when(key.isin(*placeholders), "placeholder_title").when(~F.contains(texts.text_key(text, True), key), "unsupported_title")

    return F.when(kind != "event", "not_established_event").otherwise(bound(texts.text_key(title_, True), judged))


def context_guard(text: Column) -> Column:
    """Kinds of text that are judged before classification."""
    low = F.lower(text)
    return F.when(low.rlike(r"\b(weekly digest|events this week)\b"), "collection").when(low.rlike(r"\b(enjoyed|was held)\b") & ~low.rlike(r"\bregister\b"), "past_only").when(low.rlike(r"\b(discount|sale)\b"), "product_promotion")
