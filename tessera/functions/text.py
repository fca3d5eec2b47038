"""Text: folding, tokens, titles, lines, quality; pure column expressions unless a function says otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

# Digits and letters folded one for one, and separators that no reader sees.
DIGITS_FROM = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
DIGITS_TO = "01234567890123456789"
LETTERS_FROM = "يىكةأإآٱ"
LETTERS_TO = "ییکهاااا"
FOLDED_FROM, FOLDED_TO = "يىك", "ییک"
HIDDEN = "\u200c\u200b\u200d\u200e\u200f\ufeff\u00a0\u2066\u2067\u2068\u2069"
DISPLAY_EDGE = "^[ «»“”\"،,.؛:]+|[ «»“”\"،,.؛:]+$"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
GENERIC_TITLE = (
    "event", "events", "workshop", "concert", "exhibition", "festival", "the", "a", "an", "of", "and", "in", "at", "for",
    "نمایشگاه", "رویداد", "ایونت", "کارگاه", "کنسرت", "جشنواره", "و", "در", "از", "به", "برای",
)


AT_ONCE = 32  # texts that are Python strings at once


def normalize(text: Column) -> Column:
    """Length-preserving: digits to ASCII, Arabic to Persian letters, hidden separators to spaces, lower case."""
    return F.lower(F.translate(text, DIGITS_FROM + LETTERS_FROM + HIDDEN, DIGITS_TO + LETTERS_TO + " " * len(HIDDEN)))


def fold(text: Column) -> Column:
    """As ``normalize``, with the zero-width non-joiner a space, other format characters dropped and blanks collapsed."""
    plain = F.translate(text, DIGITS_FROM + FOLDED_FROM + "\u200c", DIGITS_TO + FOLDED_TO + " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(plain, r"\p{Cf}", "")), r"\s+", " "))


def _normalized(form: str, text: pa.Array) -> pa.Array:
    """A Unicode form of each text, ``AT_ONCE`` rows at a time: a batch is never held as Python strings, which take up to four bytes a character."""
    parts = [pa.array([None if t is None else unicodedata.normalize(form, t) for t in text.slice(a, AT_ONCE).to_pylist()], pa.string()) for a in range(0, len(text), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def compatible(text: pa.Array) -> pa.Array:
    """NFKC; Spark has no function for it, so only text beyond ASCII should come here."""
    return _normalized("NFKC", text)


def text_key(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, folded, all but letters and digits a space, blanks collapsed."""
    plainly = text.rlike(r"^\p{ASCII}*$")  # a Python function gets every row, whatever the condition around it: what needs none is null there
    plain = fold(text if ascii_only else F.when(plainly, text).otherwise(compatible(F.when(~plainly, text))))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def is_number(token: Column) -> Column:
    return token.rlike(r"^\p{N}+$")


def distinctive(key: Column) -> Column:
    """Distinct tokens, of a ``text_key``, that tell titles apart."""
    generic = F.array(*map(F.lit, GENERIC_TITLE))
    return F.array_sort(F.array_except(F.filter(F.split(key, " "), lambda t: t != ""), generic))


def title_tokens(text: Column) -> Column:
    return distinctive(text_key(text, True))


def title_relation(key_a: Column, key_b: Column, a: Column, b: Column) -> Column:
    """weak, exact, different, strong or partial, of two titles' keys and distinctive tokens.

    A title of numbers and generic words alone is weak.  Numbers must agree;
    then two shared tokens and 0.85 of all make a strong relation.
    """
    numbers = lambda x: F.array_sort(F.filter(x, is_number))
    named = lambda x: F.exists(x, lambda t: ~is_number(t))
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return (
        F.when(~named(a) | ~named(b), "weak")
        .when(F.coalesce(key_a == key_b, F.lit(False)), "exact")
        .when(numbers(a) != numbers(b), "different")
        .when((shared >= 2) & (100 * shared >= 85 * every), "strong")
        .when(shared > 0, "partial")
        .otherwise("different")
    )


def meaningful(text: Column, function_words: tuple[str, ...] = GENERIC_TITLE) -> Column:
    """Has it a token with a digit, or one longer than a character that is no function word?"""
    return F.exists(tokens(text), lambda t: t.rlike("[0-9]") | ((F.char_length(t) > 1) & ~t.isin(*function_words)))


def detect_language(text: Column) -> Column:
    """fa or en by the majority of letters; null where neither has it."""
    persian, latin = F.regexp_count(text, F.lit(r"[ء-ی]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(persian > latin, "fa").when(latin > persian, "en")


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """NFC, for text beyond ASCII."""
    return _normalized("NFC", text)


def display_text(text: Column) -> Column:
    """Spelling for display: NFC, Persian letters, no format characters but the non-joiner, blanks collapsed, quotes and stops at the ends dropped."""
    whole = F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(composed(text))
    plain = F.regexp_replace(F.translate(whole, "يك", "یک"), r"[\p{Cf}&&[^\u200c]]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), DISPLAY_EDGE, "")


def agreement_key(text: Column) -> Column:
    return F.regexp_replace(normalize(text), r"\s+", "")


def near_word(a: Column, b: Column, noisy: Column) -> Column:
    """Does a reading ``a`` render the word ``b``: equal, one more character at its end, or, where readings are noisy, one letter beyond ASCII for another in a word of four or more."""
    extra = F.char_length(a) == F.char_length(b) + 1
    cut = F.when(extra, F.substring(a, F.lit(1), F.char_length(b))).otherwise(a)
    pairs = F.filter(F.arrays_zip(F.split(cut, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] != p["y"])
    letters = F.forall(pairs, lambda p: p["x"].rlike(r"^[\p{L}&&[^\x00-\x7F]]$") & p["y"].rlike(r"^[\p{L}&&[^\x00-\x7F]]$"))
    swapped = noisy & (F.char_length(cut) == F.char_length(b)) & (F.char_length(b) >= 4) & (F.size(pairs) == 1) & letters
    return (a == b) | (extra & a.startswith(b)) | swapped


def string_form(value: Column) -> Column:
    """The shape of a value, never the value."""
    return (
        F.when(value.isNull(), "null").when(value == "", "empty").when(value.rlike(r"^[0-9]+$"), "integer").when(value.rlike(r"^[0-9]+\.[0-9]+$"), "decimal")
        .when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").when(value.rlike(r"^https?://"), "url").when(value.rlike(r"^[A-Za-z0-9_-]+$"), "token").otherwise("text")
    )


READING = StructType().add("letter_ratio", DoubleType()).add("word_ratio", DoubleType()).add("score", DoubleType()).add("verdict", StringType())
UNSEEN = "\u200c\u200e\u200f\u2066\u2067\u2068\u2069"
PERSIAN, LATIN = re.compile("[\u0600-\u06ff]"), re.compile("[A-Za-z]")


def assess(text: str | None) -> tuple[float, float, float, str]:
    """Ratios of letters and of words, the score, and the first rule that speaks against a reading, or plausible.

    Short Latin fragments speak against a text that is mostly Persian; a line
    without a word, or with as many of them as Persian words, is noisy.
    """
    value = (text or "").strip()
    if not value:
        return 0.0, 0.0, 0.0, "empty"
    split = lambda x: [t for w in x.split() if (t := w.strip(UNSEEN))]
    word = lambda t: sum(map(str.isalpha, t)) >= 2
    fragment = lambda t: len(t) <= 3 and LATIN.search(t) is not None and PERSIAN.search(t) is None
    share = lambda n, of: n / of if of else 0.0
    letters = [c for c in value if c.isalpha()]
    seen = sum(not c.isspace() and c not in UNSEEN for c in value)
    tokens = split(value)
    persian = sum(PERSIAN.match(c) is not None for c in letters) > sum(LATIN.match(c) is not None for c in letters)
    letter_ratio, word_ratio = share(len(letters), seen), share(sum(map(word, tokens)), len(tokens))
    stray = sum(map(fragment, tokens))
    noisy, lines = 0, [split(x) for x in value.splitlines() if x.strip()]
    for own in lines:
        words, strays = [t for t in own if word(t)], sum(map(fragment, own))
        noisy += not words or (persian and 0 < strays >= sum(PERSIAN.search(t) is not None for t in words))
    noise, strayed = share(noisy, len(lines)), share(stray, len(tokens))
    score = max(0.0, round(0.5 * letter_ratio + 0.5 * word_ratio - (strayed if persian else 0.0) - 0.5 * noise, 3))
    rules = {"mostly_symbols": letter_ratio < 0.5, "fragmented": word_ratio < 0.5, "mixed_script_noise": persian and stray >= 3 and strayed >= 0.15, "noisy_lines": noisy >= 2 and noise >= 0.3, "plausible": True}
    return round(letter_ratio, 3), round(word_ratio, 3), score, next(k for k, on in rules.items() if on)


@F.pandas_udf(READING)
def _assessed(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(assess, text)), columns=READING.names)


def quality(text: Column) -> dict[str, Column]:
    """``assess`` of each row, by field; Python's letters are those of every script, which no built-in function counts so."""
    found = _assessed(text)
    return {k: found[k] for k in READING.names}


def clip(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def csv_guard(value: Column) -> Column:
    """A quote before what a spreadsheet would run."""
    return F.when(value.rlike(r"^[﻿\s]*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)
