"""Personal data: format-preserving Feistel pseudonyms."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Remembered
from tessera.llm.common import lean, slices

ROUNDS = 10
SPAN = "array<struct<kind:string,start:int,stop:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


class Feistel:
    """A keyed permutation of 0..n-1 for any n: two halves base ceil(sqrt n), walked until the value is below n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, n: int, r: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}:{n}:{r}:{half}".encode(), key=self.key, digest_size=32).digest(), "big")

    def permute(self, x: int, n: int, tweak: str) -> int:
        a = math.isqrt(n - 1) + 1 if n > 1 else 1
        while True:
            left, right = divmod(x, a)
            for r in range(ROUNDS):
                left, right = right, (left + self._round(tweak, n, r, right)) % a
            x = left * a + right
            if x < n:
                return x

    def restore(self, x: int, n: int, tweak: str) -> int:
        a = math.isqrt(n - 1) + 1 if n > 1 else 1
        while True:
            left, right = divmod(x, a)
            for r in reversed(range(ROUNDS)):
                left, right = (right - self._round(tweak, n, r, left)) % a, left
            x = left * a + right
            if x < n:
                return x


Step = Callable[[int, int, str], int]  # Feistel.permute or Feistel.restore


#: Digits as bytes to the sum of the digits of their doubles, as bytes of digits.
DOUBLED = bytes.maketrans(b"0123456789", b"0246813579")


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    d = digits.encode()
    return -(sum(d[-1::-2].translate(DOUBLED)) + sum(d[-2::-2]) - 48 * len(d)) % 10


def put(form: str, chars: str) -> str:
    """``form`` with its letters and digits replaced in order; separators stay."""
    new = iter(chars)
    return "".join(next(new) if c.isascii() and c.isalnum() else c for c in form)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _by_class(text: str, step: Step, tweak: str) -> str:
    """Letters become letters of the same case and digits digits, all in one permutation of the format's strings."""
    bases = [(ord("0"), 10) if c.isdigit() else (ord("a"), 26) if c.islower() else (ord("A"), 26) for c in text]
    x = 0
    n = math.prod(b for _, b in bases)
    for c, (zero, b) in zip(text, bases, strict=True):
        x = x * b + ord(c) - zero
    x = step(x, n, tweak + "".join("d" if b == 10 else "a" if z == ord("a") else "A" for z, b in bases))
    out = []
    for zero, b in reversed(bases):
        x, d = divmod(x, b)
        out.append(chr(zero + d))
    return "".join(reversed(out))


def email(text: str, step: Step) -> str | None:
    local, _, domain = text.rpartition("@")
    own = "".join(c for c in local if c.isascii() and c.isalnum())
    return f"{put(local, _by_class(own, step, 'email:' + domain.lower()))}@{domain}" if own else None


def card(text: str, step: Step) -> str | None:
    """13 to 19 digits with a right check digit, in one or in groups of 4 or of 4, 6 and 5; the first digit and the length stay."""
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
        return None
    middle = f"{step(int(d[1:-1]), 10 ** (len(d) - 2), 'card' + d[0]):0{len(d) - 2}d}"
    return put(text, d[0] + middle + str(luhn(d[0] + middle)))


def phone(text: str, step: Step) -> str | None:
    """Ten national digits, with or without +1 before them."""
    d = _digits(text)
    lead, d = d[:-10], d[-10:]
    return put(text, lead + f"{step(int(d), 10**10, 'phone'):010d}") if len(d) == 10 and lead in ("", "1") else None


def address(text: str, step: Step) -> str | None:
    """Four numbers to 255; each pseudonym is such an address again."""
    parts = text.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    return ".".join(map(str, step(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip").to_bytes(4, "big")))


def social(text: str, step: Step) -> str | None:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    a, g, s = map(int, text.split("-"))
    if not (0 < a < 900 and a != 666 and g and s):
        return None
    x = step(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "social")
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def iban(text: str, step: Step) -> str | None:
    """A right mod-97 check; country and class of each place stay."""
    s = text.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1 or not 2 <= int(s[2:4]) <= 98:
        return None
    body = _by_class(s[4:], step, "iban" + s[:2])
    return put(text, f"{s[:2]}{98 - number(body + s[:2] + '00') % 97:02d}{body}")


def _day(y: int, m: int, d: int, step: Step) -> tuple[int, int, int] | None:
    """A day of the same century, or nothing for a day that no calendar has."""
    try:
        day = datetime.date(y, m, d)
    except ValueError:
        return None
    first = datetime.date(max(1, y // 100 * 100), 1, 1).toordinal()
    last = datetime.date(y // 100 * 100 + 99, 12, 31).toordinal()
    new = datetime.date.fromordinal(first + step(day.toordinal() - first, last - first + 1, f"date{y // 100}"))
    return new.year, new.month, new.day


def iso_date(text: str, step: Step) -> str | None:
    got = _day(int(text[:4]), int(text[5:7]), int(text[8:]), step)
    return put(text, "{:04d}{:02d}{:02d}".format(*got)) if got else None


def day_first(text: str, step: Step) -> str | None:
    got = _day(int(text[6:]), int(text[3:5]), int(text[:2]), step)
    return put(text, "{2:02d}{1:02d}{0:04d}".format(*got)) if got else None


#: Kinds in order of precedence where they begin at the same place.
KINDS: dict[str, tuple[str, Callable[[str, Step], str | None]]] = {
    "email": (r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),  # the local part is sought from the sign on to the left
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    "card": (r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?![0-9-])", card),
    "iso_date": (r"(?<![0-9/.-])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9/-])", iso_date),
    "day_first": (r"(?<![0-9/.-])[0-9]{2}([-/.])[0-9]{2}\1[0-9]{4}(?![0-9/-])", day_first),
    "social": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social),
    "phone": (r"(?<![0-9+])(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", phone),
    "address": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", address),
}
PATTERNS = {k: (re.compile(p), f) for k, (p, f) in KINDS.items()}
WORTH = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def readings(kind: str, text: str, start: int, stop: int, at: int) -> Iterator[tuple[int, int]]:
    """The places that a match may stand for, the longest first: numbers in groups may end before the last group that fits the pattern."""
    if kind == "email":
        while start > at and text[start - 1] in LOCAL:
            start -= 1
        if text[start] == "@":
            return
    yield start, stop
    if kind in ("card", "iban"):
        while (stop := text.rfind(" ", start, stop)) > start:
            if PATTERNS[kind][0].fullmatch(text, start, stop):
                yield start, stop


def matches(kind: str, text: str, step: Step, taken: bytearray) -> Iterator[tuple[int, int, str]]:
    """(start, stop, pseudonym) of one kind from left to right, where nothing is taken; what fails validation is sought again from the next place on."""
    pattern, change = PATTERNS[kind]
    at = 0
    while m := pattern.search(text, at):
        done = m.start() + 1
        for a, b in readings(kind, text, m.start(), m.end(), at):
            if 1 not in taken[a:b] and (new := change(text[a:b], step)) is not None:
                yield a, b, new
                done = b
                break
        at = done


def rewrite(text: str, step: Step) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, stop) of each in the text given; a place belongs to the first kind that claims it."""
    if not WORTH.search(text):
        return text, []
    places, taken = [], bytearray(len(text))
    for kind in PATTERNS:
        for a, b, new in matches(kind, text, step, taken):
            taken[a:b] = b"\1" * (b - a)
            places.append((a, b, kind, new))
    out, at = [], 0
    places.sort()
    for a, b, _, new in places:
        out += text[at:a], new
        at = b
    return "".join(out) + text[at:], [(k, a, b) for a, b, k, _ in places]


def pseudonymise(docs: DataFrame, key: bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: (id, text with pseudonyms, spans of the values replaced in the text given, as code points).

    E-mail addresses, card numbers, IBANs, telephone and social security
    numbers, IPv4 addresses and dates are validated and then permuted, with
    ``key``, among the valid values of their format.  Equal values get equal
    pseudonyms in all documents, and who has the key can restore them.  What
    fails validation stays.  One narrow pass without a shuffle.

    A null text stays null without spans, an empty one empty; the work on a very
    long text is in proportion to its length; of places that two kinds claim the
    first kind has them; repeated rows give equal results; null ids are
    returned; other columns are not read; an empty table gives no rows.
    """

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        known = Remembered(lambda k: feistel.permute(*k), 100_000)
        step = lambda x, n, tweak: known[x, n, tweak]
        for batch in slices(batches, "_text"):
            found = [(t, []) if t is None else rewrite(t, step) for t in batch.column("_text").to_pylist()]
            spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in s] for _, s in found]
            yield pa.record_batch([batch.column("_id"), pa.array([t for t, _ in found], pa.string()), pa.array(spans, _SPAN)], names=["_id", "text", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    read = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    return read.mapInArrow(lean(change), f"_id {kind}, text string, spans {SPAN}").withColumnRenamed("_id", id_column)
