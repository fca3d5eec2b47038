"""What a text says of its date, price, place and links, in its own words: expressions over the text and its signals.

A signal is a (kind, term, start, stop) of ``analysis.signals``; places are code
points.  Nothing is rewritten or guessed: a value is a slice of the text, or null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as texts
from tessera.functions import vocabulary as v
from tessera.functions.phrases import normalized
from tessera.functions.temporal import bound

# Labels of fields, what may stand between a label and its value, and what is trimmed from values.
LABELS = {
    "address": ("آدرس", "ادرس", "نشانی", "address", "location"),
    "venue": ("محل برگزاری", "مکان برگزاری", "مکان", "محل", "venue"),
    "date": ("زمان برگزاری", "تاریخ", "زمان", "date", "time", "when"),
    "price": ("قیمت بلیت", "قیمت بلیط", "هزینه شرکت", "ticket price", "ورودی", "هزینه", "قیمت", "price", "entry", "fee"),
    "city": ("شهر", "city"),
    "area": ("محله", "منطقه", "محدوده", "neighborhood", "neighbourhood", "area"),
    "duration": ("مدت زمان اجرا", "مدت زمان برنامه", "مدت زمان برگزاری", "مدت زمان", "مدت برگزاری", "مدت", "duration"),
    "organizer": ("برگزارکنندگان", "برگزار کنندگان", "برگزارکننده", "برگزار کننده", "میزبان", "organized by", "organizer", "hosted by"),
    "capacity": ("ظرفیت باقی مانده", "ظرفیت باقیمانده", "ظرفیت", "capacity", "availability"),
}
SEPARATORS = r"[:：–—\-=]"
CITIES = (
    "تهران", "کرج", "کاشان", "اصفهان", "شیراز", "مشهد", "تبریز", "یزد", "رشت", "اهواز", "کرمان", "قم",
    "tehran", "karaj", "isfahan", "esfahan", "shiraz", "mashhad", "tabriz", "yazd", "rasht",
)
TRIM = " \t\r\u200c؛،,;:\\-–—•*_\u2066\u2067\u2068\u2069\ufeff"
CONNECTORS = ("و", "تا", "الی", "از", "ماه", "ها", "and", "to", "at")
_ORDINALS = ("یکم", "اول", "دوم", "سوم", "چهارم", "پنجم", "ششم", "هفتم", "هشتم", "نهم")
ORDINALS = (
    *_ORDINALS, "دهم", "یازدهم", "دوازدهم", "سیزدهم", "چهاردهم", "پانزدهم", "شانزدهم", "هفدهم", "هجدهم", "نوزدهم", "بیستم",
    *("بیست و " + unit for unit in _ORDINALS), "سی ام", "سی و یکم", "سی و اول",
)
BEFORE_ORDINALS = (*(w for d in v.WEEKDAYS[:11] for w in (d, *d.split())), "از", "تاریخ", "زمان", "روز", "روزهای")
FREE = r"(?U)(?<!\w)(?:رایگان|بدون\s+هزینه|free|no\s+fee)(?!\w)"
AMOUNT = r"(?U)(?:[$€£]\s*\d[\d\s,٬،.]*)|(?:\d[\d\s,٬،.]*(?:هزار|میلیون|million|thousand)?\s*(?:تومان|تومن|ریال|دلار|usd|eur|gbp|dollars?))\b"
ANY_AMOUNT = r"(?U)(?<!\w)\d[\d\s,٬،.]*(?!\w)"
PART = r"(?U)^(\s*(?:صبح|بامداد|ظهر|بعد\s?از\s?ظهر|عصر|شب))(?!\w)"
RANGE = r"(?U)^(\s*(?:تا|الی|to|-|–|—)\s*\d{1,2}(?::\d{2})?)"
YEAR = r"^([ \t\u200c]+\d{4})(?![\d:/\-])"
ENGLISH_DATE = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:\s*(?:to|[-–—])\s*\d{1,2})?,?\s+\d{4}\b"
DAY_RANGE = r"(?U)\d{1,2}\s+\S+(?:\s+\d{4})?\s+(?:تا|الی)\s+\d{1,2}\s+\S+"

_DAY = r"(?:\d{1,4}|" + "|".join(re.escape(normalized(w)).replace(r"\ ", r"\s*") for w in sorted(ORDINALS, key=len, reverse=True)) + ")"
LEADING = rf"(?U)((?<!\w){_DAY}(?:\s*(?:و|,|،|-|–|تا|الی)\s*{_DAY})*\s*)\z"
SPAN = "struct<a:int,b:int,line:int,date:boolean,time:boolean,concrete:boolean,month:boolean>"


def any_of(words) -> str:
    return "|".join(re.escape(normalized(w)) for w in sorted(words, key=len, reverse=True))


def label_pattern(name: str) -> str:
    """A label with its separator; not where it ends a longer label of another field."""
    alone = []
    for label in LABELS[name]:
        longer = {normalized(x)[: -len(normalized(label))] for other, own in LABELS.items() if other != name for x in own if x != label and normalized(x).endswith(" " + normalized(label))}
        alone.append("".join(f"(?<!{re.escape(x)})" for x in sorted(longer)) + re.escape(normalized(label)))
    return rf"(?:(?<=^)|(?<=\W))(?:{'|'.join(sorted(alone, key=len, reverse=True))})\s*{SEPARATORS}\s*"


def trimmed(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value, f"^[{TRIM}\n]+|[{TRIM}\n]+$", ""), F.lit(""))


def cut(text: Column, a: Column, b: Column) -> Column:
    return F.substring(text, a + 1, b - a)


def labelled_span(low: Column, name: str) -> Column:
    """(a, b) of the value of a field's first label, on its line or else the next with a value; null without one.  ``low`` is the normalized text."""
    before = F.regexp_extract(low, rf"(?sU)^(.*?{label_pattern(name)})[{TRIM}\n]*[^\n]", 1)
    lead = F.regexp_extract(low, rf"(?sU)^(.*?{label_pattern(name)}[{TRIM}\n]*)[^\n]", 1)
    start = F.char_length(lead)
    rest = F.regexp_replace(F.regexp_extract(F.substring(low, start + 1, F.char_length(low)), r"^([^\n]*)", 1), f"[{TRIM}]+$", "")
    return F.when(before != "", F.struct(start.alias("a"), (start + F.char_length(rest)).alias("b")))


def labelled(text: Column, low: Column, name: str) -> Column:
    return bound(labelled_span(low, name), lambda s: cut(text, s["a"], s["b"]))


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def line_number(low: Column, at: Column) -> Column:
    before = F.substring(low, F.lit(1), at)
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))


def line_of(text: Column, at: Column) -> Column:
    """The line on which a place stands."""
    return F.get(F.split(text, "\n"), line_number(text, at))


def related(gap: Column) -> Column:
    """Do two temporal signals belong together across these characters?"""
    words = F.concat(F.array(F.lit("")), texts.tokens(gap))
    ok = {normalized(w) for w in CONNECTORS} | {t for w in ORDINALS for t in normalized(w).split()}
    return (F.char_length(gap) <= 40) & ~gap.rlike("[؟?!؛;\n]") & F.forall(words, lambda w: (w == "") | w.rlike(r"^\p{Nd}+$") | w.isin(*sorted(ok)))


def clusters(low: Column, found: Column) -> Column:
    """Temporal signals that stand together, line by line: islands of offsets, in text order."""
    months = [m for m in (*v.MONTH_FORMS, *v.PERSIAN_MONTHS, *v.ENGLISH_MONTHS)]
    order = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["stop"] - x["stop"])
    span = lambda s: F.struct(
        s["start"].alias("a"), s["stop"].alias("b"), line_number(low, s["start"]).alias("line"), (s["kind"] == "date").alias("date"), (s["kind"] == "time").alias("time"),
        ((s["kind"] == "date") & ~s["term"].isin(*v.RELATIVE)).alias("concrete"), s["term"].isin(*months).alias("month"),
    )
    each = F.transform(F.array_sort(of_kind(found, "date", "time"), order), span)

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = last.isNotNull() & (last["line"] == x["line"]) & ((x["a"] <= last["b"]) | related(cut(low, last["b"], x["a"])))
        later = x["b"] >= last["b"]
        both = F.struct(
            last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"), last["line"].alias("line"), (last["date"] | x["date"]).alias("date"), (last["time"] | x["time"]).alias("time"),
            (last["concrete"] | x["concrete"]).alias("concrete"), F.when(later, x["month"]).otherwise(last["month"]).alias("month"),
        )
        return F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(each, F.array().cast(f"array<{SPAN}>"), add)


def widened(low: Column, c: Column) -> Column:
    """A cluster with the days before it, and the part of the day, the end of a range or the year after it."""
    before = F.regexp_extract(F.substring(low, F.lit(1), c["a"]), r"([^\n]*)\z", 1)
    days = F.regexp_extract(before, LEADING, 1)
    ahead = F.substring(before, F.lit(1), F.char_length(before) - F.char_length(days))
    last_word = F.regexp_extract(ahead, r"(?U)(\w+)\s*\z", 1)
    whole = days.rlike(r"^\s*\p{Nd}") | ~ahead.rlike(r"(?U)\w\s*\z") | last_word.isin(*sorted({normalized(w) for w in BEFORE_ORDINALS}))
    start = c["a"] - F.when(whole, F.char_length(days)).otherwise(0)
    rest = F.regexp_extract(F.substring(low, c["b"] + 1, F.char_length(low)), r"^([^\n]*)", 1)
    part = F.when(c["time"], F.char_length(F.regexp_extract(rest, PART, 1))).otherwise(0)
    tail = lambda n: F.substring(rest, n + 1, F.char_length(rest))

    def ended(n: Column) -> Column:
        to = F.char_length(F.regexp_extract(tail(n), RANGE, 1))
        return F.when(to > 0, bound(n + to, lambda m: m + F.char_length(F.regexp_extract(tail(m), PART, 1)))).when(c["month"], n + F.char_length(F.regexp_extract(tail(n), YEAR, 1))).otherwise(n)

    stop = c["b"] + bound(part, ended)
    return _trimmed(low, c.withField("a", start).withField("b", stop))


def _trimmed(low: Column, c: Column) -> Column:
    own = cut(low, c["a"], c["b"])
    first = F.char_length(own) - F.char_length(F.regexp_replace(own, f"^[{TRIM}]+", ""))
    last = F.char_length(own) - F.char_length(F.regexp_replace(own, f"[{TRIM}]+$", ""))
    return c.withField("a", c["a"] + first).withField("b", c["b"] - last)


def _rank(c: Column) -> Column:
    return F.struct((c["date"] & c["time"]).alias("both"), c["concrete"].alias("concrete"), c["time"].alias("time"), (-c["a"]).alias("first"), c.alias("c"))


def _best(spans: Column) -> Column:
    return F.array_max(F.transform(spans, _rank))["c"]


def _completed(text: Column, chosen: Column, spans: Column) -> Column:
    """The wording of a span, with that of the best span on a line beside it that says what it lacks."""
    lacking = F.filter(spans, lambda o: (F.abs(o["line"] - chosen["line"]) == 1) & ((chosen["date"] & o["time"]) | (chosen["time"] & o["date"])))
    alone = cut(text, chosen["a"], chosen["b"])

    def joined(other: Column) -> Column:
        own = cut(text, other["a"], other["b"])
        return F.when(other.isNull(), alone).when(other["a"] < chosen["a"], F.concat(own, F.lit("\n"), alone)).otherwise(F.concat(alone, F.lit("\n"), own))

    return F.when(chosen["date"] & chosen["time"], alone).otherwise(bound(_best(lacking), joined))


def source_date(text: Column, found: Column) -> Column:
    """The text's own wording of its date and clock; null where it has none.

    One English date in full comes first, with what competes with it, one a
    line; then a labelled value; then the one range of days; then the best of the
    clusters: date and clock, a day rather than a relative word, a clock, the
    first.  A clock on the line beside a date, or the reverse, goes with it.
    """
    return bound(F.struct(texts.normalize(text).alias("low"), found.alias("s")), lambda x: _source_date(text, x["low"], x["s"]))


def _source_date(text: Column, low: Column, found: Column) -> Column:
    spans = F.transform(clusters(low, found), lambda c: widened(low, c))
    return bound(F.filter(spans, lambda c: c["a"] < c["b"]), lambda every: _chosen(text, low, found, every))


def _chosen(text: Column, low: Column, found: Column, every: Column) -> Column:
    english = F.regexp_extract_all(text, F.lit(f"({ENGLISH_DATE})"), 1)
    where = F.char_length(F.regexp_extract(text, rf"(?s)^(.*?){ENGLISH_DATE}", 1))
    stop = where + F.char_length(F.get(english, 0))
    persian = [*v.MONTH_FORMS, *v.PERSIAN_MONTHS]
    dated = F.filter(every, lambda c: c["date"] & ((c["a"] >= stop) | (c["b"] <= where)) & cut(text, c["a"], c["b"]).rlike(r"\p{Nd}") & F.exists(of_kind(found, "date"), lambda s: s["term"].isin(*persian) & (s["start"] >= c["a"]) & (s["stop"] <= c["b"])))
    rivals = F.concat(english, F.transform(dated, lambda c: cut(text, c["a"], c["b"])))
    end = F.array_max(F.concat(F.array(stop), F.transform(F.filter(every, lambda c: c["time"] & (c["a"] <= stop) & (stop < c["b"])), lambda c: c["b"])))
    span = lambda a, b, date, time, concrete: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), line_number(low, a).alias("line"), date.alias("date"), time.alias("time"), concrete.alias("concrete"), F.lit(False).alias("month"))
    yes = F.lit(True)
    in_english = bound(end, lambda e: _completed(text, span(where, e, yes, e > stop, yes), every))

    def by_label(s: Column) -> Column:
        inside = F.filter(of_kind(found, "date", "time"), lambda x: ((x["start"] >= s["a"]) & (x["start"] < s["b"])) | ((x["start"] <= s["a"]) & (x["stop"] > s["a"])))
        of = lambda kind: F.exists(inside, lambda x: x["kind"] == kind)
        return _completed(text, span(s["a"], s["b"], of("date") | (F.size(inside) == 0), of("time"), yes), every)

    ranges = F.filter(every, lambda c: c["date"] & ~c["time"] & cut(low, c["a"], c["b"]).rlike(DAY_RANGE))
    free = trimmed(bound(F.when(F.size(ranges) == 1, F.get(ranges, 0)).otherwise(_best(every)), lambda c: _completed(text, c, every)))
    return F.when(F.size(english) == 1, F.when(F.size(dated) > 0, F.array_join(rivals, "\n")).otherwise(in_english)).when(F.size(english) > 1, F.array_join(rivals, "\n")).otherwise(
        bound(labelled_span(low, "date"), lambda s: F.when(s.isNotNull(), by_label(s)).when(F.size(every) > 0, free))
    )


def price(text: Column, found: Column) -> Column:
    """A labelled price with an amount, or free; else the first line with a word for prices and such; null for a bare word."""
    low = texts.normalize(text)
    said = labelled(text, low, "price")
    amount = lambda x, *patterns: F.coalesce(_either([texts.normalize(x).rlike(p) for p in patterns]), F.lit(False))
    lines = F.filter(F.transform(of_kind(found, "price"), lambda s: trimmed(line_of(text, s["start"]))), lambda x: amount(x, FREE, AMOUNT))
    return F.when(amount(said, FREE, AMOUNT, ANY_AMOUNT), said).otherwise(F.get(lines, 0))


def _either(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def registration_url(text: Column, found: Column) -> Column:
    """The link nearest to a word for registration on its line, of equally near ones the first."""
    links = F.transform(of_kind(found, "url"), lambda u: F.struct(line_number(text, u["start"]).alias("line"), u["start"].alias("a"), u["stop"].alias("b")))
    words = F.transform(of_kind(found, "registration"), lambda r: F.struct(line_number(text, r["start"]).alias("line"), r["start"].alias("a"), r["stop"].alias("b")))
    near = F.flatten(F.transform(links, lambda u: F.transform(F.filter(words, lambda r: r["line"] == u["line"]), lambda r: F.struct(F.greatest(r["a"] - u["b"], u["a"] - r["b"], F.lit(0)).alias("far"), u["a"].alias("a"), cut(text, u["a"], u["b"]).alias("url")))))
    return F.array_min(near)["url"]


def opening_hours(text: Column, found: Column) -> Column:
    """The line on which a place says when it is open."""
    return F.get(F.filter(F.transform(F.filter(found, lambda s: (s["kind"] == "place_context") & s["term"].isin(*v.OPENING, *v.DAILY)), lambda s: trimmed(line_of(text, s["start"]))), lambda x: x.isNotNull()), 0)


def city(text: Column) -> Column:
    """A labelled city, else the first word that is a known city's name outside of tags and handles, as written."""
    low = texts.normalize(text)
    plain = F.regexp_replace(low, r"(?U)[#@][\w\u200c ]?\w+", " ")
    names = "|".join(re.escape(normalized(c)) for c in CITIES)
    return F.coalesce(labelled(text, low, "city"), F.nullif(F.regexp_extract(plain, rf"(?U)(?<!\w)({names})(?!\w)", 1), F.lit("")))
