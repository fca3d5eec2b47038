"""Dates, clocks, calendars and prices as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import DIGITS_FROM, DIGITS_TO, PERSIAN_DIGITS
from tessera.functions.text import fold as folded

# Month names, ordinal days, scales and currencies.
PERSIAN_MONTHS = ("فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند")
ENGLISH_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CURRENCIES = {
    "تومان": "TOMAN", "تومن": "TOMAN", "ریال": "IRR", "irr": "IRR", "usd": "USD", "us dollar": "USD", "us dollars": "USD", "دلار آمریکا": "USD",
    "eur": "EUR", "euro": "EUR", "euros": "EUR", "یورو": "EUR", "€": "EUR", "gbp": "GBP", "پوند انگلیس": "GBP", "£": "GBP",
}
SCALES = {"هزار": 1_000, "میلیون": 1_000_000, "thousand": 1_000, "million": 1_000_000}
FREE = ("رایگان", "بدون هزینه", "free", "free admission", "no fee")
PRICE_LABEL = r"^(?:هزینه(?:\s+ثبت نام)?|قیمت(?:\s+بلی[تط])?|ورودی|بلی[تط]|price|admission)\s*[:：]?\s*"
CLOCK_LABEL = r"^(?:زمان|تاریخ)\s*[:：]\s*"
CLOCK_EDGE = r"^[ ,،؛;.📅🗓⏰🕒]+|[ ,،؛;.📅🗓⏰🕒]+$"
DAY_PARTS = "صبح|بامداد|ظهر|بعد ?از ?ظهر|عصر|شب"
EPOCH = 2440588  # the Julian day of 1970-01-01


def div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def jalali_to_date(y: Column, m: Column, d: Column) -> Column:
    """The Gregorian date; null for a day that the calendar has not."""
    y, m, d = (c.cast("long") for c in (y, m, d))
    before = F.when(m <= 7, 31 * (m - 1)).otherwise(186 + 30 * (m - 7))
    day = F.date_add(F.lit("1970-01-01").cast("date"), (365 * (y - 1) + div(8 * y + 21, 33) + before + d + 1948319 - EPOCH).cast("int"))
    back = date_to_jalali(day)
    return F.when(m.between(1, 12) & d.between(1, 31) & (back["y"] == y) & (back["m"] == m) & (back["d"] == d), day)


def date_to_jalali(day: Column) -> dict[str, Column]:
    jdn = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") + EPOCH
    y = div(33 * (jdn - 1948320) + 3, 12053) + 1
    nth = jdn - (365 * (y - 1) + div(8 * y + 21, 33) + 1948319)  # from 1
    m = F.when(nth <= 186, div(nth - 1, 31) + 1).otherwise(div(nth - 187, 30) + 7)
    d = F.when(nth <= 186, (nth - 1) % 31 + 1).otherwise((nth - 187) % 30 + 1)
    return {"y": y, "m": m, "d": d}


def jalali_text(day: Column) -> Column:
    """``d Month yyyy`` in Persian."""
    j = date_to_jalali(day)
    persian = lambda c: F.translate(c.cast("string"), "0123456789", PERSIAN_DIGITS)
    return F.concat_ws(" ", persian(j["d"]), F.element_at(F.array(*map(F.lit, PERSIAN_MONTHS)), j["m"].cast("int")), persian(j["y"]))


def parse_iso(text: Column) -> Column:
    """The one ISO date of a text from 1700 on; null for none, several different or impossible ones."""
    found = F.array_distinct(F.regexp_extract_all(F.translate(text, DIGITS_FROM, DIGITS_TO), F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), 1))
    day = F.try_to_date(F.element_at(found, 1), "yyyy-MM-dd")
    return F.when((F.size(found) == 1) & (F.year(day) >= 1700), day)


def parse_english(text: Column) -> Column:
    """``d Month yyyy`` or ``Month d, yyyy`` to a date."""
    low = F.lower(text)
    months = "|".join(ENGLISH_MONTHS)
    first, second = rf"\b([0-9]{{1,2}}) ({months}) ([0-9]{{4}})\b", rf"\b({months}) ([0-9]{{1,2}}),? ([0-9]{{4}})\b"
    pick = lambda a, b: F.coalesce(F.nullif(F.regexp_extract(low, first, a), F.lit("")), F.nullif(F.regexp_extract(low, second, b), F.lit("")))
    month = F.array_position(F.array(*map(F.lit, ENGLISH_MONTHS)), pick(2, 1))
    return F.try_to_date(F.concat_ws("-", pick(3, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(pick(1, 2), 2, "0")), "yyyy-MM-dd")


def infer_year(month: Column, day: Column, reference: Column, near: int = 45) -> Column:
    """The one date among last, this and next year within ``near`` days of the reference."""
    years = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.try_to_date(F.concat_ws("-", (F.year(reference) + k).cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"))
    fits = F.filter(years, lambda x: F.abs(F.datediff(x, reference)) <= near)
    return F.when(F.size(fits) == 1, F.element_at(fits, 1))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` mentions it."""
    return F.get(F.transform(F.array(value), f), 0)


def _day_part(hour: Column, part: Column) -> Column:
    """The hour of 24 that a Persian part of the day makes of an hour; null where it is unsure."""
    late = F.when(hour == 12, 12).when(hour.between(1, 11), hour + 12)
    small = (
        F.when(part.isin("صبح", "بامداد"), F.when(hour.between(1, 11), hour)).when(part.isin("عصر", "بعدازظهر"), late)
        .when(part == "ظهر", F.when(hour.between(9, 12), hour).when(hour.between(1, 4), hour + 12)).when(part == "شب", F.when(hour.between(6, 11), hour + 12))
    )
    agrees = part.isin("عصر", "بعدازظهر", "شب") | ((part == "ظهر") & (hour <= 16))
    return F.when(hour > 12, F.when(agrees, hour)).otherwise(small)


def _seconds(h: Column, m: Column) -> Column:
    minute = F.coalesce(m, F.lit(0))
    return F.when(h.between(0, 23) & minute.between(0, 59), h * 3600 + minute * 60)


def _clock(seconds: Column, stop: Column, code: Column) -> Column:
    return F.struct(seconds.cast("int").alias("seconds"), stop.cast("int").alias("end_seconds"), code.cast("string").alias("code"))


def _half(g: Column) -> Column:
    """am and pm: groups hour, minute, letter."""
    hour = g[0].cast("int")
    at = F.when(hour.between(1, 12), _seconds(hour % 12 + F.when(g[2] == "p", 12).otherwise(0), g[1].cast("int")))
    return _clock(at, F.lit(None), F.when(at.isNull(), "invalid_time"))


def _named(g: Column) -> Column:
    """Parts of the day: groups hour, minute, part of the start, then of the end; a part after a range names its end."""
    part = lambda k: F.translate(g[k], " ", "")
    h1, h2 = g[0].cast("int"), g[3].cast("int")
    hours = F.struct(_day_part(h1, F.coalesce(part(2), part(5))).alias("a"), _day_part(h2, F.coalesce(part(5), F.when(h2.isNull(), part(2)))).alias("b"))

    def with_hours(x: Column) -> Column:
        begin = F.when(h2.isNotNull() & part(2).isNull() & (x["a"] >= x["b"]), h1).otherwise(x["a"])
        unsure = x["a"].isNull() | (h2.isNotNull() & x["b"].isNull())
        return bound(F.struct(_seconds(begin, g[1].cast("int")).alias("a"), _seconds(x["b"], g[4].cast("int")).alias("b"), unsure.alias("unsure")), with_seconds)

    def with_seconds(x: Column) -> Column:
        wrong = x["a"].isNull() | (h2.isNotNull() & x["b"].isNull())
        code = F.when(x["unsure"], "ambiguous_meridiem").when(wrong, "invalid_time").when(x["b"] <= x["a"], "ambiguous_overnight")
        good = ~x["unsure"] & ~wrong
        return _clock(F.when(good, x["a"]), F.when(good, x["b"]), code)

    return bound(hours, with_hours)


def _plain(g: Column) -> Column:
    """One clock or two: groups hour, minute of the start and of the end."""
    hour = lambda k: g[k].cast("int")
    bare = lambda k: F.coalesce(g[k + 1].isNull() & hour(k).between(1, 6), F.lit(False))

    def with_seconds(x: Column) -> Column:
        wrong = x["a"].isNull() | (g[2].isNotNull() & x["b"].isNull())
        late, vague = x["b"] <= x["a"], bare(0) | bare(2)
        code = F.when(wrong, "invalid_time").when(late, "ambiguous_overnight").when(vague, "ambiguous_meridiem")
        good = ~wrong & (F.coalesce(late, F.lit(False)) | ~vague)
        return _clock(F.when(good, x["a"]), F.when(good, x["b"]), code)

    return bound(F.struct(_seconds(hour(0), hour(1)).alias("a"), _seconds(hour(2), hour(3)).alias("b")), with_seconds)


def parse_clock(text: Column) -> Column:
    """(seconds, end_seconds, code) of a text that is one clock or one range of clocks, whole.

    hh:mm, "ساعت" and an hour, am and pm, and Persian parts of the day with fixed
    bounds.  A bare hour of 1 to 6 is ambiguous, an end that is not later than its
    start may be overnight and is marked, impossible clocks are invalid, and other
    wordings are not parsed.  An empty text is nothing.
    """
    clock = r"([0-9]{1,2})(?::([0-9]{2}))?"
    half = rf"^(?:ساعت\s*)?{clock}\s*([ap])\.?\s*m\.?$"
    named = rf"^(?:از\s+)?(?:ساعت\s*)?{clock}(?:\s*({DAY_PARTS}))?(?:\s*(?:تا|الی|–|-)\s*(?:ساعت\s*)?{clock}(?:\s*({DAY_PARTS}))?)?$"
    spanned = rf"^(?:از\s+)?(?:ساعت\s*)?{clock}\s*(?:تا|الی|to|–|-)\s*(?:ساعت\s*)?{clock}$"
    single = rf"^(?:ساعت\s*)?{clock}()()$"
    groups = lambda low, pattern, n: F.array(*(F.nullif(F.regexp_extract(low, pattern, k), F.lit("")) for k in range(1, n + 1)))
    none = F.lit(None)

    def read(low: Column) -> Column:
        marked = low.rlike(rf"(?:{DAY_PARTS})") & low.rlike(named)
        said = low.contains(":") | low.contains("ساعت")
        return (
            F.when(low == "", _clock(none, none, none)).when(low.rlike(half), bound(groups(low, half, 3), _half)).when(marked, bound(groups(low, named, 6), _named))
            .when(low.rlike(spanned), bound(groups(low, spanned, 4), _plain)).when(said & low.rlike(single), bound(groups(low, single, 4), _plain))
            .otherwise(_clock(none, none, F.lit("unparsed_temporal")))
        )

    return bound(F.trim(F.regexp_replace(F.regexp_replace(folded(text), CLOCK_EDGE, ""), CLOCK_LABEL, "")), read)


def local_instant(local: Column, zone: Column | str) -> Column:
    """The instant of a local time; null where clocks skip or repeat it.  ``local`` is a timestamp read as UTC, whose own clocks do neither."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    utc = F.to_utc_timestamp(local, zone)
    again = F.lit(False)
    for minutes in (-60, -30, 30, 60):
        moved = F.timestamp_add("MINUTE", F.lit(minutes), utc)
        again = again | (F.from_utc_timestamp(moved, zone) == local)
    return F.when(zone == "UTC", local).when((F.from_utc_timestamp(utc, zone) == local) & ~again, utc)


def saturday(day: Column) -> Column:
    """The first day of the week that begins on Saturday."""
    return F.date_sub(day, F.pmod(F.weekday(day) - 5, F.lit(7)).cast("int"))


def iso_instant(text: Column) -> Column:
    """A strict ISO instant with an offset, of 40 characters at most."""
    good = (F.char_length(text) <= 40) & text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(good, F.try_to_timestamp(text))


def price(text: Column) -> Column:
    """(amount, currency, code): free is 0 without currency; one amount with scale and currency by a full match; else ambiguous.

    Labels before a price and stops after it do not count.  Amounts have 18
    digits at most, and 12 of them after the point.
    """
    scales, names = "|".join(SCALES), "|".join(sorted(CURRENCIES, key=len, reverse=True))
    amount = rf"((?:[0-9]{{1,3}}(?:[,٬][0-9]{{3}})+|[0-9]+)(?:[.٫][0-9]+)?)\s*({scales})?"
    after, before = rf"^{amount}\s*({names})$", rf"^({names})\s*{amount}$"
    scale = F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv))
    currency = F.create_map(*(F.lit(x) for kv in CURRENCIES.items() for x in kv))
    empty = text.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) == "")
    result = lambda value, unit, code: F.struct(value.cast("decimal(38,12)").alias("amount"), unit.cast("string").alias("currency"), code.cast("string").alias("code"))
    none = F.lit(None)

    def counted(g: Column) -> Column:
        number = F.translate(F.regexp_replace(g[0], "[,٬]", ""), "٫", ".")
        digits = F.char_length(F.regexp_replace(F.translate(number, ".", ""), "^0+", ""))
        value = number.try_cast("decimal(30,12)") * F.coalesce(F.try_element_at(scale, g[1]), F.lit(1)).cast("decimal(7,0)")
        return F.when(digits <= 18, result(value, F.try_element_at(currency, g[2]), none)).otherwise(result(none, none, F.lit("ambiguous_price")))

    def read(low: Column) -> Column:
        groups = lambda pattern, order: F.array(*(F.regexp_extract(low, pattern, k) for k in order))
        return (
            F.when(low.isin(*FREE), result(F.lit(0), none, none)).when(low.rlike(after), bound(groups(after, (1, 2, 3)), counted))
            .when(low.rlike(before), bound(groups(before, (2, 3, 1)), counted)).otherwise(result(none, none, F.lit("ambiguous_price")))
        )

    low = F.regexp_replace(F.regexp_replace(folded(text), PRICE_LABEL, ""), r"^[ .؛;]+|[ .؛;]+$", "")
    return F.when(empty, result(none, none, F.lit("missing_price"))).when(F.char_length(text) > 4096, result(none, none, F.lit("price_too_long"))).otherwise(bound(low, read))


def status(has_values: Column, severities: Column) -> Column:
    return F.when(F.array_contains(severities, "error"), "invalid").when(~has_values, "unresolved").when(F.array_contains(severities, "review"), "partial").otherwise("normalized")
