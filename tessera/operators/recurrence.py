"""Wording that recurs: its rule, what it says of hours, and its instances within bounds.

A rule is text, ``FREQ=DAILY`` or ``FREQ=WEEKLY;BYDAY=TU``.  Reading a text never
makes instances of it; ``instances`` does where a caller states both bounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import temporal
from tessera.functions import text as texts
from tessera.functions.temporal import bound
from tessera.operators import reconciliation as rc

# Days as they are written, and what makes wording recur.
WRITTEN = {
    "دوشنبه": "MO", "سه شنبه": "TU", "سهشنبه": "TU", "چهارشنبه": "WE", "پنجشنبه": "TH", "پنج شنبه": "TH", "جمعه": "FR", "شنبه": "SA", "یکشنبه": "SU", "یک شنبه": "SU",
}
_DAYS = "|".join(sorted(WRITTEN, key=len, reverse=True))
WEEKLY = rf"(?U)^(?:هر\s+({_DAYS})|({_DAYS})\s*ها)(?!\w)\s*"
DAILY = r"(?U)^(?:هر\s*(?:روز|شب)|روزانه|daily|every day)(?!\w)\s*"
RECURS = r"(?U)(?<!\w)(?:هر\s*(?:هفته|روز|شب|ماه|شنبه|یکشنبه|دوشنبه|سه شنبه|چهارشنبه|پنجشنبه|جمعه)|روزانه|هفتگی|ساعات بازدید|every|daily|weekly)(?!\w)"
LEAD = r"^[ 📅🗓⏰🕒]+|^[ 📅🗓⏰🕒]*(?:زمان|تاریخ)\s*[:：]\s*"
MOST = 366  # instances of a rule at most


def _low(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(texts.fold(text), r"^[ 📅🗓⏰🕒]+", ""), r"^(?:زمان|تاریخ)\s*[:：]\s*", "")


def recurs(text: Column) -> Column:
    return bound(_low(text), lambda low: low.rlike(RECURS) | low.rlike(WEEKLY))


def rule(text: Column) -> Column:
    """The rule that a text begins with; null where it has none, or one that is no rule (a month, a week)."""

    def read(low: Column) -> Column:
        day = F.coalesce(F.nullif(F.regexp_extract(low, WEEKLY, 1), F.lit("")), F.nullif(F.regexp_extract(low, WEEKLY, 2), F.lit("")))
        code = F.try_element_at(F.create_map(*(F.lit(x) for kv in WRITTEN.items() for x in kv)), day)
        return F.when(code.isNotNull(), F.concat(F.lit("FREQ=WEEKLY;BYDAY="), code)).when(low.rlike(DAILY), "FREQ=DAILY")

    return bound(_low(text), read)


def clock_text(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.concat_ws(":", F.lpad(F.floor(seconds / 3600).cast("string"), 2, "0"), F.lpad(F.floor(seconds % 3600 / 60).cast("string"), 2, "0")))


def recurring(text: Column, zone: Column) -> Column:
    """The reading of a text that recurs: its rule and hours, without any sitting; null for other texts.

    Whatever the hours are, it is no interval: it is marked, and has no date.
    """

    def read(low: Column) -> Column:
        rest = F.trim(F.regexp_replace(F.regexp_replace(low, WEEKLY, ""), DAILY, ""))

        def with_clock(c: Column) -> Column:
            codes = F.filter(F.array(c["code"], F.lit("recurring_schedule"), F.lit("missing_date")), lambda x: x.isNotNull())
            return rc.reading(None, schedule_kind=F.lit("recurring"), recurrence_rule=rule(text), start_time=clock_text(c["seconds"]), end_time=clock_text(c["end_seconds"]), timezone=zone, diagnostics=codes)

        return F.when(recurs(text), bound(temporal.parse_clock(rest), with_clock))

    return bound(_low(text), read)


def instances(rule_: Column, first: Column, last: Column) -> Column:
    """The days of a rule from ``first`` to ``last``, both included, 366 days at most; null for no rule or no bounds.

    A weekly rule steps from its first day on, so days are made, not filtered.
    """
    day = F.array_position(F.array(*map(F.lit, rc.DAYS)), F.regexp_extract(rule_, "^FREQ=WEEKLY;BYDAY=([A-Z]{2})$", 1)) - 1
    begin = F.date_add(first, F.pmod(day - F.weekday(first), F.lit(7)).cast("int"))
    end = F.least(last, F.date_add(first, MOST - 1))
    made = lambda a, step: F.when(a <= end, F.sequence(a, end, F.make_dt_interval(days=F.lit(step)))).otherwise(F.array().cast("array<date>"))
    return F.when(rule_ == "FREQ=DAILY", made(first, 1)).when(day >= 0, made(begin, 7))


def sittings(days: Column, start: Column, stop: Column, zone: Column) -> Column:
    """Dated sittings of one clock (HH:mm, or null) in a zone.

    An instant that clocks skip or repeat is not resolved: that sitting keeps its
    day and hours without an instant, marked ``ambiguous_local_time``.
    """
    local = lambda day, clock: F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock), F.lit("yyyy-MM-dd HH:mm"))

    def one(day: Column) -> Column:
        at = F.struct(F.when(start.isNotNull(), temporal.local_instant(local(day, start), zone)).alias("a"), F.when(stop.isNotNull(), temporal.local_instant(local(day, stop), zone)).alias("b"))

        def made(x: Column) -> Column:
            unsafe = (start.isNotNull() & x["a"].isNull()) | (stop.isNotNull() & x["b"].isNull())
            safe = lambda c: F.when(~unsafe, c)
            return rc.sitting(
                occurrence_id=day.cast("string"), start_date=day, start_time=start, end_time=stop, timezone=zone, starts_at=safe(x["a"]), ends_at=safe(x["b"]),
                date_precision=F.when(start.isNotNull() & ~unsafe, "exact").otherwise("day"), diagnostics=F.when(unsafe, F.array(F.lit("ambiguous_local_time"))).otherwise(F.array().cast("array<string>")),
            )

        return bound(at, made)

    return F.transform(days, one)
