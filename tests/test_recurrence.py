"""Rules of recurring wording, their instances, and zone-safe sittings."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import reconciliation as rc
from tessera.operators import recurrence

DAY = dt.date(2026, 10, 27)  # a Tuesday
TEXTS = {
    "هر سه‌شنبه ساعت ۱۸:۳۰": ("FREQ=WEEKLY;BYDAY=TU", "18:30", None), "جمعه‌ها 10:00 تا 12:00": ("FREQ=WEEKLY;BYDAY=FR", "10:00", "12:00"), "هر روز ساعت ۹": ("FREQ=DAILY", "09:00", None), "every day 10:00-12:00": ("FREQ=DAILY", "10:00", "12:00"),
    "زمان: هر شنبه": ("FREQ=WEEKLY;BYDAY=SA", None, None), "هر ماه": (None, None, None), "ساعات بازدید 10:00": (None, None, None), "daily": ("FREQ=DAILY", None, None), "هر شنبه و یکشنبه": ("FREQ=WEEKLY;BYDAY=SA", None, None), "هر روزه": (False, None, None),
    "سه‌شنبه ۵ آبان": (False, None, None), "everything": (False, None, None), "": (False, None, None), None: (False, None, None),
}


def test_rules_of_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = rows.select("i", recurrence.recurring(F.col("t"), F.lit("UTC")).alias("r")).orderBy("i").collect()
    for text, row in zip(TEXTS, got, strict=True):
        rule, start, stop = TEXTS[text]
        if rule is False:
            assert row.r is None, text
        else:
            assert (row.r.recurrence_rule, row.r.start_time, row.r.end_time, row.r.schedule_kind, row.r.occurrences) == (rule, start, stop, "recurring", []), text
            assert row.r.diagnostics[-2:] == ["recurring_schedule", "missing_date"]


def test_instances_within_bounds(spark):
    cases = [("FREQ=DAILY", DAY, DAY, [0]), ("FREQ=DAILY", DAY, DAY + dt.timedelta(3), [0, 1, 2, 3]), ("FREQ=WEEKLY;BYDAY=TU", DAY, DAY + dt.timedelta(14), [0, 7, 14]), ("FREQ=WEEKLY;BYDAY=MO", DAY, DAY + dt.timedelta(14), [6, 13]), ("FREQ=WEEKLY;BYDAY=MO", DAY, DAY + dt.timedelta(5), []), ("FREQ=DAILY", DAY, DAY - dt.timedelta(1), []), ("FREQ=DAILY", DAY, DAY + dt.timedelta(9999), list(range(366))), ("FREQ=MONTHLY", DAY, DAY, None), (None, DAY, DAY, None)]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, r string, a date, b date")
    got = rows.select("i", recurrence.instances(F.col("r"), F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [None if r.d is None else [(d - DAY).days for d in r.d] for r in got] == [c[3] for c in cases]


def test_sittings_where_clocks_change(spark):
    days = [dt.date(2026, 10, 24), dt.date(2026, 10, 25), dt.date(2026, 3, 29)]
    rows = spark.createDataFrame([(days,)], "d array<date>")
    made = lambda a, b: rows.select(recurrence.sittings(F.col("d"), F.lit(a).cast("string"), F.lit(b).cast("string"), F.lit("Europe/Berlin")).alias("s")).first().s
    night = made("02:30", None)
    assert [o.starts_at for o in night] == [dt.datetime(2026, 10, 24, 0, 30), None, None] and [o.diagnostics for o in night] == [[], ["ambiguous_local_time"], ["ambiguous_local_time"]]
    assert [o.date_precision for o in night] == ["exact", "day", "day"] and night[1].start_time == "02:30"
    assert [o.ends_at for o in made("01:00", "02:30")][1] is None and all(o.starts_at is None and not o.diagnostics for o in made(None, None))


def test_sessions_verify_a_rule(spark):
    session = rc.sitting(occurrence_id=F.lit("x"), start_date=F.lit(DAY), start_time=F.lit("18:30"), timezone=F.lit("UTC"), session_id=F.lit("s1"))
    sessions = rc.reading(F.array(session), schedule_kind=F.lit("single"))
    rows = spark.createDataFrame([("هر سه‌شنبه ساعت ۱۸:۳۰",), ("هر جمعه ساعت ۱۸:۳۰",)], "t string")
    got = [r.r for r in rows.select(rc.reconciled(recurrence.recurring(F.col("t"), F.lit("UTC")), sessions).alias("r")).collect()]
    assert [(r.schedule_kind, r.recurrence_rule) for r in got] == [("recurring", "FREQ=WEEKLY;BYDAY=TU"), ("conflict", "FREQ=WEEKLY;BYDAY=FR")]
