"""Readings of a schedule reconciled, on hand-made cases; covering rows against a plain version."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import reconciliation as rc

DAY = dt.date(2026, 10, 27)


def sit(day=DAY, start=None, end=None, stop=None, session=None, slot=None, codes=(), zone="UTC"):
    return {"occurrence_id": f"{session or ''}{slot or ''}{day}{start}", "start_date": day, "end_date": stop, "start_time": start, "end_time": end, "timezone": zone, "starts_at": None, "ends_at": None, "date_precision": "day", "session_id": session, "timeslot_id": slot, "diagnostics": list(codes)}


def read(*sittings, kind=None, rule=None, start=None, end=None, codes=()):
    return {"occurrences": list(sittings), "schedule_kind": kind or ("single" if len(sittings) == 1 else "discrete" if sittings else "unknown"), "recurrence_rule": rule, "start_date": None, "end_date": None, "start_time": start, "end_time": end, "timezone": "UTC", "starts_at": None, "ends_at": None, "date_precision": "unknown", "diagnostics": list(codes)}


def after(n):
    return DAY + dt.timedelta(days=n)


WEEKLY = "FREQ=WEEKLY;BYDAY=TU"  # DAY is a Tuesday
A, B = sit(start="18:00"), sit(after(7), "18:00")
S1, S2 = sit(start="18:00", end="20:00", session="s1"), sit(after(7), "18:00", "20:00", session="s2")
#: name -> (first, second, kind, (day, start, end, id of session) of each sitting, codes)
CASES = {
    "the second covers": (read(sit()), read(A), "single", [(DAY, "18:00", None, None)], []),
    "the first covers": (read(A, B), read(sit(), sit(after(7))), "discrete", [(DAY, "18:00", None, None), (after(7), "18:00", None, None)], []),
    "conflict": (read(sit(start="18:00"), codes=["a"]), read(sit(start="19:00"), codes=["b"]), "conflict", [(DAY, "18:00", None, None), (DAY, "19:00", None, None)], ["a", "b", "schedule_conflict"]),
    "a range is no day": (read(sit()), read(sit(stop=after(2))), "conflict", [(DAY, None, None, None), (DAY, None, None, None)], ["schedule_conflict"]),
    "equal ones of a conflict once": (read(A, B), read(A, sit(after(1))), "conflict", [(DAY, "18:00", None, None), (after(1), None, None, None), (after(7), "18:00", None, None)], ["schedule_conflict"]),
    "nothing first": (read(codes=["missing_date", "x"]), read(A), "single", [(DAY, "18:00", None, None)], ["x"]),
    "nothing second": (read(A), read(codes=["y", "missing_date"]), "single", [(DAY, "18:00", None, None)], ["y", "unresolved_schedule"]),
    "nothing at all": (read(codes=["missing_date"]), read(codes=["missing_date"]), "unknown", [], ["missing_date"]),
    "sessions over a day": (read(sit(), codes=["z"]), read(S1), "single", [(DAY, "18:00", "20:00", "s1")], ["z"]),
    "sessions and another day": (read(sit(), sit(after(3))), read(S1), "discrete", [(DAY, "18:00", "20:00", "s1"), (after(3), None, None, None)], []),
    "text fills a session": (read(sit(start="18:00", end="21:00")), read(sit(start="18:00", session="s1")), "single", [(DAY, "18:00", "21:00", "s1")], []),
    "a session on no visible day": (read(sit()), read(S1, S2), "discrete", [(DAY, "18:00", "20:00", "s1"), (after(7), "18:00", "20:00", "s2")], []),
    "sessions at another hour": (read(A), read(sit(start="19:00", session="s1")), "conflict", [(DAY, "18:00", None, None), (DAY, "19:00", None, "s1")], ["schedule_conflict"]),
    "timeslots in a window": (read(sit(start="17:00", end="21:00")), read(sit(start="18:00", end="19:00", session="s1", slot="t1"), sit(start="19:00", end="20:00", session="s1", slot="t2")), "discrete", [(DAY, "18:00", "19:00", "s1"), (DAY, "19:00", "20:00", "s1")], []),
    "a timeslot out of the window": (read(sit(start="17:00", end="18:30")), read(sit(start="18:00", end="19:00", session="s1", slot="t1")), "conflict", [(DAY, "17:00", "18:30", None), (DAY, "18:00", "19:00", "s1")], ["schedule_conflict"]),
    "instances of a rule": (read(kind="recurring", rule=WEEKLY, start="18:00"), read(S1, S2), "recurring", [(DAY, "18:00", "20:00", "s1"), (after(7), "18:00", "20:00", "s2")], []),
    "no instances of a rule": (read(kind="recurring", rule=WEEKLY, start="17:00"), read(S1), "conflict", [(DAY, "18:00", "20:00", "s1")], ["schedule_conflict"]),
    "another day than the rule's": (read(kind="recurring", rule="FREQ=WEEKLY;BYDAY=WE"), read(S1), "conflict", [(DAY, "18:00", "20:00", "s1")], ["schedule_conflict"]),
    "daily": (read(kind="recurring", rule="FREQ=DAILY"), read(S1), "recurring", [(DAY, "18:00", "20:00", "s1")], []),
    "one rule twice": (read(kind="recurring", rule=WEEKLY, start="18:00", codes=["a"]), read(kind="recurring", rule=WEEKLY, start="18:00"), "recurring", [], ["a"]),
    "two rules": (read(kind="recurring", rule=WEEKLY), read(kind="recurring", rule="FREQ=DAILY"), "conflict", [], ["schedule_conflict"]),
    "a rule after nothing": (read(), read(kind="recurring", rule=WEEKLY), "recurring", [], []),
}


@pytest.fixture(scope="module")
def got(spark):
    schema = f"name string, p {rc.READING}, s {rc.READING}"
    rows = spark.createDataFrame([(k, p, s) for k, (p, s, *_) in CASES.items()], schema)
    return {r.name: r.r for r in rows.select("name", rc.reconciled(F.col("p"), F.col("s")).alias("r")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_reconciled(got, name):
    _, _, kind, sittings, codes = CASES[name]
    r = got[name]
    assert (r.schedule_kind, r.diagnostics) == (kind, codes)
    assert [(o.start_date, o.start_time, o.end_time, o.session_id) for o in r.occurrences] == sittings
    if kind == "conflict":
        assert all("schedule_conflict" in o.diagnostics for o in r.occurrences) and r.start_date is None


def test_what_a_single_session_says_as_a_whole(spark, got):
    one = got["sessions over a day"]
    assert (one.start_date, one.start_time, one.end_time, one.date_precision) == (DAY, "18:00", "20:00", "day")
    many = got["sessions and another day"]
    assert (many.start_date, many.start_time, many.date_precision) == (None, None, "unknown")
    doubtful = sit(start="18:00", session="s1", codes=[rc.UNVERIFIED])
    rows = spark.createDataFrame([(read(A), read(doubtful)), (read(sit()), read(doubtful))], f"p {rc.READING}, s {rc.READING}")
    found = [r.r.occurrences[0].diagnostics for r in rows.select(rc.reconciled(F.col("p"), F.col("s")).alias("r")).collect()]
    assert found == [[rc.CORROBORATED], [rc.UNVERIFIED]]


SESSION = "array<struct<session_id:string,timeslot_id:string,start_iso:string,end_iso:string,duration_hours:string,price_per_person:string,unit_price:string,host_discount_pct:string,platform_discount_pct:string,remaining_seats:long,sold_out:boolean,schema_status:string>>"


def test_sessions_as_a_reading(spark):
    one = ("s1", None, "2026-10-24T16:30:00Z", None, "3", "5", "5.0", None, "0", 4, None, None)  # two hours ahead of UTC, clocks go back the next night
    late = ("s2", None, "2026-10-24T22:30:00Z", None, "3", "5", "6", None, None, None, True, None)
    slot = ("s3", "t1", "2026-10-26T08:00:00Z", "2026-10-26T09:00:00Z", None, None, None, "10", None, 2, True, "timeslot_outside_parent_window")
    rows = spark.createDataFrame([(1, [one]), (2, [slot, late, one]), (3, [])], f"i int, s {SESSION}")
    first, many, none = (r.r for r in rows.select("i", rc.of_sessions(F.col("s"), F.lit("Europe/Berlin"), F.array(F.lit("given"))).alias("r")).orderBy("i").collect())
    assert (first.schedule_kind, first.start_date, first.start_time, first.end_time, first.diagnostics) == ("single", dt.date(2026, 10, 24), "18:30", "21:30", ["given"])
    assert [(o.session_id, o.start_date, o.start_time, o.end_time) for o in many.occurrences] == [("s1", dt.date(2026, 10, 24), "18:30", "21:30"), ("s2", dt.date(2026, 10, 25), "00:30", "02:30"), ("s3", dt.date(2026, 10, 26), "09:00", "10:00")]
    assert [o.diagnostics for o in many.occurrences] == [[], ["embedded_session_sold_out_unverified", "session_price_conflict"], ["embedded_timeslot_parent_window_conflict", "embedded_session_sold_out_availability_conflict", "embedded_session_discount_unresolved"]]
    assert many.diagnostics == ["given", "session_price_conflict", "embedded_session_discount_unresolved"] and many.start_date is None and none.occurrences == [] and none.schedule_kind == "discrete"


def test_driver(spark):
    schema = f"i int, p {rc.READING}, w {rc.READING}, s {rc.READING}, c array<string>"
    rows = spark.createDataFrame([(1, read(sit()), read(A), read(S1), None), (2, read(sit()), None, None, ["embedded_sessions_absent"]), (3, None, read(A), None, None), (4, read(sit()), read(sit(after(1))), read(S1), None), (5, None, None, None, ["x"])], schema)
    got = {r.i: r.r for r in rows.select("i", rc.driven(F.col("p"), F.col("w"), F.col("s"), F.col("c")).alias("r")).collect()}
    assert [(o.start_time, o.session_id) for o in got[1].occurrences] == [("18:00", "s1")] and got[1].schedule_kind == "single"
    assert got[2].diagnostics == ["embedded_sessions_absent"] and got[3].occurrences[0].start_time == "18:00" and got[5] is None
    assert got[4].schedule_kind == "discrete" and [o.start_date for o in got[4].occurrences] == [DAY, after(1)] and "schedule_conflict" in got[4].diagnostics


def test_covered_rows(spark):
    rng = random.Random(4)
    value = lambda n: rng.choice([None, *range(n)])
    left = [(i, rng.randrange(5), value(2), value(2), value(2)) for i in range(120)]
    right = [(rng.randrange(5), value(2), value(2), value(2)) for _ in range(40)]
    want = {i for i, k, *a in left if any(k == q and all(x is None or x == y for x, y in zip(a, b, strict=True)) for q, *b in right)}
    rows = spark.createDataFrame(left, "i int, k int, a int, b int, c int")
    by = spark.createDataFrame(right, "k int, a int, b int, c int")
    got = [r.i for r in rc.covered(rows, by, ["k"], ["a", "b", "c"]).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < 120 and len(list(itertools.combinations("abc", 2))) == 3
