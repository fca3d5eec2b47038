"""Survivorship of a group's texts, prices, times and sessions, on hand-made groups and against a plain version."""

import datetime as dt
import decimal
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import resolution as rs

DAY = dt.date(2026, 10, 27)
SCHEMA = (
    f"g string, candidate_id string, title string, city string, note string, price_amount decimal(18,4), currency string, start_date date, end_date date, start_time string, end_time string, starts_at timestamp, ends_at timestamp, timezone string, date_precision string, reliable boolean, schedule_kind string, recurrence_rule string, occurrences array<{rs.OCCURRENCE}>"
)


def sit(day=DAY, start=None, session=None, slot=None, stop=None, price=None, currency=None, seats=None, codes=()):
    return {"start_date": day, "end_date": stop, "start_time": start, "end_time": None, "starts_at": None, "ends_at": None, "timezone": "UTC", "date_precision": "day", "session_id": session, "timeslot_id": slot, "price_amount": None if price is None else decimal.Decimal(price), "currency": currency, "availability_text": None, "remaining_seats": seats, "enabled": None, "diagnostics": list(codes)}


def member(**x):
    row = dict.fromkeys([c.split()[0] for c in SCHEMA.replace("decimal(18,4)", "d").split(", ")])
    return row | {"title": "Blue Night", "timezone": "UTC", "date_precision": "unknown", "reliable": False, "schedule_kind": "unknown", "occurrences": []} | x


def price(amount, currency):
    return {"price_amount": None if amount is None else decimal.Decimal(amount), "currency": currency}


GROUPS = {
    "folded titles": [member(title="BLUE  night!"), member(title="blue night")], "other titles": [member(), member(title="Red Night")], "unknown cities": [member(), member(city="x"), member()], "two cities": [member(city="y"), member(city="x")],
    "notes": [member(note=None), member(note="second"), member(note="third")], "one price": [member(**price("5", "USD")), member(), member(**price("5", "USD"))], "free and paid": [member(**price("0", None)), member(**price("5", "USD"))], "currency alone": [member(**price("5", "USD")), member(**price(None, "USD"))],
    "covering time": [member(start_date=DAY), member(start_date=DAY, start_time="18:00", date_precision="exact")], "no covering time": [member(start_date=DAY, start_time="18:00"), member(start_date=DAY, end_time="20:00")], "other days": [member(start_date=DAY), member(start_date=DAY + dt.timedelta(1))],
    "a reliable one": [member(start_date=DAY + dt.timedelta(1)), member(start_date=DAY, reliable=True)], "more than reliable": [member(start_date=DAY, start_time="18:00"), member(start_date=DAY, reliable=True)], "no times": [member(), member(timezone="Asia/Tehran")],
    "kinds": [member(schedule_kind="single"), member(), member(schedule_kind="discrete")], "one kind": [member(schedule_kind="recurring", recurrence_rule="FREQ=DAILY"), member()], "copies of a session": [member(occurrences=[sit(start="18:00", session="s", price="5", currency="USD")]), member(occurrences=[sit(session="s", price="5", seats=3)])],
    "facts that disagree": [member(occurrences=[sit(start="18:00", session="s", seats=2)]), member(occurrences=[sit(start="18:00", session="s", seats=3)])], "times that disagree": [member(occurrences=[sit(start="18:00", session="s")]), member(occurrences=[sit(start="19:00", session="s")])],
    "a bare day of one": [member(occurrences=[sit()]), member(occurrences=[sit(start="18:00", session="s")])], "a bare day of two": [member(occurrences=[sit(), sit(start="18:00", session="s"), sit(start="20:00", session="t")])], "a range is no bare day": [member(occurrences=[sit(stop=DAY), sit(start="18:00")])],
    "several sittings": [member(start_date=DAY, start_time="18:00", schedule_kind="single", occurrences=[sit(start="18:00")]), member(occurrences=[sit(DAY + dt.timedelta(7), start="18:00")])],
}


@pytest.fixture(scope="module")
def got(spark):
    rows = [m | {"g": g, "candidate_id": f"{i:02}"} for g, ms in GROUPS.items() for i, m in enumerate(ms)]
    events, sittings = rs.resolved(spark.createDataFrame(rows, SCHEMA).repartition(3), "g", F.col("candidate_id"), ["title", "city"], ("title",), ("note",))
    found = {}
    for r in sittings.collect():
        found.setdefault(r.g, []).append(r)
    return {r.g: r for r in events.collect()}, found


def test_texts_and_prices(got):
    e, _ = got
    assert e["folded titles"].title == "BLUE  night!" and e["folded titles"].diagnostics == [] and e["other titles"].title is None
    assert e["other titles"].diagnostics == ["field_conflict:title", "missing_canonical_title:title"] and e["unknown cities"].city == "x" and e["two cities"].city is None and e["two cities"].diagnostics == ["field_conflict:city"]
    assert e["notes"].note == "second" and e["notes"].n_members == 3 and (e["one price"].price_amount, e["one price"].currency) == (5, "USD")
    for name in ("free and paid", "currency alone"):
        assert (e[name].price_amount, e[name].currency, e[name].diagnostics) == (None, None, ["field_conflict:price"])


def test_times(got):
    e, _ = got
    at = lambda g: (e[g].start_date, e[g].start_time, e[g].date_precision, e[g].diagnostics)
    assert at("covering time") == (DAY, "18:00", "exact", [])
    for name in ("no covering time", "other days"):
        assert at(name) == (None, None, "unknown", ["unresolved_temporal_interpretations:temporal"])
    assert at("a reliable one") == (DAY, None, "unknown", ["stronger_explicit_temporal_selected:temporal"]) and at("more than reliable") == (DAY, None, "unknown", ["partial_temporal_not_combined:temporal"])
    assert at("no times") == (None, None, "unknown", []) and e["no times"].timezone is None and e["covering time"].timezone == "UTC"
    assert [e[g].schedule_kind for g in ("kinds", "one kind", "no times")] == ["conflict", "recurring", "unknown"] and e["one kind"].recurrence_rule == "FREQ=DAILY"


def test_sittings(got):
    e, s = got
    one = s["copies of a session"][0]
    assert len(s["copies of a session"]) == 1 and (one.start_time, one.price_amount, one.currency, one.remaining_seats, one.candidate_ids, one.diagnostics) == ("18:00", 5, "USD", 3, ["00", "01"], [])
    assert (s["facts that disagree"][0].remaining_seats, s["facts that disagree"][0].diagnostics) == (None, ["occurrence_field_conflict:remaining_seats"])
    apart = sorted(s["times that disagree"], key=lambda r: r.start_time)
    assert [r.start_time for r in apart] == ["18:00", "19:00"] and all(r.diagnostics == ["occurrence_temporal_conflict"] for r in apart) and e["times that disagree"].schedule_kind == "conflict"
    assert [(r.session_id, r.candidate_ids) for r in s["a bare day of one"]] == [("s", ["00", "01"])] and len(s["a bare day of two"]) == 3 and len(s["a range is no bare day"]) == 2
    many = e["several sittings"]
    assert (many.n_occurrences, many.start_date, many.start_time, many.date_precision, many.schedule_kind, many.timezone) == (2, None, None, "unknown", "discrete", "UTC") and e["a bare day of one"].n_occurrences == 1


def test_times_against_all_pairs(spark):
    """The rule as it is stated: reliable ones agree in pairs, and one of them says all that the others say."""
    rng = random.Random(6)
    fields = ["start_date", "start_time", "end_time"]
    value = {"start_date": lambda: rng.choice([None, DAY, DAY, DAY + dt.timedelta(1)]), "start_time": lambda: rng.choice([None, None, "18:00"]), "end_time": lambda: rng.choice([None, None, None, "20:00"])}
    rows = [member(g=f"g{g}", candidate_id=f"{i:02}", reliable=rng.random() < 0.3, **{f: value[f]() for f in fields}) for g in range(150) for i in range(rng.randint(1, 4))]
    events, _ = rs.resolved(spark.createDataFrame(rows, SCHEMA).repartition(3), "g", F.col("candidate_id"), ["title"])
    found = {r.g: (r.start_date, r.start_time, r.end_time) for r in events.collect()}
    for g, ms in itertools.groupby(rows, key=lambda r: r["g"]):
        known = [m for m in ms if any(m[f] is not None for f in fields)]
        strong = [m for m in known if m["reliable"]] or known
        agree = all(a[f] is None or b[f] is None or a[f] == b[f] for a in strong for b in strong for f in fields)
        cover = [a for a in strong if all(b[f] is None or a[f] == b[f] for b in strong for f in fields)]
        want = tuple(cover[0][f] for f in fields) if agree and cover else (None, None, None)
        assert found[g] == want
