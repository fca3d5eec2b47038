"""One schedule from several readings of it: visible dates, schedule wording, and sessions of a source.

A reading is a struct of its sittings (``occurrences``), what it says as a whole,
and codes.  A reading replaces another only if it says everything the other says:
null in a sitting stands for anything, and a sitting covers another if it agrees
wherever the other is not null.  Readings that disagree are kept both, as a
conflict; no date is ever chosen between them.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import temporal
from tessera.functions.temporal import bound

FIELDS = ("start_date", "end_date", "start_time", "end_time", "timezone")
SITTING = (
    "struct<occurrence_id:string,start_date:date,end_date:date,start_time:string,end_time:string,timezone:string,starts_at:timestamp,ends_at:timestamp,"
    "date_precision:string,session_id:string,timeslot_id:string,diagnostics:array<string>>"
)
WHOLE = "start_date:date,end_date:date,start_time:string,end_time:string,timezone:string,starts_at:timestamp,ends_at:timestamp,date_precision:string"
READING = f"struct<occurrences:array<{SITTING}>,schedule_kind:string,recurrence_rule:string,{WHOLE},diagnostics:array<string>>"
#: Codes, and the sessions' properties whose meaning is known.
UNVERIFIED, CORROBORATED = "embedded_session_unverified_shape", "embedded_session_corroborated_by_page_text"
DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


def reading(occurrences: Column | None = None, **parts: Column) -> Column:
    """A reading from what is known of it; the rest is null, without sittings or codes."""
    none = F.lit(None)
    names = [x.partition(":")[0] for x in ("schedule_kind", "recurrence_rule", *WHOLE.split(","))]
    whole = [parts.get(n, F.lit({"schedule_kind": "unknown", "date_precision": "unknown"}.get(n)) if n in ("schedule_kind", "date_precision") else none).alias(n) for n in names]
    listed = F.coalesce(occurrences, F.array().cast(f"array<{SITTING}>")) if occurrences is not None else F.array()
    return F.struct(listed.alias("occurrences"), *whole, F.coalesce(parts["diagnostics"], F.array().cast("array<string>")).alias("diagnostics") if "diagnostics" in parts else F.array().alias("diagnostics")).cast(READING)


def sitting(**parts: Column) -> Column:
    """A sitting from what is known of it."""
    names = [x.partition(":")[0] for x in SITTING[7:-1].replace("array<string>", "list").split(",")]
    return F.struct(*(parts.get(n, F.array() if n == "diagnostics" else F.lit(None)).alias(n) for n in names)).cast(SITTING)


def _ends(a: Column, b: Column) -> Column:
    return a["end_date"].isNull() == b["end_date"].isNull()


def covers(a: Column, b: Column) -> Column:
    """Does a say all that b says?"""
    return _ends(a, b) & functools.reduce(Column.__and__, (b[f].isNull() | F.coalesce(a[f] == b[f], F.lit(False)) for f in FIELDS))


def compatible(a: Column, b: Column) -> Column:
    """Can both be said of one sitting?"""
    return _ends(a, b) & functools.reduce(Column.__and__, (a[f].isNull() | b[f].isNull() | (a[f] == b[f]) for f in FIELDS))


def _window(a: Column, b: Column) -> Column:
    """Is a day with hours the window that holds a timeslot?"""
    within = a["end_time"].isNull() | F.coalesce(b["end_time"] <= a["end_time"], F.lit(False))
    return F.coalesce(b["timeslot_id"].isNotNull() & a["end_date"].isNull() & (a["start_date"] == b["start_date"]) & (a["start_time"] <= b["start_time"]) & within, F.lit(False))


def _chosen(selected: Column, other: Column) -> Column:
    codes = lambda r: F.array_distinct(F.concat(r["diagnostics"], F.filter(other["diagnostics"], lambda d: d != "missing_date")))
    return bound(selected, lambda r: r.withField("diagnostics", codes(r)))  # a field at a time would compute the reading once for each


def _in_order(sittings: Column, tie: Callable[[Column], Column]) -> Column:
    """Sittings by day, clock (none last) and ``tie``; those alike in all keep their order."""
    keyed = F.transform(sittings, lambda o, i: F.struct(o["start_date"].alias("a"), o["start_time"].isNull().alias("b"), o["start_time"].alias("c"), tie(o).alias("d"), i.alias("i"), o.alias("o")))
    return F.transform(F.sort_array(keyed), lambda x: x["o"])


def _some(r: Column) -> Column:
    return F.size(r["occurrences"]) > 0


def _sessions(r: Column) -> Column:
    return _some(r) & F.forall(r["occurrences"], lambda o: o["session_id"].isNotNull())


def _recurs(r: Column) -> Column:
    return F.coalesce(r["schedule_kind"] == "recurring", F.lit(False))


def _all_covered(by: Column, of: Column) -> Column:
    return F.forall(of["occurrences"], lambda b: F.exists(by["occurrences"], lambda a: covers(a, b)))


def overlaid(primary: Column, schedule: Column) -> Column:
    """Sessions with what the visible text adds to each, beside the text's other sittings; null unless every session fits one of the text's."""
    fits = lambda a, b: compatible(a, b) | _window(a, b)

    def filled(b: Column) -> Column:
        def with_match(found: Column) -> Column:
            a = F.get(found, 0)
            whole = b
            for f in ("end_date", "start_time", "end_time", "starts_at", "ends_at"):
                whole = whole.withField(f, F.coalesce(b[f], a[f]))
            same = F.array_contains(b["diagnostics"], UNVERIFIED) & F.coalesce(a["start_time"] == F.coalesce(b["start_time"], a["start_time"]), F.lit(False))
            codes = F.array_sort(F.array_union(F.filter(b["diagnostics"], lambda d: d != UNVERIFIED), F.array(F.lit(CORROBORATED))))
            return F.when(F.size(found) == 1, whole.withField("diagnostics", F.when(same, codes).otherwise(b["diagnostics"]))).otherwise(b)

        return bound(F.filter(primary["occurrences"], lambda a: compatible(a, b)), with_match)

    rest = F.filter(primary["occurrences"], lambda a: ~F.exists(schedule["occurrences"], lambda b: fits(a, b)))
    values = _in_order(F.concat(F.transform(schedule["occurrences"], filled), rest), lambda o: o["occurrence_id"])

    def whole(v: Column) -> Column:
        one, o = F.size(v) == 1, F.get(v, 0)
        day = o["ends_at"].isNull() | (F.to_date(F.from_utc_timestamp(o["ends_at"], F.coalesce(o["timezone"], F.lit("UTC")))) == o["start_date"])
        out = schedule.withField("occurrences", v).withField("schedule_kind", F.when(one, "single").otherwise("discrete"))
        parts = {"start_date": o["start_date"], "start_time": o["start_time"], "end_time": F.when(day, o["end_time"]), "starts_at": o["starts_at"], "ends_at": F.when(day, o["ends_at"]), "date_precision": o["date_precision"]}
        for name, value in parts.items():
            out = out.withField(name, F.when(one, value).otherwise(F.lit("unknown") if name == "date_precision" else None))
        return out.withField("end_date", F.when(one, schedule["end_date"]))

    fit = _sessions(schedule) & F.forall(schedule["occurrences"], lambda b: F.exists(primary["occurrences"], lambda a: fits(a, b)))
    return F.when(fit, _chosen(bound(values, whole), primary))


def follows(rule: Column, primary: Column, o: Column) -> Column:
    """Is a dated sitting an instance of a daily rule, or of a weekly one on a day, at the rule's hours?"""
    day = F.regexp_extract(rule, "^FREQ=WEEKLY;BYDAY=(MO|TU|WE|TH|FR|SA|SU)$", 1)
    right = (rule == "FREQ=DAILY") | ((day != "") & (F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(o["start_date"]) + 1) == day))
    hours = [primary[f].isNull() | F.coalesce(o[f] == primary[f], F.lit(False)) for f in ("start_time", "end_time")]
    return F.coalesce(right, F.lit(False)) & hours[0] & hours[1]


def _conflict(primary: Column, schedule: Column) -> Column:
    """Both readings, each sitting once and marked; nothing is said as a whole."""
    key = lambda o: F.to_json(F.struct(*(o[f] for f in (*FIELDS, "session_id", "timeslot_id"))))
    keyed = F.transform(
        F.concat(primary["occurrences"], schedule["occurrences"]),
        lambda o, i: F.struct(o["start_date"].alias("a"), o["start_time"].isNull().alias("b"), o["start_time"].alias("c"), key(o).alias("d"), i.alias("i"), o.alias("o")),
    )

    def lasting(v: Column) -> Column:
        """Of sittings in order, equal ones side by side, the last of each."""
        last = F.filter(v, lambda x, i: ~F.coalesce(x["d"] == F.get(v, i + 1)["d"], F.lit(False)))
        return F.transform(last, lambda x: x["o"].withField("diagnostics", F.array_sort(F.array_union(x["o"]["diagnostics"], F.array(F.lit("schedule_conflict"))))))

    marked = bound(F.sort_array(keyed), lasting)
    codes = F.array_distinct(F.concat(primary["diagnostics"], schedule["diagnostics"], F.array(F.lit("schedule_conflict"))))
    return reading(marked, schedule_kind=F.lit("conflict"), recurrence_rule=F.coalesce(schedule["recurrence_rule"], primary["recurrence_rule"]), timezone=F.coalesce(primary["timezone"], schedule["timezone"]), diagnostics=codes)


def reconciled(primary: Column, schedule: Column) -> Column:
    """The reading that covers the other, sessions over the visible dates, or both as a conflict."""
    return bound(F.struct(primary.alias("p"), schedule.alias("s")), lambda x: _reconciled(x["p"], x["s"]))


def _reconciled(p: Column, s: Column) -> Column:
    rule = p["recurrence_rule"]
    instances = _recurs(p) & ~_some(p) & _sessions(s) & F.forall(s["occurrences"], lambda o: follows(rule, p, o))
    same = F.coalesce(p["recurrence_rule"] == s["recurrence_rule"], F.lit(False)) & p["start_time"].eqNullSafe(s["start_time"]) & p["end_time"].eqNullSafe(s["end_time"])
    unresolved = bound(_chosen(p, s), lambda r: r.withField("diagnostics", F.concat(r["diagnostics"], F.array(F.lit("unresolved_schedule")))))
    both = ~(_recurs(p) & _recurs(s)) & _some(p) & _some(s)
    covered = F.when(_all_covered(s, p), _chosen(s, p)).when(_all_covered(p, s), _chosen(p, s)).otherwise(_conflict(p, s))
    return (
        F.when(instances, _chosen(s.withField("schedule_kind", F.lit("recurring")).withField("recurrence_rule", rule), p))
        .when(~_some(p) & ~_recurs(p) & (_some(s) | _recurs(s)), _chosen(s, p))
        .when(~_some(s) & ~_recurs(s), F.when(_some(p), unresolved).otherwise(_chosen(s, p)))
        .when(_recurs(p) & _recurs(s) & same, _chosen(s, p)).when(both, F.coalesce(overlaid(p, s), covered)).otherwise(_conflict(p, s))
    )


def of_sessions(sessions: Column, zone: Column, codes: Column | None = None) -> Column:
    """The reading of a source's own sessions: an array of structs as ``embedded.extract`` gives them.

    Each becomes a sitting in local time; it ends when it says, or its stated
    hours of elapsed time after its start.  What is not verified, or contradicts
    itself, is marked on the sitting and never makes its date.
    """
    local = lambda t: F.from_utc_timestamp(t, zone)
    clock = lambda t: F.date_format(t, "HH:mm")

    def one(x: Column) -> Column:
        hours = lambda start: F.timestamp_micros(F.unix_micros(start) + (x["duration_hours"].cast("decimal(20,6)") * 3_600_000_000).cast("long"))
        spans = bound(temporal.iso_instant(x["start_iso"]), lambda start: F.struct(start.alias("start"), F.coalesce(temporal.iso_instant(x["end_iso"]), hours(start)).alias("end")))
        slot = x["timeslot_id"].isNotNull()
        marks = F.filter(F.array(
            F.when(slot & (x["schema_status"] == "timeslot_outside_parent_window"), "embedded_timeslot_parent_window_conflict").when(slot & x["schema_status"].isNotNull(), "embedded_timeslot_unverified_shape").when(x["schema_status"].isNotNull(), UNVERIFIED),
            F.when(x["sold_out"] & (x["remaining_seats"] > 0), "embedded_session_sold_out_availability_conflict").when(x["sold_out"], "embedded_session_sold_out_unverified"),
            F.when(x["price_per_person"].cast("decimal(20,6)") != x["unit_price"].cast("decimal(20,6)"), "session_price_conflict"),
            F.when((x["host_discount_pct"].cast("decimal(20,6)") != 0) | (x["platform_discount_pct"].cast("decimal(20,6)") != 0), "embedded_session_discount_unresolved"),
        ), lambda c: c.isNotNull())
        return bound(bound(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), local(s["start"]).alias("a"), local(s["end"]).alias("b"))), lambda t: sitting(
            occurrence_id=F.concat(F.lit("session:"), F.sha2(F.concat_ws("\x1f", x["session_id"], F.coalesce(x["timeslot_id"], F.lit(""))), 256)), start_date=F.to_date(t["a"]), start_time=clock(t["a"]), end_time=clock(t["b"]),
            timezone=zone, starts_at=t["start"], ends_at=t["end"], date_precision=F.lit("exact"), session_id=x["session_id"], timeslot_id=x["timeslot_id"], diagnostics=marks,
        ))

    sorted_ = _in_order(F.transform(sessions, one), lambda o: o["occurrence_id"])

    def whole(v: Column) -> Column:
        single, o = F.size(v) == 1, F.get(v, 0)
        day = o["ends_at"].isNull() | (F.to_date(local(o["ends_at"])) == o["start_date"])
        said = F.array_distinct(F.concat(codes if codes is not None else F.array().cast("array<string>"), F.filter(F.flatten(F.transform(v, lambda y: y["diagnostics"])), lambda d: d.isin("session_price_conflict", "embedded_session_discount_unresolved"))))
        only = lambda c: F.when(single, c)
        return reading(
            v, schedule_kind=F.when(single, "single").otherwise("discrete"), timezone=zone, start_date=only(o["start_date"]), start_time=only(o["start_time"]), end_time=only(F.when(day, o["end_time"])),
            starts_at=only(o["starts_at"]), ends_at=only(F.when(day, o["ends_at"])), date_precision=F.when(single, "exact").otherwise("unknown"), diagnostics=said,
        )

    return bound(sorted_, whole)


def driven(primary: Column, schedule: Column | None = None, sessions: Column | None = None, session_codes: Column | None = None) -> Column:
    """An event's schedule: its visible dates, then its schedule wording, then its source's sessions, each reconciled with what came before.

    Readings that are null are skipped; where there are no sessions, the codes of
    why are kept.
    """
    result = primary
    for more in (schedule, sessions):
        if more is not None:
            absent = lambda r: r
            if more is sessions and session_codes is not None:
                absent = lambda r: F.when(r.isNotNull(), r.withField("diagnostics", F.concat(r["diagnostics"], F.coalesce(session_codes, F.array().cast("array<string>")))))
            result = bound(F.struct(result.alias("r"), more.alias("m")), lambda x: F.when(x["m"].isNull(), absent(x["r"])).when(x["r"].isNull(), x["m"]).otherwise(_reconciled(x["r"], x["m"])))  # noqa: B023
    return result


def covered(rows: DataFrame, by: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The rows of ``rows`` that a row of ``by`` with equal keys covers: null in a row's field stands for anything.

    One equi-join for each set of fields that can be null, on the others: rows
    are dealt by what they state, so no key's rows are compared in pairs.
    """
    parts = []
    for n in range(len(fields) + 1):
        for open_ in itertools.combinations(fields, n):
            stated = [f for f in fields if f not in open_]
            own = rows
            for f in fields:
                own = own.where(F.col(f).isNull() if f in open_ else F.col(f).isNotNull())
            parts.append(own.join(by.select(*keys, *stated).distinct(), [*keys, *stated], "left_semi").select(*rows.columns))
    return functools.reduce(DataFrame.union, parts)
