"""Precision and kind of schedules, and their relevance at a fixed instant."""

from __future__ import annotations

import datetime
import functools
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.temporal import bound, local_instant

# Parts of diagnostic codes that leave a date or clock unsafe, shapes that hold a session back, fields that concern time, and the zone of the review.
UNSAFE = ("conflict", "unresolved", "weekday_mismatch", "invalid", "unparsed", "ambiguous", "schema_drift", "unreliable_temporal_ocr", "unverified_shape")
HELD = ("unverified_shape",)
BOOKING = ("price", "discount", "availability")
TEMPORAL_FIELDS = ("temporal", "source_date_text", "source_schedule_text", "occurrences", "source_sessions", "start_date", "end_date", "start_time", "end_time", "timezone")
REVIEW_ZONE = "Asia/Tehran"
REVIEW = "needs_schedule_review"


def precision(start: Column, stop: Column, clock: Column, inferred: Column) -> Column:
    """unknown, range, inferred, exact or day."""
    return F.when(start.isNull(), "unknown").when(stop.isNotNull(), "range").when(inferred, "inferred").when(clock.isNotNull(), "exact").otherwise("day")


def kind(start: Column, stop: Column, recurring: Column, days: Column) -> Column:
    """recurring, discrete, range, single or unknown."""
    return F.when(recurring, "recurring").when(days > 1, "discrete").when(start.isNull(), "unknown").when(stop.isNotNull(), "range").otherwise("single")


def horizon_after(reference: datetime.datetime, days: int) -> datetime.datetime:
    """The midnight, in the zone of the review, after the last day that counts."""
    if not 1 <= days <= 90:
        raise ValueError("days must be between 1 and 90")
    if reference.tzinfo is None:
        raise ValueError("the reference must be an instant")
    zone = zoneinfo.ZoneInfo(REVIEW_ZONE)
    last = reference.astimezone(zone).date() + datetime.timedelta(days=days + 1)
    return datetime.datetime.combine(last, datetime.time.min, tzinfo=zone)


def instant(at: datetime.datetime) -> Column:
    return F.lit(at.astimezone(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def _names(code: Column, words: tuple[str, ...]) -> Column:
    return functools.reduce(Column.__or__, (code.contains(w) for w in words))


def _has(codes: Column, words: tuple[str, ...]) -> Column:
    return F.exists(codes, lambda c: _names(c, words))


def _verdict(kind: str, reason: str) -> Column:
    return F.struct(F.lit(kind).alias("disposition"), F.lit(reason).alias("reason"))


def dated(value: Column, codes: Column, reference: Column, horizon: Column) -> Column:
    """(disposition, reason) of something with start_date, end_date, start_time, end_time, timezone, date_precision, starts_at and ends_at.

    A range counts to its last day's closing time, or the end of that day; a
    single day to its end, or the end of the day.  Dates that are missing, unsafe
    or reversed, unknown zones, clocks that the zone skips or repeats, and ends
    before starts go to review.  Clocks are hh:mm strings, instants timestamps of
    a session in UTC.
    """
    known = F.coalesce(value["timezone"].isin(*sorted(zoneinfo.available_timezones())), F.lit(False))
    zone = F.when(known, value["timezone"]).otherwise("UTC")
    last = F.coalesce(value["end_date"], value["start_date"])
    midnight = lambda day: local_instant(day.cast("timestamp"), zone)
    closing_at = local_instant(F.to_timestamp(F.concat_ws(" ", last.cast("string"), value["end_time"])), zone)
    times = F.struct(
        midnight(value["start_date"]).alias("begin"), midnight(F.date_add(last, 1)).alias("after"),
        F.when(value["end_time"].isNotNull(), closing_at).alias("close"), last.alias("last"),
    )

    def judged(t: Column) -> Column:
        ranged = value["end_date"].isNotNull()
        given = F.when(~ranged, value["ends_at"])
        closing = given.isNull() & value["end_time"].isNotNull()
        overnight = closing & F.coalesce(value["end_time"] <= value["start_time"], F.lit(False))
        end = F.coalesce(given, t["close"])
        return (
            F.when(t["last"] < value["start_date"], _verdict(REVIEW, "reversed_date_range"))
            .when(t["begin"].isNull() | t["after"].isNull(), _verdict(REVIEW, "ambiguous_date_boundary"))
            .when(overnight & ranged, _verdict(REVIEW, "unresolved_range_hours"))
            .when(overnight, _verdict(REVIEW, "unresolved_overnight_clock"))
            .when(closing & t["close"].isNull(), _verdict(REVIEW, "ambiguous_end_time"))
            .when(end <= reference, _verdict("expired", "supported_end_reached"))
            .when(end.isNull() & (t["after"] <= reference), _verdict("expired", "last_date_passed"))
            .when(F.coalesce(value["starts_at"], t["begin"]) >= horizon, _verdict("beyond_horizon", "starts_after_horizon"))
            .otherwise(_verdict("actionable", "ongoing_or_upcoming"))
        )

    unknown = value["start_date"].isNull() | F.coalesce(value["date_precision"] == "unknown", F.lit(False)) | _has(codes, UNSAFE)
    return F.when(unknown, _verdict(REVIEW, "unresolved_date_or_clock")).when(~known, _verdict(REVIEW, "unknown_timezone")).otherwise(bound(times, judged))


def relevance(event: Column, reference: datetime.datetime, days: int = 14) -> Column:
    """(disposition, reason, occurrence_ids, sessions) of an event at an instant: actionable, expired, beyond_horizon, needs_schedule_review or otherwise_excluded.

    ``event`` has the columns that ``dated`` reads and status, schedule_kind,
    recurrence_rule, diagnostics (code, field) and occurrences (occurrence_id,
    diagnostics as codes, and what ``dated`` reads).  One session in the window
    makes an event actionable, with the ids of those; without any, one session in
    doubt makes it reviewable, one after the horizon puts it beyond it, and else
    it has ended.  The window is of whole days in the zone of the review, up to
    the midnight after ``days`` more days.
    """
    now, horizon = instant(reference), instant(horizon_after(reference, days))
    none = F.array().cast("array<string>")
    diagnostics = F.coalesce(event["diagnostics"], F.array())
    timely = F.filter(diagnostics, lambda d: d["field"].isin(*TEMPORAL_FIELDS) | d["code"].contains("unreliable_temporal_ocr"))
    codes = F.transform(timely, lambda d: d["code"])
    occurrences = F.coalesce(event["occurrences"], F.array())
    empty = F.transform(F.array().cast("array<string>"), lambda x: F.struct(x.alias("occurrence_id"), x.alias("disposition"), x.alias("reason")))
    held = lambda c: _names(c, HELD)

    def session(o: Column) -> Column:
        own = F.filter(F.coalesce(o["diagnostics"], none), lambda c: ~_names(c, BOOKING))

        def shaped(v: Column) -> Column:
            why = F.when(F.exists(own, lambda c: held(c) & c.contains("timeslot")), "unverified_timeslot").otherwise("unverified_session_shape")
            doubt = (v["disposition"] != "expired") & F.exists(own, held)
            return F.struct(o["occurrence_id"].alias("occurrence_id"), F.when(doubt, REVIEW).otherwise(v["disposition"]).alias("disposition"), F.when(doubt, why).otherwise(v["reason"]).alias("reason"))

        return bound(dated(o, F.filter(own, lambda c: ~held(c)), now, horizon), shaped)

    def of(verdict: Column, ids: Column, sessions: Column) -> Column:
        return F.struct(verdict["disposition"].alias("disposition"), verdict["reason"].alias("reason"), ids.alias("occurrence_ids"), sessions.alias("sessions"))

    def with_sessions(sessions: Column) -> Column:
        any_of = lambda k: F.exists(sessions, lambda s: s["disposition"] == k)
        ids = F.transform(F.filter(sessions, lambda s: s["disposition"] == "actionable"), lambda s: s["occurrence_id"])
        ranges = F.forall(occurrences, lambda o: o["end_date"].isNotNull() & ~_has(F.coalesce(o["diagnostics"], none), UNSAFE))
        doubt = any_of(REVIEW) | (_has(F.filter(codes, lambda c: ~held(c)), UNSAFE) & ~ranges) | F.coalesce(event["schedule_kind"] == "recurring", F.lit(False))
        verdict = (
            F.when(F.size(ids) > 0, _verdict("actionable", "supported_occurrences_in_window")).when(doubt, _verdict(REVIEW, "unresolved_sessions"))
            .when(any_of("beyond_horizon"), _verdict("beyond_horizon", "remaining_sessions_after_horizon")).otherwise(_verdict("expired", "all_sessions_ended"))
        )
        return of(verdict, ids, sessions)

    def alone(v: Column) -> Column:
        stale = (v["disposition"] == "actionable") & F.coalesce(event["status"] == "expired", F.lit(False))
        return of(F.when(stale, _verdict(REVIEW, "expired_status_conflicts_with_schedule")).otherwise(v), none, empty)

    off = event["status"].isin("cancelled", "postponed")
    recurring = F.coalesce(event["schedule_kind"] == "recurring", F.lit(False)) | event["recurrence_rule"].isNotNull()
    return (
        F.when(off, of(F.struct(F.lit("otherwise_excluded").alias("disposition"), F.concat(F.lit("explicit_"), event["status"]).alias("reason")), none, empty))
        .when(event["schedule_kind"] == "conflict", of(_verdict(REVIEW, "conflicting_schedule"), none, empty))
        .when(F.size(occurrences) > 0, bound(F.transform(occurrences, session), with_sessions))
        .when(recurring, of(_verdict(REVIEW, "recurrence_without_verified_instances"), none, empty))
        .otherwise(bound(dated(event, codes, now, horizon), alone))
    )
