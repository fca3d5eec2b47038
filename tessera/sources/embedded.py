"""Sessions that a detail page embeds as data: a table of values that point to each other.

A page's script passes one JSON string to a stream; the string is an array whose
objects are ``{"_k": v}``, numbers of the array's entries that hold the key and
the value.  A page's table is decoded where the page's row is, within the bounds
below; each step along the few paths of interest looks up one entry, so nothing
else of a page is followed, a cycle never.  Sessions leave as rows, which Spark
judges.
What does not have the documented shape is refused with a code and no values.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessera.functions import temporal
from tessera.functions.temporal import bound
from tessera.operators.storage import settled
from tessera.sources import elements as el

# The envelope, its bounds, and the documented properties.
ENQUEUE = "window.__reactRouterContext.streamController.enqueue"
ROUTE = "routes/events.$id"
LONGEST, ENTRIES, SESSIONS, SLOTS, RECORDS, KEYS, NAME, DRIFT = 1_000_000, 20_000, 200, 50, 2_000, 200, 200, 20
NULL = -5
READ = ("id", "eventId", "startIso", "durationHours", "pricePerPerson", "unitPrice", "remainingSeats", "enabled")
SESSION = (*READ, "capacityLimit", "bookedCount", "inventoryMode", "layoutId", "timeslots", "hostDiscountPct", "platformDiscountPct", "soldOut")
SLOT = ("id", "sessionId", "startAt", "endAt", "enabled", "capacityLimit", "bookedCount", "remainingSeats", "pricePerPerson", "unitPrice", "hostDiscountPct", "platformDiscountPct")
SAFE = "^[A-Za-z][A-Za-z0-9_]{0,39}$"
IDENTITY = "^[A-Za-z0-9_-]{1,100}$"

ROWS = 1024  # sessions and timeslots that are sent at once
OUT = "page_id, locator, session_id, event_id, timeslot_id, start_iso, end_iso, duration_hours, price_per_person, unit_price, host_discount_pct, platform_discount_pct, remaining_seats, enabled, capacity_limit, booked_count, sold_out, schema_status".split(", ")


# ---- reading one page, in its own row


class _Number(str):
    """A number with a point or an exponent, as it is written."""


class _Object(list):
    """An object's pairs of key and value."""


def _object(pairs: list[tuple]) -> _Object:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key comes twice")
    return _Object(pairs)


def _constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_float=_Number, parse_constant=_constant)


def _decoded(text: str):  # noqa: ANN202
    """The value of a JSON text; None for what is none, and where a key comes twice."""
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None


def _typed(x) -> tuple[str, str | None]:  # noqa: ANN001
    """(type, text) of an entry; a string is read as far as its bound and one character more, a list or an object has no text."""
    if type(x) is str:
        return "STRING", x[: NAME + 1] if x.isascii() else x[: NAME + 1].encode("utf-8", "replace").decode()
    if type(x) is int:
        return ("BIGINT" if -(2**63) <= x < 2**63 else "DECIMAL" if abs(x) < 10**38 else "DOUBLE"), str(x)
    if isinstance(x, list):
        return ("OBJECT" if isinstance(x, _Object) else "ARRAY"), None
    if x is None:
        return "VOID", None
    if isinstance(x, bool):
        return "BOOLEAN", "true" if x else "false"
    digits = x.lstrip("-").replace(".", "", 1)
    if digits.isdigit() and len(digits) <= 38:
        return "DECIMAL", x.rstrip("0").rstrip(".")
    value = float(x)
    return "DOUBLE", repr(value) if 1e-3 <= abs(value) < 1e7 else "0.0" if value == 0 else f"{value:E}"


def _number_of(x, pattern: re.Pattern) -> int | None:  # noqa: ANN001
    """A pointer: digits, within a string or not."""
    if isinstance(x, (int, str)) and not isinstance(x, (bool, _Number)) and pattern.match(str(x)):
        return int(x)
    return None


_REF, _PLACE, _KEY, _SAFE = re.compile(r"-?[0-9]{1,15}\Z"), re.compile(r"[0-9]{1,9}\Z"), re.compile(r"_([0-9]{1,9})\Z"), re.compile(SAFE)
_CALL = re.compile(rf'(?sa){re.escape(ENQUEUE)}\(\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*\);?\Z')


class _Table:
    """A page's values that point to each other; only what is asked for is looked up."""

    def __init__(self, values: list):
        self.values = values
        self.names: dict[str, str | None] = {}  # what a key stands for

    def entry(self, at: int | None):  # noqa: ANN201
        return self.values[at] if at is not None and 0 <= at < len(self.values) else _NOWHERE

    def fields(self, at: int | None) -> dict[str, int] | None:
        """What the object that ``at`` points to maps to where; None for anything but a well-formed object."""
        pairs = self.entry(at)
        if not isinstance(pairs, _Object) or len(pairs) > KEYS:
            return None
        out: dict[str, int] = {}
        for key, value in pairs:
            if key not in self.names:
                place = _KEY.match(key)
                named = self.entry(int(place[1])) if place else None
                self.names[key] = named if type(named) is str and len(named) <= NAME else None
            name = self.names[key]
            ref = value if type(value) is int and abs(value) < 10**15 else _number_of(value, _REF)
            if name is None or ref is None or name in out:
                return None
            out[name] = ref
        return out

    def listed(self, at: int | None) -> list | None:
        items = self.entry(at)
        return items if isinstance(items, list) and not isinstance(items, _Object) else None

    def value(self, ref: int) -> tuple[str, str | None]:
        """A field's (type, text); VOID for null, REFERENCE for a pointer to nowhere."""
        if ref == NULL:
            return "VOID", None
        x = self.entry(ref)
        return ("REFERENCE", None) if x is _NOWHERE else _typed(x)

    def record(self, item, names: tuple[str, ...]) -> tuple[tuple, int | None]:  # noqa: ANN001
        """(known, n_fields, n_extra, unsafe, extra, a value for each name) of an object, and where its timeslots are: its named fields, and of others how many, whether a name is unsafe, and the first safe names."""
        pairs = self.fields(_number_of(item, _PLACE))
        if pairs is None:
            return (False, None, None, None, None, *(_ABSENT,) * len(names)), None
        places, values, others = _PLACES[names], [_ABSENT] * len(names), []
        for name, ref in pairs.items():
            at = places.get(name)
            if at is None:
                others.append(name)
            else:
                values[at] = self.value(ref)
        safe = [n for n in others if _SAFE.match(n)]
        return (True, len(pairs), len(others), len(safe) < len(others), sorted(safe)[:DRIFT], *values), pairs.get("timeslots")

    def session(self, item) -> tuple:  # noqa: ANN001
        own, at = self.record(item, SESSION)
        slots = self.listed(at)
        few = slots is not None and 1 <= len(slots) <= SLOTS
        return *own, None if slots is None else len(slots), [self.record(x, SLOT)[0] for x in slots] if few else None


_NOWHERE, _ABSENT = object(), (None, None)
_PLACES = {names: {n: i for i, n in enumerate(names)} for names in (SESSION, SLOT)}


def read(html: str | None) -> tuple[str | None, str | None, str | None, int | None, list[tuple]]:
    """(status, owner, listing, n, sessions) of a page: why nothing was read, whose page the data says it is, why no session was, how many there are, and these."""
    nothing = lambda status: (status, None, None, None, [])
    found = [x for x in el.scripts(html) if ENQUEUE in x] if html and ENQUEUE in html else []
    if len(found) != 1:
        return nothing("drift_payload_count" if found else "absent")
    if len(found[0]) > LONGEST:
        return nothing("drift_payload_size")
    call = _CALL.match(found[0])
    if not call:
        return nothing("drift_call_shape")
    text = _decoded(call[1])
    values = _decoded(text) if text is not None and len(text) <= LONGEST else None
    if not isinstance(values, list) or isinstance(values, _Object) or not 1 <= len(values) <= ENTRIES:
        return nothing("drift_table")
    table = _Table(values)
    route = table.fields((table.fields((table.fields(0) or {}).get("loaderData")) or {}).get(ROUTE))
    if route is None:
        return nothing("drift_route")
    event = table.fields(route.get("event")) or {}
    kind, owner = table.value(event["id"]) if "id" in event else _ABSENT
    refs = table.listed(route.get("sessions"))
    listing = "drift_sessions" if refs is None or len(refs) > SESSIONS else None if refs else "empty"
    return None, owner if kind == "STRING" and len(owner) <= NAME else None, listing, None if refs is None else len(refs), [] if listing else [table.session(x) for x in refs]


def _record(names: tuple[str, ...]) -> str:
    return f"known boolean, n_fields int, n_extra int, unsafe boolean, extra array<string>, vals struct<{', '.join(f'{n}: struct<type: string, text: string>' for n in names)}>"


RECORD = ["known", "n_fields", "n_extra", "unsafe", "extra", "vals"]
PAGE = "url string, status string, owner string, listing string, sessions int, nth int"
READ_AS = f"{PAGE}, {_record(SESSION)}, n_slots int, slots array<struct<{_record(SLOT)}>>"


def payloads(pages: DataFrame) -> DataFrame:
    """What ``read`` gives for each page, a row for each session; a page without any has one whose ``nth`` is null."""
    kind = pages.schema["page_id"].dataType.simpleString()
    page, records = StructType.fromDDL(PAGE), {names: [to_arrow_type(f.dataType) for f in StructType.fromDDL(_record(names))][:5] for names in (SESSION, SLOT)}

    def record(columns: list[tuple], names: tuple[str, ...]) -> list[pa.Array]:
        """The columns of records: what is told of a whole one, and of each field type and text."""
        own = [pa.array(c, t) for c, t in zip(columns, records[names], strict=False)]
        values = []
        for pairs in columns[5 : 5 + len(names)]:
            kinds, texts = pa.array([k for k, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.string())
            values.append(pa.StructArray.from_arrays([kinds, texts], ["type", "text"], mask=kinds.is_null()))
        return [*own, pa.StructArray.from_arrays(values, list(names))]

    def made(ids: pa.Array, places: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        of_page, rest = columns[: len(page)], columns[len(page) :]
        lists = rest[-1]
        slots = [x for xs in lists for x in xs or ()]
        ends = [0, *itertools.accumulate(len(xs or ()) for xs in lists)]
        inner = record(list(zip(*slots, strict=True)) or [()] * (5 + len(SLOT)), SLOT)
        items = pa.StructArray.from_arrays(inner, RECORD)
        arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(of_page, page, strict=True)] + record(rest, SESSION)
        offsets = pa.array([None if xs is None else at for xs, at in zip(lists, ends, strict=False)] + [ends[-1]], pa.int32())
        return pa.record_batch([ids.take(pa.array(places)), *arrays, pa.array(rest[-2], pa.int32()), pa.ListArray.from_arrays(offsets, items)], names=["page_id", *page.names, *RECORD, "n_slots", "slots"])

    none = (None,) * 5 + (_ABSENT,) * len(SESSION) + (None, None)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list[int] = []
            rows: list[tuple] = []
            size = 0
            for i in range(len(batch)):
                *own, sessions = read(batch.column(2)[i].as_py())
                url = batch.column(1)[i].as_py()
                new = [(url, *own, nth, *x) for nth, x in enumerate(sessions)] or [(url, *own, None, *none)]
                places += [i] * len(new)
                rows += new
                size += len(new) + sum(len(x[-1] or ()) for x in sessions)
                if size >= ROWS:
                    yield made(batch.column(0), places, rows)
                    places, rows, size = [], [], 0
            if rows:
                yield made(batch.column(0), places, rows)

    return pages.select("page_id", "url", "html").mapInArrow(told, f"page_id {kind}, {READ_AS}")


# ---- judging sessions


def apart(value: Column) -> Column:
    """A value of many parts, as a function of its own: inlined in a stage's code it makes a method that is too long to be compiled."""
    return bound(F.lit(0), lambda _: value)


def _kind(name: str) -> Column:
    return F.col("vals")[name]["type"]


def _text(name: str) -> Column:
    return F.col("vals")[name]["text"]


def _void(name: str) -> Column:
    return F.coalesce(_kind(name) == "VOID", F.lit(True))


def _number(name: str, least: float = 0, most: float = 1e15, above: bool = False) -> Column:
    """Is a field absent, null, or a number within bounds that plain digits write?"""
    x = _text(name).try_cast("decimal(38,6)")
    within = (x > least if above else x >= least) & (x <= most)
    return _void(name) | F.coalesce(_kind(name).isin("BIGINT", "DECIMAL", "DOUBLE") & _text(name).rlike(r"^[0-9]{1,15}(?:\.[0-9]{1,6})?$") & within, F.lit(False))


def _whole(name: str) -> Column:
    return _void(name) | F.coalesce((_kind(name) == "BIGINT") & _text(name).try_cast("long").between(0, 1_000_000), F.lit(False))


def _flag(name: str) -> Column:
    return _void(name) | (_kind(name) == "BOOLEAN")


def _string(name: str) -> Column:
    return F.coalesce((_kind(name) == "STRING") & (F.char_length(_text(name)) <= NAME), F.lit(False))


def _all(conditions) -> Column:  # noqa: ANN001
    return functools.reduce(Column.__and__, conditions)


def _scalars(names: tuple[str, ...]) -> Column:
    """None of the fields points to a list, an object or nowhere, or to a string that is too long."""
    return _all([F.coalesce(~_kind(n).isin("ARRAY", "OBJECT", "REFERENCE"), F.lit(True)) & F.coalesce((_kind(n) != "STRING") | (F.char_length(_text(n)) <= NAME), F.lit(True)) for n in names])


def _value(name: str, kind: str = "string") -> Column:
    return F.when(~_void(name), _text(name)).cast(kind)


def extract(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, pages) of detail pages (page_id, url, html).

    Sessions are rows of ``OUT``: a session as documented, or each of its
    timeslots.  Pages have (page_id, present, diagnostics, drift_keys): codes of
    what was refused and the names, never the values, of unexpected properties.
    Copies of a record are one; records that contradict each other under one id
    are none, nor do contradicting counts of seats stay.
    """
    event = F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/?#]*/events/([A-Za-z0-9_-]{1,100})/?(?:[?#].*)?$", 1), F.lit(""))
    stage = (
        F.when(F.col("event_id").isNull(), "unsupported_path").when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("owner").isNull() | (F.col("owner") != F.col("event_id")), "drift_event_identity").otherwise(F.col("listing"))
    )
    rows = payloads(pages).withColumn("event_id", event).withColumn("stage", stage).drop("url", "status", "owner", "listing")
    rows = settled(_sessions(rows))
    s = rows.where("stage is null")
    return _kept(s, settled(_timeslots(s)), rows.where("coalesce(nth, 0) = 0").select("page_id", "event_id", "stage"))


def _sessions(rows: DataFrame) -> DataFrame:
    """Each session with why it is refused, if it is."""
    unsafe = F.col("unsafe") | (F.col("n_extra") > DRIFT)
    alone = (F.col("n_extra") > 0) | (F.col("n_slots") > 0)  # only a session as documented, without timeslots, has facts of its own
    why = (
        F.when(~F.col("known"), "field").when(unsafe, "new_properties").when(~_all([F.col("vals")[n].isNotNull() for n in READ[:3]]) | ~_scalars(READ), "field")
        .when(F.coalesce(_text("eventId") != F.col("event_id"), F.lit(True)) | (_kind("eventId") != "STRING"), "field").when(~_flag("soldOut"), "sold_out_type")
        .when(F.col("n_slots").isNull() | (F.col("n_slots") > SLOTS) | ((F.col("n_slots") > 0) & (F.col("n_extra") > 0)), "timeslots")
        .when(~(_number("hostDiscountPct", most=100) & _number("platformDiscountPct", most=100)), "field").when(~(_string("id") & _string("startIso")), "field")
        .when(~_text("id").rlike(IDENTITY) | temporal.iso_instant(_text("startIso")).isNull() | ~_number("durationHours", most=744, above=True), "field")
        .when(~alone & ~(_number("pricePerPerson") & _number("unitPrice") & _whole("remainingSeats") & _flag("enabled")), "field")
    )
    return rows.withColumn("why", apart(why))


def _timeslots(s: DataFrame) -> DataFrame:
    """Each timeslot of the sessions that are not refused, with its values, its parent's, and why it is refused."""
    parents = s.where("why is null and n_slots > 0").select("page_id", "nth", "event_id", _text("id").alias("parent"), _text("startIso").alias("parent_start"), _value("durationHours").alias("hours"), _value("soldOut", "boolean").alias("sold_out"), F.posexplode("slots").alias("slot", "r"))
    rows = parents.select("*", "r.known", "r.n_fields", "r.n_extra", "r.extra", "r.vals").drop("r")
    begin, end = temporal.iso_instant(_text("startAt")), temporal.iso_instant(_text("endAt"))
    why = (
        F.when(~F.col("known"), "timeslots").when(F.col("n_extra") > 0, "timeslot_new_properties").when(F.col("n_fields") < len(SLOT), "timeslot_missing_properties").when(~_scalars(SLOT), "field")
        .when(~_all([_string(n) for n in SLOT[:4]]), "timeslot_type").when(_text("sessionId") != F.col("parent"), "timeslot_ownership").when(F.coalesce(_kind("enabled") != "BOOLEAN", F.lit(True)), "timeslot_type")
        .when(begin.isNull() | end.isNull(), "timeslot_timestamp").when(end <= begin, "timeslot_order").when(~(_number("pricePerPerson") & _number("unitPrice")), "timeslot_type")
        .when(~(_number("hostDiscountPct", most=100) & _number("platformDiscountPct", most=100)), "timeslot_type").when(~_all([_whole(n) for n in ("capacityLimit", "bookedCount", "remainingSeats")]), "timeslot_type")
        .when(~_text("id").rlike(IDENTITY), "field")
    )
    opens = temporal.iso_instant(F.col("parent_start"))
    inside = (begin >= opens) & (end <= F.timestamp_micros(F.unix_micros(opens) + (F.col("hours").cast("decimal(20,6)") * 3_600_000_000).cast("long")))
    status = F.when(F.col("hours").isNull(), "timeslot_parent_window_unknown").when(~inside, "timeslot_outside_parent_window")
    return rows.withColumn("why", apart(why)).withColumn("window", F.when(F.col("why").isNull(), status))


def _kept(s: DataFrame, t: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    locator = F.concat(F.lit(f"react-router:loaderData/{ROUTE}/sessions/"), F.col("nth").cast("string"))
    extra = F.col("n_extra") > 0
    facts = lambda name, kind="string": F.when(~extra, _value(name, kind))
    whole = s.where("why is null and n_slots = 0").select(
        "page_id", "nth", F.lit(-1).alias("slot"), locator.alias("locator"), _text("id").alias("session_id"), "event_id", none.alias("timeslot_id"), _text("startIso").alias("start_iso"), none.alias("end_iso"),
        _value("durationHours").alias("duration_hours"), facts("pricePerPerson").alias("price_per_person"), facts("unitPrice").alias("unit_price"), facts("hostDiscountPct").alias("host_discount_pct"),
        facts("platformDiscountPct").alias("platform_discount_pct"), facts("remainingSeats", "long").alias("remaining_seats"), facts("enabled", "boolean").alias("enabled"), F.lit(None).cast("long").alias("capacity_limit"),
        F.lit(None).cast("long").alias("booked_count"), facts("soldOut", "boolean").alias("sold_out"), F.when(extra, "unverified_properties").alias("schema_status"),
    )
    seats = ("capacityLimit", "bookedCount", "remainingSeats")
    false = _all([~_void(n) for n in seats]) & (_text(seats[0]).cast("long") - _text(seats[1]).cast("long") != _text(seats[2]).cast("long"))
    count = lambda name: F.when(~F.coalesce(false, F.lit(False)), _value(name, "long"))
    children = t.where("why is null").select(
        "page_id", "nth", "slot", F.concat(locator, F.lit("/timeslots/"), F.col("slot").cast("string")).alias("locator"), F.col("parent").alias("session_id"), "event_id", _text("id").alias("timeslot_id"), _text("startAt").alias("start_iso"),
        _text("endAt").alias("end_iso"), none.alias("duration_hours"), _value("pricePerPerson").alias("price_per_person"), _value("unitPrice").alias("unit_price"), _value("hostDiscountPct").alias("host_discount_pct"),
        _value("platformDiscountPct").alias("platform_discount_pct"), count("remainingSeats").alias("remaining_seats"), _value("enabled", "boolean").alias("enabled"), count("capacityLimit").alias("capacity_limit"), count("bookedCount").alias("booked_count"),
        "sold_out", F.col("window").alias("schema_status"),
    )
    rows = whole.union(children).repartition("page_id")
    one = Window.partitionBy("page_id", F.when(F.col("timeslot_id").isNull(), F.concat(F.lit("s:"), "session_id")).otherwise(F.concat(F.lit("t:"), "timeslot_id")))
    same = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in OUT if c not in ("page_id", "locator")))
    session = Window.partitionBy("page_id", "session_id")
    rows = rows.withColumn("_h", same).withColumn("_copy", F.row_number().over(one.orderBy("nth", "slot")) > 1).withColumn("_other", F.min("_h").over(one) != F.max("_h").over(one))
    rows = rows.withColumn("_both", F.min(F.col("timeslot_id").isNull()).over(session) != F.max(F.col("timeslot_id").isNull()).over(session))
    timed = F.col("timeslot_id").isNotNull()
    rows = settled(rows)
    dropped = F.col("_copy") | F.col("_other") | (F.col("_both") & timed)
    discount = lambda c: F.coalesce(F.col(c).cast("decimal(20,6)") != 0, F.lit(False))
    said = F.array(
        F.when(timed, "embedded_session_timeslots"), F.when(timed & F.col("schema_status").isNotNull(), F.concat(F.lit("embedded_"), "schema_status")), F.when(F.col("schema_status") == "unverified_properties", "embedded_session_unverified_shape"),
        F.when(timed & F.col("_copy"), "embedded_timeslot_duplicate_id"), F.when(timed & F.col("_other"), "embedded_timeslot_identity_conflict"), F.when((~timed & F.col("_other")) | F.col("_both"), "embedded_session_identity_conflict"),
        F.when(~dropped & (F.col("price_per_person").isNotNull() | F.col("unit_price").isNotNull()), "embedded_session_price_unit_unknown"), F.when(~dropped & (discount("host_discount_pct") | discount("platform_discount_pct")), "embedded_session_discount_unresolved"),
    )
    refused = lambda df: df.where("why is not null").select("page_id", F.explode(F.array(F.lit("embedded_session_schema_drift"), F.concat(F.lit("embedded_session_drift_"), "why"))).alias("code"))
    drifted = s.select("page_id", F.explode("extra").alias("key")).union(t.where("why = 'timeslot_new_properties'").select("page_id", F.explode("extra")))
    new = s.where("why is null and n_extra > 0").select("page_id", F.lit("embedded_session_drift_new_properties").alias("code"))
    uneven = t.where("why is null").where(false).select("page_id", F.lit("embedded_timeslot_availability_inconsistent").alias("code"))
    codes = rows.select("page_id", F.explode(said).alias("code")).where("code is not null").union(refused(s)).union(refused(t)).union(new).union(uneven)
    stages = state.where("stage is not null").select("page_id", F.explode(F.when(F.col("stage").startswith("drift_"), F.array(F.lit("embedded_sessions_schema_drift"), F.concat(F.lit("embedded_sessions_"), "stage"))).otherwise(F.array(F.concat(F.lit("embedded_sessions_"), "stage")))).alias("code"))
    kept = rows.where(~dropped)
    many = kept.groupBy("page_id").agg(F.count("*").alias("_n")).where(F.col("_n") > RECORDS).select("page_id")
    over = many.select("page_id", F.explode(F.array(F.lit("embedded_sessions_schema_drift"), F.lit("embedded_sessions_drift_session_list"))).alias("code"))
    said = codes.join(many, "page_id", "left_anti").union(stages).union(over).groupBy("page_id").agg(F.array_sort(F.collect_set("code")).alias("diagnostics"))
    names = drifted.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, DRIFT).alias("drift_keys"))
    empty = F.array().cast("array<string>")
    report = state.select("page_id", ~F.coalesce(F.col("stage").isin("absent", "unsupported_path"), F.lit(False))).toDF("page_id", "present").join(said, "page_id", "left").join(names, "page_id", "left")
    return kept.join(many, "page_id", "left_anti").select(*OUT), report.select("page_id", "present", F.coalesce("diagnostics", empty).alias("diagnostics"), F.coalesce("drift_keys", empty).alias("drift_keys"))
