"""Sessions embedded in pages: payloads made from plain objects, with every refusal."""

import json

import pytest

from tessera.sources import embedded

BASE = {"id": "s1", "eventId": "demo", "startIso": "2026-09-24T17:00:00.000Z", "durationHours": 2, "pricePerPerson": 150, "unitPrice": None, "remainingSeats": 4, "enabled": True, "timeslots": [], "capacityLimit": 9, "layoutId": "x"}
SLOT = {"id": "t1", "sessionId": "s1", "startAt": "2026-09-24T17:00:00Z", "endAt": "2026-09-24T18:00:00Z", "enabled": True, "capacityLimit": 9, "bookedCount": 5, "remainingSeats": 4, "pricePerPerson": None, "unitPrice": 3.5, "hostDiscountPct": None, "platformDiscountPct": None}


def encoded(value):
    """The table of a plain value: objects and lists hold the numbers of their parts."""
    table, seen = [], {}

    def put(x):
        if x is None:
            return -5
        if isinstance(x, str) and x in seen:
            return seen[x]
        at = len(table)
        table.append(None)
        if isinstance(x, str):
            seen[x] = at
        if isinstance(x, dict):
            table[at] = {f"_{put(k)}": put(v) for k, v in x.items()}
        else:
            table[at] = [put(v) for v in x] if isinstance(x, list) else x
        return at

    put(value)
    return table


def page(table, call=embedded.ENQUEUE):
    return f"<main>text</main><script>{call}({json.dumps(json.dumps(table))});</script>"


def route(*sessions, **more):
    return {"loaderData": {"root": {"viewer": None}, embedded.ROUTE: {"event": {"id": "demo", "price": 999}, "reviews": [{"text": "never read"}], "sessions": list(sessions), **more}}}


def session(**changes):
    return {k: v for k, v in (BASE | changes).items() if v != "drop"}


def slot(**changes):
    return {k: v for k, v in (SLOT | changes).items() if v != "drop"}


CASES = {
    "plain": route(session()), "empty": route(), "two": route(session(), session(id="s2", durationHours=None, pricePerPerson=None)),
    "copies": route(session(), session()), "contradiction": route(session(), session(remainingSeats=5)), "other event": route(session(eventId="another"), session(id="s2")),
    "new property": route(session(startLocal="x", mood="y")), "unsafe property": route(session(**{"a b": 1})), "sold out text": route(session(soldOut="no")), "sold out": route(session(soldOut=True)),
    "no timeslots": route(session(timeslots="drop")), "no start": route(session(startIso="drop")), "bad start": route(session(startIso="2026-09-24 17:00")), "negative price": route(session(unitPrice=-1)), "text price": route(session(unitPrice="5")),
    "discount": route(session(hostDiscountPct=10)), "large discount": route(session(hostDiscountPct=101)), "list as price": route(session(unitPrice=[1])), "no sessions": {"loaderData": {embedded.ROUTE: {"event": {"id": "demo"}}}},
    "other page": {"loaderData": {embedded.ROUTE: {"event": {"id": "x"}, "sessions": []}}}, "no route": {"loaderData": {"routes/other": {}}}, "many": route(*[session(id=f"s{i}") for i in range(201)]),
    "slots": route(session(timeslots=[slot(), slot(id="t2", startAt="2026-09-24T18:00:00Z", endAt="2026-09-24T19:30:00Z")])), "slot of another": route(session(timeslots=[slot(sessionId="s9"), slot(id="t2")])),
    "slot order": route(session(timeslots=[slot(endAt="2026-09-24T17:00:00Z")])), "slot time": route(session(timeslots=[slot(endAt="later")])), "slot property": route(session(timeslots=[slot(room="a")])), "slot lacks": route(session(timeslots=[slot(enabled="drop")])),
    "slot type": route(session(timeslots=[slot(remainingSeats="4")])), "slot seats": route(session(timeslots=[slot(remainingSeats=3)])), "slot twice": route(session(timeslots=[slot(), slot()])), "slot conflict": route(session(timeslots=[slot(), slot(unitPrice=4)])),
    "slot window": route(session(durationHours=None, timeslots=[slot()])), "slot and new property": route(session(mood=1, timeslots=[slot()])), "both": route(session(), session(timeslots=[slot()])), "no object": route("text", 5, None, session()),
}
D, S = "embedded_session_schema_drift", "embedded_session_drift_"
PRICE, SLOTS = "embedded_session_price_unit_unknown", "embedded_session_timeslots"
#: name -> (ids of sessions and timeslots, codes)
WANT = {
    "plain": ([("s1", None)], [PRICE]), "empty": ([], ["embedded_sessions_empty"]), "two": ([("s1", None), ("s2", None)], [PRICE]), "copies": ([("s1", None)], [PRICE]), "contradiction": ([], ["embedded_session_identity_conflict"]),
    "other event": ([("s2", None)], [D, S + "field", PRICE]), "new property": ([("s1", None)], [S + "new_properties", "embedded_session_unverified_shape"]), "unsafe property": ([], [D, S + "new_properties"]),
    "sold out text": ([], [D, S + "sold_out_type"]), "sold out": ([("s1", None)], [PRICE]), "no timeslots": ([], [D, S + "timeslots"]), **{k: ([], [D, S + "field"]) for k in ("no start", "bad start", "negative price", "text price", "large discount", "list as price")},
    "discount": ([("s1", None)], ["embedded_session_discount_unresolved", PRICE]), "no sessions": ([], ["embedded_sessions_schema_drift", "embedded_sessions_drift_sessions"]), "other page": ([], ["embedded_sessions_schema_drift", "embedded_sessions_drift_event_identity"]),
    "no route": ([], ["embedded_sessions_schema_drift", "embedded_sessions_drift_route"]), "many": ([], ["embedded_sessions_schema_drift", "embedded_sessions_drift_sessions"]), "slots": ([("s1", "t1"), ("s1", "t2")], [SLOTS, PRICE, "embedded_timeslot_outside_parent_window"]),
    "slot of another": ([("s1", "t2")], [D, S + "timeslot_ownership", SLOTS, PRICE]), "slot order": ([], [D, S + "timeslot_order"]), "slot time": ([], [D, S + "timeslot_timestamp"]), "slot property": ([], [D, S + "timeslot_new_properties"]),
    "slot lacks": ([], [D, S + "timeslot_missing_properties"]), "slot type": ([], [D, S + "timeslot_type"]), "slot seats": ([("s1", "t1")], [SLOTS, PRICE, "embedded_timeslot_availability_inconsistent"]), "slot twice": ([("s1", "t1")], [SLOTS, PRICE, "embedded_timeslot_duplicate_id"]),
    "slot conflict": ([], [SLOTS, "embedded_timeslot_duplicate_id", "embedded_timeslot_identity_conflict"]), "slot window": ([("s1", "t1")], [SLOTS, PRICE, "embedded_timeslot_parent_window_unknown"]), "slot and new property": ([], [D, S + "timeslots"]),
    "both": ([("s1", None)], ["embedded_session_identity_conflict", SLOTS, PRICE]), "no object": ([("s1", None)], [D, S + "field", PRICE]),
}

RAW = {
    "absent": ("<script>other()</script><script src='x'>" + embedded.ENQUEUE + "</script>", "embedded_sessions_absent"), "twice": (page([1]) + page([1]), "embedded_sessions_drift_payload_count"),
    "call": (f"<script>{embedded.ENQUEUE}(x)</script>", "embedded_sessions_drift_call_shape"), "trailing": (page([1]).replace(");<", "); more()<"), "embedded_sessions_drift_call_shape"), "no json": (f'<script>{embedded.ENQUEUE}("{{")</script>', "embedded_sessions_drift_table"),
    "no list": (page({"a": 1}), "embedded_sessions_drift_table"), "repeated key": (f'<script>{embedded.ENQUEUE}("[{{\\"_1\\":2,\\"_1\\":3}},\\"loaderData\\"]")</script>', "embedded_sessions_drift_table"), "long": (page(["x" * 1_000_001]), "embedded_sessions_drift_payload_size"),
    "entries": (page([1] * 20_001), "embedded_sessions_drift_table"), "cycle": (page([{"_1": 0}, "loaderData"]), "embedded_sessions_drift_route"), "nowhere": (page([{"_1": 77}, "loaderData"]), "embedded_sessions_drift_route"), "bad key": (page([{"x": 1}, "loaderData"]), "embedded_sessions_drift_route"),
    "null": (None, "embedded_sessions_absent"),
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [(name, "https://a.example/events/demo/?x=1", page(encoded(value))) for name, value in CASES.items()]
    rows += [(name, "https://a.example/events/demo", html) for name, (html, _) in RAW.items()] + [("path", "https://a.example/other/demo", page(encoded(CASES["plain"])))]
    sessions, pages = embedded.extract(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(4))
    found = {}
    for r in sessions.collect():
        found.setdefault(r.page_id, []).append(r)
    return found, {r.page_id: r for r in pages.collect()}


def test_sessions_and_codes(read):
    sessions, pages = read
    for name, (ids, codes) in WANT.items():
        assert sorted(((r.session_id, r.timeslot_id) for r in sessions.get(name, [])), key=str) == ids, name
        assert pages[name].diagnostics == sorted(codes), name
        assert pages[name].present
    assert pages["new property"].drift_keys == ["mood", "startLocal"] and pages["slot property"].drift_keys == ["room"] and pages["plain"].drift_keys == []


def test_refused_envelopes(read):
    sessions, pages = read
    for name, (_, code) in RAW.items():
        assert name not in sessions and code in pages[name].diagnostics and pages[name].present == ("drift" in code), name
    assert pages["path"].diagnostics == ["embedded_sessions_unsupported_path"]


def test_facts(read):
    sessions, _ = read
    one = sessions["plain"][0]
    assert (one.locator, one.start_iso, one.duration_hours, one.price_per_person, one.unit_price, one.remaining_seats, one.enabled, one.capacity_limit, one.schema_status) == ("react-router:loaderData/routes/events.$id/sessions/0", BASE["startIso"], "2", "150", None, 4, True, None, None)
    child = {r.timeslot_id: r for r in sessions["slots"]}
    assert (child["t1"].end_iso, child["t1"].unit_price, child["t1"].capacity_limit, child["t1"].schema_status, child["t1"].locator[-12:]) == (SLOT["endAt"], "3.5", 9, None, "/timeslots/0")
    assert child["t2"].schema_status == "timeslot_outside_parent_window"
    new = sessions["new property"][0]
    assert (new.schema_status, new.duration_hours, new.price_per_person, new.remaining_seats, new.enabled) == ("unverified_properties", "2", None, None, None)
    assert sessions["sold out"][0].sold_out is True and (sessions["slot seats"][0].capacity_limit, sessions["slot seats"][0].remaining_seats) == (None, None)
    assert sessions["discount"][0].host_discount_pct == "10"


def test_no_pages(spark):
    sessions, pages = embedded.extract(spark.createDataFrame([], "page_id string, url string, html string"))
    assert sessions.collect() == [] and pages.collect() == [] and sessions.columns == embedded.OUT


def test_pages_are_read_without_a_shuffle(spark, monkeypatch):
    """A page's payload, table and sessions are found in its own row: no pointer meets an entry by a join."""
    saved = []
    monkeypatch.setattr(embedded, "settled", lambda df: saved.append(df) or df)
    embedded.extract(spark.createDataFrame([("plain", "https://a.example/events/demo", page(encoded(CASES["plain"])))], "page_id string, url string, html string"))
    plan = saved[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "sessions" in saved[0].columns


def test_a_table_is_decoded_once_and_numbers_are_told_as_written(spark):
    """Sessions leave the reader as rows: Spark neither parses the table again nor takes it apart entry by entry."""
    value = route(session(pricePerPerson=1.5, unitPrice=100.0, durationHours=2.25), session(id="s2", unitPrice=1e20), session(id="é" * 101), session(id="s4", remainingSeats=True))
    pages = spark.createDataFrame([("a", "https://a.example/events/demo", page(encoded(value))), ("b", "https://a.example/events/demo", page(encoded(value)).replace("100.0", "1e2"))], "page_id string, url string, html string")
    rows = embedded.payloads(pages)
    plan = rows._jdf.queryExecution().executedPlan().toString().lower()
    assert "variant" not in plan and "from_json" not in plan and "exchange" not in plan
    sessions, report = embedded.extract(pages)
    got = {(r.page_id, r.session_id): (r.duration_hours, r.price_per_person, r.unit_price) for r in sessions.collect()}
    assert got == {("a", "s1"): ("2.25", "1.5", "100"), ("b", "s1"): ("2.25", "1.5", "100.0")}
    assert {tuple(r.diagnostics) for r in report.collect()} == {tuple(sorted([D, S + "field", PRICE]))}
