"""Functions and operators on small hand-made rows."""

import datetime
import itertools

from pyspark.sql import functions as F

from tessera.functions import keys, ordinals, temporal, text
from tessera.operators import entities, snapshots
from tessera.sources import jsonl, pages, sinks
from tessera.streaming import logs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_jalali_pairs(spark):
    for (y, m, d), day in {(1399, 12, 30): "2021-03-20", (1400, 1, 1): "2021-03-21", (1404, 1, 1): "2025-03-21", (1405, 1, 1): "2026-03-21"}.items():
        assert str(one(spark, temporal.jalali_to_date(F.lit(y), F.lit(m), F.lit(d)))[0]) == day
    assert one(spark, temporal.jalali_to_date(F.lit(1400), F.lit(12), F.lit(30)))[0] is None


def test_clocks_that_skip_or_repeat_are_unknown(spark):
    at = lambda s: one(spark, temporal.local_instant(F.lit(s).cast("timestamp"), "Europe/Berlin"))[0]
    assert at("2026-03-29 02:30:00") is None
    assert at("2026-10-25 02:30:00") is None
    assert at("2026-07-01 12:00:00") == datetime.datetime(2026, 7, 1, 10, 0)


def test_prices(spark):
    def price(line):
        got = temporal.price(F.lit(line))
        return tuple(one(spark, got["amount"].cast("double"), got["currency"], got["code"]))

    assert price("رایگان") == (0.0, None, None)
    assert price("۲۵۰ هزار تومان") == (250_000.0, "TOMAN", None)
    assert price("10 usd or 12 usd") == (None, None, "ambiguous_price")
    assert price("هزینه ثبت نام: ۱٬۲۰۰٬۰۰۰ ریال.") == (1_200_000.0, "IRR", None)
    assert price("Admission: £ 12.5") == (12.5, "GBP", None) and price("2 million US dollars") == (2_000_000.0, "USD", None)
    assert price("ورودی رایگان") == price("Free admission") == (0.0, None, None)
    assert price("$5") == price("5k usd") == price("500") == price("1" * 19 + " usd") == (None, None, "ambiguous_price")
    assert price("  ")[2] == price(None)[2] == "missing_price" and price("5 usd" + " " * 5000)[2] == "price_too_long"


def test_clocks(spark):
    def clock(line):
        got = temporal.parse_clock(F.lit(line))
        return tuple(one(spark, got["seconds"], got["end_seconds"], got["code"]))

    h = 3600
    assert clock("18:30") == (18.5 * h, None, None) and clock("ساعت ۱۸") == (18 * h, None, None)
    assert clock("5 p.m.") == (17 * h, None, None) and clock("12 am") == (0, None, None) and clock("13 pm")[2] == "invalid_time"
    assert clock("۵ عصر") == (17 * h, None, None) and clock("۸ شب") == (20 * h, None, None) and clock("۱۲ شب")[2] == "ambiguous_meridiem"
    assert clock("۱۰ تا ۲ ظهر") == (10 * h, 14 * h, None) and clock("از ۴ تا ۸ عصر") == (16 * h, 20 * h, None)
    assert clock("ساعت 17 تا 19:30") == (17 * h, 19.5 * h, None) and clock("22:00 - 02:00") == (22 * h, 2 * h, "ambiguous_overnight")
    assert clock("ساعت ۵")[2] == clock("ساعت 5 تا 9")[2] == "ambiguous_meridiem" and clock("ساعت 5:00") == (5 * h, None, None)
    assert clock("25:00")[2] == "invalid_time" and clock("10 people")[2] == clock("17")[2] == "unparsed_temporal"
    assert clock("") == clock(" . ") == (None, None, None) and clock("زمان: 9:15.") == (9.25 * h, None, None)


def test_title_relations_and_registration_keys(spark):
    def relation(a, b):
        ka, kb = text.text_key(F.lit(a)), text.text_key(F.lit(b))
        return one(spark, text.title_relation(ka, kb, text.distinctive(ka), text.distinctive(kb)))[0]

    assert relation("Workshop 3", "Workshop 3") == relation("کارگاه", "Clay") == "weak"
    assert relation("Clay Workshop!", "clay workshop") == "exact" and relation("The clay", "clay") == "partial"
    assert relation("Clay kiln 1", "Clay kiln 2") == "different" and relation("Clay 2nd kiln", "Clay kiln") == "partial"
    assert relation("one two three four five six seven", "seven one two three four five six") == "strong"

    def key(url):
        return one(spark, keys.registration_key(F.lit(url)))[0]

    assert key("HTTPS://Tix.example:443/a/?b=2&utm_source=x&a=1&a=1#t") == "https://tix.example:443/a/?b=2&a=1&a=1#t"
    assert key("https://tix.example/?id=1") is None and key("https://u@tix.example/a") is None and key("ftp://tix.example/a") is None and key("/a") is None
    assert key("http://tix.example/a") != key("https://tix.example/a") != key("https://tix.example/a/")


def test_text(spark):
    row = one(spark, text.normalize(F.lit("كارگاه ۱۲")), text.text_key(F.lit("Ｆｕｌｌ－Width")), ordinals.day(F.lit("Twenty-first")), text.detect_language(F.lit("12")))
    assert tuple(row) == ("کارگاه 12", "full width", 21, None)


def test_html(spark):
    html = "<nav>x</nav><p>One&amp; <b>two</b><br>three<script>bad()</script><div hidden>no</div>"
    got = pages.with_text(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == ["One& two\nthree", None, ""]


CONTEXT = "candidate_id string, title string, city string, venue_name string, address string, registration_url string, start_date date, start_time string, end_time string, timezone string, date_precision string, publisher_key string, source_id string, source_url string, content_url string, identity_slot string, diagnostics array<struct<code:string,field:string>>"


def contexts(spark):
    day = lambda n: datetime.date(2026, 10, n)
    name = "Clay pottery evening"
    row = lambda i, **x: ({"candidate_id": i, "title": name, "city": "Shiraz", "start_date": day(22), "start_time": "17:00", "timezone": "Asia/Tehran", "date_precision": "day", "publisher_key": "p1", "source_id": i, "source_url": f"https://{i}.example", "content_url": f"https://{i}.example/1", "identity_slot": "primary"} | x)
    place = {"venue_name": "Blue Hall", "address": "12 North Garden Street floor 2", "start_time": "17:00", "end_time": "19:00"}
    rows = [
        row("a"), row("b"), row("c", publisher_key="p2"), row("d", start_date=day(23)), row("e", title="Glass", start_date=None, city=None, publisher_key="p9"),
        row("f", start_date=day(24), diagnostics=[("inferred_year", "source_date_text")]), row("g", title="Clay glazing", publisher_key="p3"), row("h", title="2026 event", publisher_key="p4"),
        row("i", publisher_key="p5", **place), row("j", publisher_key="p6", **(place | {"address": "North Garden Street 12 floor two, back", "venue_name": "Hall Blue"})),
        row("k", title="Clay kiln", city=None, start_date=None, publisher_key="p7", registration_url="https://t.example/x?utm_source=a&id=1"), row("l", title="Clay wheel", city="Yazd", start_date=None, publisher_key="p8", registration_url="https://t.example/x?id=1"),
        row("m", publisher_key="p2", timezone="UTC"), row("n", start_time="18:00"), row("o", title=None, publisher_key="p10"),
    ]
    return spark.createDataFrame([{k.split()[0]: r.get(k.split()[0]) for k in CONTEXT.replace("array<struct<code:string,field:string>>", "x").split(", ")} for r in rows], CONTEXT)


def test_pairs_follow_the_rules_are_symmetric_and_blocks_lose_nothing(spark):
    c = entities.prepared(contexts(spark))
    rows = c.select(F.struct(*c.columns).alias("a"))
    both = rows.crossJoin(rows.withColumnRenamed("a", "b")).where("a.candidate_id <> b.candidate_id")
    every = {(r[0], r[1]): (r[2], tuple(r[3])) for r in entities.matched(both).select("a.candidate_id", "b.candidate_id", "kind", "reasons").collect()}
    assert all(every[x, y] == every[y, x] for x, y in every)
    assert every["a", "b"] == ("same_event", ("city_match", "distinctive_title_exact", "exact_date_match", "same_publisher", "start_time_match"))
    assert every["a", "c"] == ("possible", ("city_match", "distinctive_title_exact", "exact_date_match", "insufficient_occurrence_evidence", "start_time_match"))
    assert every["a", "d"] == ("distinct", ("city_match", "conflicting_exact_date", "distinctive_title_exact", "same_publisher", "start_time_match"))
    assert every["a", "f"] == ("possible", ("city_match", "distinctive_title_exact", "insufficient_occurrence_evidence", "same_publisher", "start_time_match", "uncertain_date_difference"))
    assert every["a", "g"] == ("possible", ("city_match", "exact_date_match", "insufficient_occurrence_evidence", "start_time_match", "title_similarity_only"))
    assert every["a", "h"][0] == "possible" and every["a", "o"][0] == "possible" and every["a", "e"][0] == "distinct"
    assert every["i", "j"] == ("possible", ("address_conflict", "city_match", "distinctive_title_exact", "end_time_match", "exact_date_match", "overlapping_schedule_address_variant", "start_time_match", "venue_name_conflict"))
    assert every["k", "l"] == ("possible", ("insufficient_occurrence_evidence", "registration_url_match", "start_time_match", "title_similarity_only"))
    assert every["a", "m"] == ("distinct", ("city_match", "distinctive_title_exact", "exact_date_match", "timezone_conflict"))
    assert every["a", "n"][0] == "distinct" and "conflicting_start_time" in every["a", "n"][1]
    assert every["e", "k"] == ("distinct", ("distinctive_title_conflict", "start_time_match"))
    sure = {(r[0], r[1]): r[2] for r in entities.decisions(contexts(spark), sure=True).collect()}
    assert {k for k, v in sure.items() if v == "same_event"} == {k for k, v in every.items() if v[0] == "same_event" and k[0] < k[1]}
    found = {(r[0], r[1]): r[2] for r in entities.decisions(contexts(spark)).collect()}
    assert {k for k, v in every.items() if v[0] in ("same_event", "possible") and k[0] < k[1]} <= set(found)
    assert all(every[k][0] == v for k, v in found.items())


def test_complete_link_matches_the_greedy_fold(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("x", "y"), ("d", "e")]
    ids = sorted(set(itertools.chain.from_iterable(edges)) | {"z"})
    groups = []
    for i in ids:
        for g in groups:
            if all((m, i) in edges for m in g):
                g.append(i)
                break
        else:
            groups.append([i])
    want = {i: g[0] for g in groups for i in g}
    decided = spark.createDataFrame([(a, b, "same_event") for a, b in edges], "candidate_id_a string, candidate_id_b string, kind string")
    got = entities.complete_link(spark.createDataFrame([(i,) for i in ids], "candidate_id string"), decided)
    assert {r[0]: r[1] for r in got.collect()} == want


def test_log_keeps_the_latest_valid_line(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"id":"a","raw_text":"1","captured_at":"2026-01-01T00:00:00Z","seq":1}\nnot json\n{"id":"a","raw_text":"2","captured_at":"2026-01-02T00:00:00Z","seq":2}\n')
    got = jsonl.latest_items(jsonl.read(spark, str(path))).collect()
    assert [(r["id"], r["raw_text"], str(r["first_seen"])) for r in got] == [("a", "2", "2026-01-01 00:00:00")]


def test_snapshots(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([("k", v)], "event_id string, payload string")
    path = str(tmp_path / "runs")
    assert snapshots.sync(rows("new"), path, "r2", "2026-01-02 00:00:00")
    assert snapshots.sync(rows("late"), path, "r1", "2026-01-01 00:00:00")
    assert not snapshots.sync(rows("again"), path, "r2", "2026-01-02 00:00:00")
    assert snapshots.latest(snapshots.history(spark, path), "event_id").first()["payload"] == "new"


def test_csv_is_guarded(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("=1+1", [1, 2]), (None, None)], "v string, a array<int>"), str(tmp_path / "out"))
    assert "'=1+1" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))


def test_streams_equal_their_batch_twins(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(source)
    folder = str(tmp_path / "events")
    events.repartitionByRange(3, "ts", "event_id").write.parquet(folder)
    for name, twin, mode in (("first_last", logs.first_last_seen, "complete"), ("tumbling", logs.tumbling, "complete")):
        stream = twin(logs.read(spark, folder, 10)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect()), key=repr) == sorted(map(tuple, twin(events).collect()), key=repr)


FOLDER = "/root/testdata/sf0.001"


def test_text_queries_cover_every_document(spark):
    import hashlib
    import unicodedata

    from tessera.plans.queries import QUERIES

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    folded = str.maketrans(text.DIGITS_FROM + text.FOLDED_FROM + "‌", text.DIGITS_TO + text.FOLDED_TO + " ")

    def key(t):
        t = "".join(c for c in unicodedata.normalize("NFKC", t).translate(folded) if unicodedata.category(c) != "Cf").lower()
        return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t).split())

    def display(t):
        t = "".join(c for c in unicodedata.normalize("NFC", t).translate(str.maketrans("يك", "یک")) if c == "‌" or unicodedata.category(c) != "Cf")
        return " ".join(t.split()).strip(' «»“”"،,.؛:')

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert any(r["lang"] != "en" for r in docs)
    for name, plain in (("t_text_key", key), ("t_display_text", display)):
        assert {tuple(r) for r in QUERIES[name](spark, FOLDER).collect()} == {(r["doc_id"], sha(plain(r["text"]))) for r in docs}
    odd = ["«ﬁne ①» Ⅷ Éa", "\"both ends'\"", "می‌روم ۱۲ كي", "plain"]
    for t in odd:
        assert tuple(one(spark, text.text_key(F.lit(t)), text.display_text(F.lit(t)))) == (key(t), display(t))


def test_date_queries_cover_every_order(spark):
    from zoneinfo import ZoneInfo

    from tessera.plans.queries import QUERIES

    orders = {r["o_orderkey"]: r["o_orderdate"] for r in spark.read.parquet(f"{FOLDER}/orders.parquet").collect()}
    zone = ZoneInfo("Asia/Tehran")

    def instant(t):
        early, late = (t - t.replace(tzinfo=zone, fold=k).utcoffset() for k in (0, 1))
        return early.strftime("%Y-%m-%d %H:%M") if early == late else None

    def year(k, t):
        reference = t.date() + datetime.timedelta(days=k % 80 - 40)
        fits = []
        for y in range(reference.year - 1, reference.year + 2):
            try:
                day = t.date().replace(year=y)
            except ValueError:
                continue
            fits += [day] if abs((day - reference).days) <= 45 else []
        return fits[0] if len(fits) == 1 else None

    small = "first second third fourth fifth sixth seventh eighth ninth".split()
    names = [*small, *"tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split(), *(f"twenty-{w}" for w in small), "thirtieth", "thirty-first"]
    got = {name: dict(map(tuple, QUERIES[name](spark, FOLDER).collect())) for name in ("n_local_instant", "n_infer_year", "n_ordinal_day")}
    assert got["n_local_instant"] == {k: instant(t) for k, t in orders.items()}
    assert got["n_infer_year"] == {k: year(k, t) for k, t in orders.items()}
    assert got["n_ordinal_day"] == {k: names[t.day - 1] for k, t in orders.items()}
    assert None in got["n_local_instant"].values()  # clocks change at midnight there


def test_pair_decisions_keep_conflicts(spark):
    from tessera.plans.queries import QUERIES

    got = QUERIES["e_pair_reasons"](spark, FOLDER).collect()
    size = {}
    for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect():
        size.setdefault(r["p_name"], []).append((r["p_partkey"], r["p_size"]))
    size = {f"{min(k for k, _ in x):09d}": min(s for _, s in x) for x in size.values()}
    assert len({(r["candidate_id_a"], r["candidate_id_b"]) for r in got}) == len(got)
    conflicts = 0
    for r in got:
        a, b = size[r["candidate_id_a"]], size[r["candidate_id_b"]]
        assert ("city_conflict" in r["reasons"], "conflicting_exact_date" in r["reasons"]) == (a % 2 != b % 2, a % 3 != b % 3)
        conflicts += a % 6 != b % 6
        assert a % 6 == b % 6 or r["kind"] != "same_event"
    assert conflicts
    assert {(r["candidate_id_a"], r["candidate_id_b"], r["kind"]) for r in got} == set(map(tuple, QUERIES["e_pair_decisions"](spark, FOLDER).collect()))


def test_quality_of_readings(spark):
    def verdict(line):
        got = text.quality(F.lit(line))
        return tuple(one(spark, got["verdict"], got["score"]))

    assert verdict("") == verdict(None) == ("empty", 0.0) and verdict("1 2 3 %%%")[0] == "mostly_symbols" and verdict("a b c dd")[0] == "fragmented"
    assert verdict("Open workshop on clay") == ("plausible", 1.0)
    assert verdict("کارگاه ae سفال fal و نقاشی xy برای کودکان شهر") == ("mixed_script_noise", 0.65)
    assert verdict("کارگاه سفال\n12 34\n--\nنقاشی برای کودکان و بزرگسالان شهر شیراز")[0] == "noisy_lines"


def test_relevance_at_an_instant(spark):
    from tessera.operators import schedules

    fields = "occurrence_id string, start_date date, end_date date, start_time string, end_time string, timezone string, date_precision string, starts_at timestamp, ends_at timestamp"
    sessions = ", ".join(f.replace(" ", ":", 1) for f in fields.split(", "))
    schema = f"{fields.partition(', ')[2]}, name string, status string, schedule_kind string, recurrence_rule string, diagnostics array<struct<code:string,field:string>>, occurrences array<struct<{sessions},diagnostics:array<string>>>"
    day = lambda m, d: datetime.date(2026, m, d)
    base = {"end_date": None, "start_time": None, "end_time": None, "timezone": "Asia/Tehran", "date_precision": "day", "starts_at": None, "ends_at": None, "status": "unknown", "schedule_kind": "single", "recurrence_rule": None, "diagnostics": None, "occurrences": None}
    sitting = lambda i, at, **x: {"occurrence_id": i, "start_date": at, "end_date": None, "start_time": None, "end_time": None, "timezone": "Asia/Tehran", "date_precision": "day", "starts_at": None, "ends_at": None, "diagnostics": None} | x
    review, shape = "needs_schedule_review", ["unverified_shape_timeslot"]
    cases = [
        ("yesterday", {"start_date": day(10, 21)}, "expired", "last_date_passed"),
        ("today", {"start_date": day(10, 22)}, "actionable", "ongoing_or_upcoming"),
        ("over", {"start_date": day(10, 22), "start_time": "10:00", "end_time": "12:00"}, "expired", "supported_end_reached"),
        ("tonight", {"start_date": day(10, 22), "start_time": "18:00", "end_time": "20:00"}, "actionable", "ongoing_or_upcoming"),
        ("closed", {"start_date": day(10, 20), "end_date": day(10, 22), "end_time": "14:00"}, "expired", "supported_end_reached"),
        ("ongoing", {"start_date": day(10, 20), "end_date": day(10, 25), "ends_at": datetime.datetime(2026, 10, 1)}, "actionable", "ongoing_or_upcoming"),
        ("last day", {"start_date": day(11, 5)}, "actionable", "ongoing_or_upcoming"),
        ("after", {"start_date": day(11, 6)}, "beyond_horizon", "starts_after_horizon"),
        ("before midnight there", {"start_date": day(11, 6), "starts_at": datetime.datetime(2026, 11, 5, 20, 29)}, "actionable", "ongoing_or_upcoming"),
        ("reversed", {"start_date": day(10, 25), "end_date": day(10, 23)}, review, "reversed_date_range"),
        ("undated", {"start_date": None}, review, "unresolved_date_or_clock"),
        ("doubt", {"start_date": day(10, 25), "diagnostics": [("conflicting_dates", "temporal")]}, review, "unresolved_date_or_clock"),
        ("price", {"start_date": day(10, 25), "diagnostics": [("ambiguous_price", "price_text")]}, "actionable", "ongoing_or_upcoming"),
        ("cancelled", {"start_date": day(10, 25), "status": "cancelled"}, "otherwise_excluded", "explicit_cancelled"),
        ("conflict", {"start_date": day(10, 25), "schedule_kind": "conflict"}, review, "conflicting_schedule"),
        ("weekly", {"start_date": day(10, 25), "recurrence_rule": "FREQ=WEEKLY"}, review, "recurrence_without_verified_instances"),
        ("overnight", {"start_date": day(10, 25), "start_time": "22:00", "end_time": "02:00"}, review, "unresolved_overnight_clock"),
        ("hours", {"start_date": day(10, 25), "end_date": day(10, 28), "start_time": "22:00", "end_time": "02:00"}, review, "unresolved_range_hours"),
        ("nowhere", {"start_date": day(10, 25), "timezone": "Mars/Base"}, review, "unknown_timezone"),
        ("twice", {"start_date": day(10, 25), "end_time": "02:30", "timezone": "Europe/Berlin"}, review, "ambiguous_end_time"),
        ("stale", {"start_date": day(10, 25), "status": "expired"}, review, "expired_status_conflicts_with_schedule"),
        ("some left", {"start_date": None, "occurrences": [sitting("a", day(10, 20)), sitting("b", day(10, 23)), sitting("c", day(11, 20))]}, "actionable", "supported_occurrences_in_window"),
        ("later ones", {"start_date": None, "occurrences": [sitting("a", day(10, 20)), sitting("c", day(11, 20))]}, "beyond_horizon", "remaining_sessions_after_horizon"),
        ("all gone", {"start_date": None, "occurrences": [sitting("a", day(10, 20), diagnostics=shape)]}, "expired", "all_sessions_ended"),
        ("held", {"start_date": None, "occurrences": [sitting("a", day(10, 20)), sitting("b", day(10, 23), diagnostics=shape)]}, review, "unresolved_sessions"),
    ]
    rows = spark.createDataFrame([base | {"name": name} | more for name, more, _, _ in cases], schema)
    r = schedules.relevance(F.struct(*(c for c in rows.columns if c != "name")), datetime.datetime(2026, 10, 22, 12, 0, tzinfo=datetime.UTC), 14)
    got = {x["name"]: x["r"] for x in rows.select("name", r.alias("r")).collect()}
    assert {k: (x.disposition, x.reason) for k, x in got.items()} == {name: (a, b) for name, _, a, b in cases}
    assert got["some left"].occurrence_ids == ["b"] and [(s.occurrence_id, s.reason) for s in got["held"].sessions] == [("a", "last_date_passed"), ("b", "unverified_timeslot")]
