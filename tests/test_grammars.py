"""Grammars, registries and state machines on hand-made cases."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import analysis, dates, net, phrases
from tessera.operators import jobs, readings, registry
from tessera.sources import pages, sinks
from tessera.streaming import logs

REFERENCE = date(2026, 10, 22)  # Thursday, 30 Mehr 1405


def day(text):
    got = dates.read(text, REFERENCE)
    return got.start, got.stop, got.codes


def test_one_day():
    assert dates.jalali(1405, 7, 30) == REFERENCE and dates.jalali_year(REFERENCE) == 1405
    assert day("5 آبان 1405") == (date(2026, 10, 27), None, ())
    assert day("سه شنبه پنجم آبان ماه") == (date(2026, 10, 27), None, ("inferred_year",))
    assert day("بیست و سوم مهر 1405")[0] == date(2026, 10, 15) and day("سی ام مهر 1405")[0] == REFERENCE
    assert day("چهارشنبه 5 آبان 1405") == (None, None, ("weekday_contradiction",))
    assert day("5 فروردین") == (None, None, ("missing_year",)) and day("31 مهر 1405") == day("30 اسفند 1405")[:2] + (("invalid_date",),)
    assert day("2026-10-27") == (date(2026, 10, 27), None, ()) and day("1405-08-05")[2] == ("ambiguous_calendar",) and day("2026-02-30")[2] == ("invalid_date",)
    assert day("فردا") == (date(2026, 10, 23), None, ("relative_date",)) and day("today")[0] == REFERENCE
    assert day("این هفته")[2] == ("broad_relative_date",) and day("hello") == (None, None, ())
    assert day("تا پایان 5 آبان")[2] == ("ambiguous_date_context",) and day("5 آبان یا 7 آذر")[2] == ("multiple_dates",) and day("5 آبان 14055")[2] == ("invalid_date",)


def test_ranges_and_lists():
    assert day("5 تا 8 آبان 1405") == (date(2026, 10, 27), date(2026, 10, 30), ())
    assert day("از 28 مهر تا جمعه 8 آبان") == (date(2026, 10, 20), date(2026, 10, 30), ("inferred_year",))
    assert day("5 تا شنبه 8 آبان")[2] == ("weekday_contradiction",) and day("8 تا 5 آبان 1405")[2] == ("invalid_date",)
    assert day("october 27, 2026") == (date(2026, 10, 27), None, ()) and day("from october 27 to 29 2026")[1] == date(2026, 10, 29)
    assert day("until october 27, 2026")[2] == ("ambiguous_date_context",) and day("october 29-27, 2026")[2] == ("invalid_date",)
    got = dates.read("جمعه و شنبه 8 و 9 آبان ساعت 18", REFERENCE)
    assert got.days == (date(2026, 10, 30), date(2026, 10, 31)) and got.codes == ("multiple_dates", "inferred_year") and got.rest.strip() == "ساعت 18"
    assert dates.read("شنبه و جمعه 8 و 9 آبان", REFERENCE).codes == ("multiple_dates", "weekday_contradiction")
    assert dates.read("8، 9 و 40 آبان 1405", REFERENCE).codes == ("multiple_dates", "invalid_date")


def test_listed_sessions():
    lines = ["5 آبان 18:00", "7 آبان", "9 آبان"]
    assert dates.sessions(lines, REFERENCE) == ([(date(2026, 10, d), "18:00") for d in (27, 29, 31)], ())
    assert dates.sessions(lines, REFERENCE, "17:00") == ([], ("conflicting_clocks",)) and dates.sessions(lines[::-1], REFERENCE) == ([], ("unresolved_sessions",))
    assert dates.sessions([*lines, "روزی دیگر"], REFERENCE) == ([], ("unparsed_temporal",)) and dates.sessions(lines, REFERENCE, most=2)[0] == []


def test_dates_of_rows(spark):
    rows = spark.createDataFrame([("5 آبان 1405",), (None,), ("8 و 9 آبان",)], "t string").select(dates.parse(F.col("t"), F.lit(REFERENCE)).alias("d"))
    got = rows.collect()
    assert [r.d.start for r in got] == [date(2026, 10, 27), None, None] and len(got[2].d.days) == 2 and got[2].d.codes == ["multiple_dates", "inferred_year"]


def plain_phrases(words, vocabulary, blocked):
    taken, out = set(blocked), []
    for phrase in sorted(vocabulary, key=lambda p: -len(p.split())):
        wanted = phrase.split()
        for at in range(len(words) - len(wanted) + 1):
            own = set(range(at, at + len(wanted)))
            if not own & taken and words[at : at + len(wanted)] == wanted:
                out.append((phrase, at, at + len(wanted)))
                taken |= own
    return sorted(out, key=lambda x: x[1])


def test_phrases_against_a_plain_version(spark):
    rng = random.Random(3)
    for _ in range(300):
        vocabulary = list(dict.fromkeys(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(5)))
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        blocked = {k for k in range(len(words)) if rng.random() < 0.1}
        assert phrases.Vocabulary(vocabulary).find(phrases.tokenized(" ".join(words)), blocked) == plain_phrases(words, vocabulary, blocked)
    text = "كافه\u200cگالری و کلاسیک، کارگاهِ سفال؛ Open  NIGHT"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(phrases.spans(F.col("t"), ["گالری", "کافه گالری", "کلاس", "کارگاه", "open night"]).alias("s")).collect()
    assert [(s.phrase, text[s.start : s.stop]) for s in got[0].s] == [("کافه گالری", "كافه\u200cگالری"), ("کارگاه", "کارگاهِ"), ("open night", "Open  NIGHT")] and got[1].s == []


@pytest.mark.parametrize(("address", "open_"), [("8.8.8.8", True), ("10.1.2.3", False), ("169.254.1.1", False), ("224.0.0.1", False), ("::1", False), ("2606:4700::1111", True), ("::ffff:10.0.0.1", False), ("fe80::1%eth0", False), ("name.example", False), (None, False)])
def test_public_addresses(address, open_):
    assert net.is_public(address) is open_


def test_hidden_parts_of_pages():
    assert pages.visible("<main>a<div style='DISPLAY: none'>b<p>c</div>d</main><hr>e<form>f</form><span class='x sr-only'>g</span><header>h</header>i") == "a\nd\nei"
    assert pages.visible("<i hidden>x<b>y</b></i>z<button>n</button></div>w") == "z\nw"
    assert pages.visible("<b>" * 150 + "x") == "x" and pages.visible("<b>" * 151 + "x") is None


def test_registry(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("defaults: {type: website}\nsources:\n- {id: a, url: 'https://a.example'}\n- {id: b, url: 'https://b.example', enabled: false, disabled_reason: robots}\n- {id: c, url: 'https://c.example', type: feed}\n")
    base = registry.load(tmp_path / "s.yaml")
    assert [(r["id"], r["type"]) for r in base] == [("a", "website"), ("b", "website"), ("c", "feed")]
    (tmp_path / "t.yaml").write_text("sources: [{id: a}, {id: a}]")
    with pytest.raises(ValueError, match="a"):
        registry.load(tmp_path / "t.yaml")
    own = registry.Registry(base, tmp_path / "o.json")
    own.move("a", "archive")
    own.move("c", "disable")
    with pytest.raises(ValueError, match="locked"):
        own.move("b", "enable")
    with pytest.raises(ValueError, match="archived"):
        own.move("a", "enable")
    with pytest.raises(ValueError, match="address"):
        own.add({"id": "d", "url": "https://a.example"})
    own.move("a", "restore")
    assert registry.Registry(base, tmp_path / "o.json").state("a") == "disabled" and (tmp_path / "o.json.bak").exists()
    own.move("a", "archive")
    local = registry.table(spark, [{"id": "c", "url": "https://x.example"}, {"id": "e", "url": "https://a.example"}, {"id": "f", "url": "https://f.example"}])
    got = {r.id: (r.enabled, r.archived, r.origin) for r in registry.overlay(registry.table(spark, base), own.states(spark), local).collect()}
    assert got == {"a": (False, True, "base"), "b": (False, False, "base"), "c": (False, False, "base"), "f": (True, False, "local")}


def test_jobs():
    seen = []
    board = jobs.Jobs([{"id": 4, "kind": "crawl", "state": "running", "since": 0, "updated": 1}], seen.append)
    assert board.rows[4]["state"] == "interrupted" and seen[0]["state"] == "interrupted"
    one = board.start("crawl", 2)
    assert one["id"] == 5 and board.start("crawl", 3) is None
    board.move(5, "running", 4)
    board.move(5, "cancelling", 5)
    with pytest.raises(ValueError, match="cancelling"):
        board.move(5, "running", 6)
    board.move(5, "cancelled", 7)
    assert board.active() is None and board.start("crawl", 8)["id"] == 6 and len(seen) == 6


def test_readings_are_used_again(spark):
    slot = lambda i: (i, "h", "slide", 0)
    wanted = spark.createDataFrame([slot(i) for i in "abcd"], "item_id string, content_hash string, kind string, slot int")
    rows = [(*slot("a"), "x", "1", False, 0.2, 1), (*slot("a"), "y", "1", True, 0.6, 2), (*slot("b"), "x", "1", False, 0.2, 1), (*slot("c"), "x", "1", False, 0.4, 1), (*slot("c"), "x", "2", False, 0.1, 2), (*slot("c"), "y", "1", False, 0.3, 1), (*slot("c"), "old", "1", True, 0.9, 9)]
    stored = spark.createDataFrame(rows, "item_id string, content_hash string, kind string, slot int, engine string, version string, usable boolean, score double, at int")
    got = {r.item_id: (r.reuse, r.engine, r.score, r.missing) for r in readings.cached(wanted, stored, ["x", "y"]).collect()}
    assert got == {"a": (True, "y", 0.6, []), "b": (False, None, None, ["y"]), "c": (True, "y", 0.3, []), "d": (False, None, None, ["x", "y"])}


def test_admitted_sessions(spark):
    schema = "id int, adapter string, schema string, path string, external_id string, codes array<string>, sessions array<struct<event_id:string,session_id:string,timeslot_id:string>>"
    good = ("site/3", "router/1", "/events/e1/", "e1")
    rows = [(1, *good, ["known", "other", "known"], [("e1", "s1", None), ("e1", "s2", "t1"), ("e1", "s2", "t2")]), (2, *good, ["known"], [("e2", "s1", None)]), (3, *good, None, [("e1", "s1", None), ("e1", "s1", "t1")]), (4, "site/2", *good[1:], ["known"], [("e1", "s1", None)]), (5, *good[:2], "/events/e9", "e1", ["known"], [("e1", "s1", None)]), (6, *good, None, [("e1", "s1", "t1"), ("e1", "s2", "t1")]), (7, *good, [], None)]
    got = {r.id: (len(r.admitted) if r.admitted is not None else None, r.codes) for r in readings.admitted(spark.createDataFrame(rows, schema), "site/3", "router/1", ("known",)).collect()}
    clash = "embedded_session_identity_conflict"
    assert got == {1: (3, ["known"]), 2: (None, ["known", clash]), 3: (None, [clash]), 4: (None, []), 5: (None, [clash]), 6: (None, [clash]), 7: (0, [])}


def test_media_is_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(b"x",), (b"x",), (b"y",), (None,), (b"",)], "content binary")
    first = sinks.write_media(rows, str(tmp_path / "m"), "slide").collect()
    again = sinks.write_media(rows, str(tmp_path / "m"), "slide").collect()
    assert [r.created for r in first] == [True, True] and [r.created for r in again] == [False, False]
    assert sorted(p.read_bytes() for p in (tmp_path / "m").iterdir()) == [b"x", b"y"]


def stream(spark, tmp_path, rows, make, name):
    schema = "user_id long, event_id long, event_type string, ts timestamp"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        files = sorted((tmp_path / name).glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
        import os

        os.utime(files[-1], (1_000_000 + n, 1_000_000 + n))
    made = make(logs.read(spark, str(tmp_path / name)))
    q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from datetime import datetime

    at = lambda m: datetime(2026, 1, 1, 0, m)
    rows = [[(1, 1, "a", at(0)), (2, 2, "ask", at(1))], [(1, 3, "a", at(2)), (1, 4, "b", at(3)), (3, 5, "ask", at(3))], [(2, 6, "view", at(5)), (1, 1, "a", at(6))], [(9, 7, "view", at(59))], [(9, 8, "view", at(59))]]
    got = stream(spark, tmp_path, rows, logs.changes, "changed")
    assert sorted((r.user_id, r.event_id, r.change) for r in got if r.user_id == 1) == [(1, 1, "changed"), (1, 1, "new"), (1, 3, "existing"), (1, 4, "changed")]
    got = stream(spark, tmp_path, rows, lambda e: logs.once(e, "event_id"), "first")
    assert sorted(r.event_id for r in got) == [1, 2, 3, 4, 5, 6, 7, 8]
    got = stream(spark, tmp_path, rows, logs.pending, "asked")
    assert sorted((r.user_id, r.event_id, r.outcome) for r in got) == [(2, 2, "answered"), (3, 5, "expired")]


def test_signals_are_claimed_in_order():
    def kinds(text):
        return [(k, text[a:b]) for k, _, a, b in analysis.analyze(text)]

    assert kinds("کارگاه سفال برگزار شد") == [("event_strong", "کارگاه"), ("retrospective", "برگزار شد")]
    assert kinds("۳ ساعت کلاس") == [("event_weak", "کلاس")] and ("time", "ساعت") in kinds("ساعت ۱۷")
    assert kinds("دی") == [] and ("date", "دی") in kinds("5 دی") and kinds("may be") == []
    assert kinds("هر روز خوب") == [] and ("place_context", "هر روز") in kinds("هر روز 10:00") and ("place_context", "هر روز") in kinds("ساعات کاری هر روز")
    assert kinds("https://a.example/register.") == [("url", "https://a.example/register")] and kinds("register") == [("registration", "register")]
    assert ("named_event", "Clay") in kinds('workshop "Clay" today') and not any(k == "named_event" for k, _ in kinds('workshop of "Clay"'))
    assert kinds("opening night") == [("event_strong", "opening night")] and kinds("کلاسیک") == [] == kinds("") == analysis.analyze(None)
    assert ("date", "1404/06/19") in kinds("1404/06/19") and ("date", "مهرماه") in kinds("3 مهرماه")


def test_saved_pages_are_a_source(spark, tmp_path):
    from tessera.sources import saved

    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.html").write_text("<p>سلام", encoding="utf-8")
    (folder / "b.html").write_bytes(b"\xff\xfe")
    (folder / "c.htm").write_bytes(b"x" * (saved.LARGEST + 1))
    (folder / "d.txt").write_text("no page")
    saved.register(spark)
    rows = spark.read.format("saved_pages").option("each", 2).load(str(folder)).collect()
    assert sorted((r.path.rpartition("/")[2], r.status, r.html) for r in rows) == [("a.html", "ok", "<p>سلام"), ("b.html", "encoding", None), ("c.htm", "too_large", None)]


def test_strict_logs_refuse_bad_lines(spark, tmp_path):
    from tessera.sources import jsonl

    path = tmp_path / "log.jsonl"
    path.write_text('{"id":"a","raw_text":"1","captured_at":"2026-01-01T00:00:00Z","seq":1}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|[Mm]alformed|PARSE"):
        jsonl.read(spark, str(path), strict=True).collect()
