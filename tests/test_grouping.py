"""Posts to announcement units: hand-made posts whose units follow from the rules."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import grouping

WORKSHOP, CONCERT, FRIDAY, SATURDAY = "کارگاه سفالگری", "کنسرت باران", "جمعه ساعت ۱۸", "شنبه ساعت ۲۰"
#: name -> (caption, media in order, units as lists of places; 0 is the caption, media count from 1)
POSTS = {
    "support follows its anchor": (None, [WORKSHOP, FRIDAY, "آدرس: تهران، خیابان نمونه"], [[1, 2, 3]]),
    "two events, each with its support": (None, [WORKSHOP, FRIDAY, CONCERT, SATURDAY, "آدرس: شیراز"], [[1, 2], [3, 4, 5]]),
    "a place and when it is open": (None, ["گالری نگاه", "ساعات بازدید: هر روز از ۱۱ تا ۲۰", "آدرس: تهران"], [[1, 2, 3]]),
    "an English event without a name is a boundary": (None, ["concert Friday", "workshop Saturday", "Address: Example Street"], [[1], [2, 3]]),
    "other prose breaks the chain": (None, [WORKSHOP, "A different adventure awaits", FRIDAY], [[1], [2], [3]]),
    "prose with a date is no support": (None, [WORKSHOP, "Friday we explore another story"], [[1], [2]]),
    "other dates do not join": (None, [WORKSHOP + "\n" + FRIDAY, SATURDAY], [[1], [2]]),
    "other addresses do not join": (None, [WORKSHOP + "\nآدرس: تهران", "آدرس: شیراز"], [[1], [2]]),
    "other prices do not join": (None, [WORKSHOP + "\nقیمت: ۱۰۰ تومان", "قیمت: ۲۰۰ تومان"], [[1], [2]]),
    "conflicts count against the whole group": (None, [WORKSHOP, FRIDAY, "آدرس: تهران", SATURDAY], [[1, 2, 3], [4]]),
    "a date and a clock are two sides of one fact": (None, [WORKSHOP, "جمعه", "ساعت ۱۸"], [[1, 2, 3]]),
    "registration and price": (None, [WORKSHOP, "Register at https://example.test/book", "Price: free"], [[1, 2, 3]]),
    "support without an anchor stays apart": (None, ["Friday at 7 PM", "Address: Example Street", "Price: free"], [[1], [2], [3]]),
    "several names in one slide anchor nothing": (None, [WORKSHOP + "\n" + CONCERT, FRIDAY], [[1], [2]]),
    "a missing slide breaks the chain": (None, [WORKSHOP, None, FRIDAY], [[1], [3]]),
    "nothing usable": ("and", ["", "...", "and"], []),
    "caption alone": ("  کارگاه سفالگری\nجمعه ساعت ۱۸\n", [], [[0]]),
    "other anchors never merge": (WORKSHOP, ["کنسرت باران\nجمعه"], [[0], [1]]),
    "a general caption does not describe a slide": ("Our weekly selection", ["concert Friday"], [[0], [1]]),
    "a supporting caption joins the only anchor": (FRIDAY, [WORKSHOP], [[0, 1]]),
    "a caption is in one unit at most": ("Our weekly selection", [WORKSHOP, "جمعه", CONCERT, "شنبه"], [[0], [1, 2], [3, 4]]),
    "a caption with other facts stays apart": (WORKSHOP + "\nجمعه", [SATURDAY], [[0], [1]]),
    "an ambiguous slide does not take the caption": ("Price: free", ["concert Friday\nworkshop Saturday"], [[0], [1]]),
    "a slide that repeats a title is provenance": (None, [WORKSHOP, CONCERT, WORKSHOP], [[1], [2]]),
    "a slide that repeats a title with facts joins": (None, [WORKSHOP, CONCERT, WORKSHOP + "\n" + FRIDAY], [[1, 3], [2]]),
    "numbers tell titles apart": (None, ["کارگاه سفال ۱", CONCERT, "کارگاه سفال ۲"], [[1], [2], [3]]),
    "a caption takes the slides that repeat its title": (WORKSHOP + "\nجمعه ساعت ۱۸", [WORKSHOP, "آدرس: تهران", CONCERT], [[0, 2], [3]]),
    "a weak reading is provenance": (None, [WORKSHOP, "18:30"], [[1]]),
}


def fragments(spark, posts, kind):
    rows = []
    for name, (caption, media, _) in posts.items():
        if caption is not None:
            rows.append((name, f"{name}-0", grouping.CAPTION, None, caption, False))
        rows += [(name, f"{name}-{i}", kind, i, text, text is None) for i, text in enumerate(media, 1)]
    return spark.createDataFrame(rows, "item_id string, fragment_id string, kind string, slot int, text string, failed boolean").repartition(3)


def places(ids):
    return [int(x.rpartition("-")[2]) for x in ids]


@pytest.fixture(scope="module")
def made(spark):
    got = {name: [] for name in POSTS}
    for r in grouping.units(grouping.profiled(fragments(spark, POSTS, grouping.SLIDE))).collect():
        got[r.item_id].append(r)
    return {k: sorted(x, key=lambda r: [int(n) for n in r.unit.split(".")]) for k, x in got.items()}


@pytest.mark.parametrize("name", POSTS)
def test_units_of_posts(made, name):
    assert [places(r.fragments) for r in made[name]] == POSTS[name][2]


def test_notes_and_texts(made):
    first, second = made["a slide that repeats a title is provenance"]
    assert (places(first.collapsed), [n.note for n in first.notes]) == ([3], [grouping.REPEATED]) and not second.collapsed
    assert [n.note for n in made["a weak reading is provenance"][0].notes] == [grouping.INSUFFICIENT]
    assert [n.note for n in made["support follows its anchor"][0].notes] == [grouping.SUPPORT] * 2
    assert made["caption alone"][0].text == POSTS["caption alone"][0]
    lead = made["a caption takes the slides that repeat its title"][0]
    assert places(lead.collapsed) == [1] and lead.text == "\n".join([WORKSHOP + "\nجمعه ساعت ۱۸", "آدرس: تهران"])


def test_frames(spark):
    posts = {
        "one scene": (None, ["concert Friday at 7 PM", "CONCERT  Friday at 7 PM", "concert Friday at 7 PM"], [[1, 2, 3]]),
        "a new anchor": (None, [WORKSHOP, FRIDAY, CONCERT, SATURDAY], [[1, 2], [3, 4]]),
        "another digit": (None, ["concert Friday at 7 PM", "concert Friday at 8 PM"], [[1], [2]]),
        "a failed frame": (None, [WORKSHOP, None, FRIDAY], [[1], [3]]),
    }
    got = {name: [] for name in posts}
    for r in grouping.units(grouping.profiled(fragments(spark, posts, grouping.FRAME))).orderBy("unit").collect():
        got[r.item_id].append(places(r.fragments))
    assert got == {k: x[2] for k, x in posts.items()}


def test_media_kinds_and_listings(spark):
    rows = [
        ("kinds", "kinds-1", grouping.SLIDE, 0, WORKSHOP, False), ("kinds", "kinds-2", grouping.FRAME, 0, FRIDAY, False),
        ("page", "page-1", grouping.PAGE, None, WORKSHOP, False), ("page", "page-2", grouping.LISTING, None, "card", False),
        ("cards", "cards-1", grouping.LISTING, None, "card one", False), ("cards", "cards-2", grouping.LISTING, None, "card two", False),
    ]
    table = spark.createDataFrame(rows, "item_id string, fragment_id string, kind string, slot int, text string, failed boolean")
    got = {(r.item_id, r.unit): places(r.fragments) for r in grouping.units(grouping.profiled(table)).collect()}
    assert got == {("kinds", "0"): [1], ("kinds", "1"): [2], ("page", "0"): [1, 2], ("cards", "0"): [1, 2]}


def test_captions_with_headings(spark):
    two = "کارگاه سفال\nجمعه ساعت ۱۸\nکنسرت باران\nشنبه ساعت ۲۰"
    cases = {"two": two, "undated": "کارگاه سفال\nجمعه\nکنسرت باران\nبه زودی", "same": "کارگاه سفال\nجمعه\nکارگاه سفال\nشنبه", "many": "\n".join(f"کارگاه سفال {i}\nجمعه" for i in range(13)), "lead": "سلام به همه\n" + two}
    table = spark.createDataFrame([(k, k + "-0", grouping.CAPTION, None, t, False) for k, t in cases.items()], "item_id string, fragment_id string, kind string, slot int, text string, failed boolean")
    got = {}
    for r in grouping.units(grouping.profiled(table)).orderBy("unit").collect():
        got.setdefault(r.item_id, []).append((r.unit, r.text, len(r.collapsed)))
    parts = [("0.0", "کارگاه سفال\nجمعه ساعت ۱۸\n", 1), ("0.1", "کنسرت باران\nشنبه ساعت ۲۰", 1)]
    assert got["two"] == parts and got["lead"] == parts
    assert all(got[k] == [("0", cases[k], 0)] for k in ("undated", "same", "many"))


def test_empty_table(spark):
    table = spark.createDataFrame([], "item_id string, fragment_id string, kind string, slot int, text string, failed boolean")
    assert grouping.units(grouping.profiled(table)).collect() == []


def test_repeated_texts_are_read_once(spark, monkeypatch):
    """300 fragments repeat three texts of one kind and one of none: four are read, and each fragment gets its own text's reading."""
    n = spark.sparkContext.accumulator(0)
    one = F.udf(lambda t: n.add(1) or [], "array<struct<kind:string,term:string,start:int,stop:int>>")
    monkeypatch.setattr(grouping.analysis, "signals", one)
    rows = [(i, ["a", "b", "", None][i % 4], [grouping.SLIDE, grouping.SLIDE, grouping.SLIDE, None][i % 4]) for i in range(300)]
    table = spark.createDataFrame(rows, "item_id int, text string, kind string").repartition(5)
    got = grouping.read_once(table, "item_id", x=lambda text, kind, found: F.concat_ws("|", text, kind, F.size(found).cast("string"))).collect()
    assert sorted((r.item_id, r.text, r.kind, r.x) for r in got) == [(i, t, k, "|".join(x for x in (t, k, "0") if x is not None)) for i, t, k in rows]
    assert n.value == 4
