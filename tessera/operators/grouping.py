"""Fragments of one post to announcement units: profiles, then an ordered fold that joins only what is safe.

A post is a caption, slides or frames of its media in order, and website texts.
Texts are never concatenated to decide whether they belong together.  Everything
is an expression on the row of a post: profiles are structs in an array, and the
fold is an aggregate over it whose state looks back at all earlier groups.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import analysis, wording
from tessera.functions import text as texts
from tessera.functions import vocabulary as v
from tessera.functions.phrases import normalized
from tessera.functions.temporal import bound

CAPTION, LISTING, PAGE, IMAGE, SLIDE, FRAME = "caption", "website_listing", "website_text", "image", "slide", "frame"
MEDIA = (IMAGE, SLIDE, FRAME)
ORDER = (CAPTION, PAGE, IMAGE, SLIDE, FRAME, LISTING)
#: Notes of a unit.
SUPPORT, REPEATED, INSUFFICIENT = "support_attached_to_anchor", "repeated_anchor_collapsed", "ocr_fragment_insufficient_for_independent_event"
#: A clock or numeric date alone on its line, without a label, a month or a weekday.
ISOLATED = r"(?U)^[^\w]*(?:\d{1,2}(?::\d{2})?\s*(?:am|pm)?|\d{1,4}[/\-]\d{1,2}(?:[/\-]\d{1,4})?)[^\w]*$"
SINGLE = ("address", "venue", "city", "price", "url", "hours")
HEADING = 160  # code points of a heading at most
MOST = 12  # headings of a caption that is split
SPREAD = 64  # rows to which one text's reading is copied at most

LINE = "struct<words:array<string>,meaningful:boolean,weak:boolean,factless:boolean,support:boolean>"
TIMES = "array<struct<wording:string,dated:boolean,timed:boolean>>"
FACTS = f"struct<{','.join(f'{c}:string' for c in SINGLE)}>"
PROFILE = (
    "struct<at:int,id:string,kind:string,slot:int,usable:boolean,key:string,anchor:boolean,support:boolean,ambiguous:boolean,insufficient:boolean,"
    f"title:array<string>,lines:array<{LINE}>,times:{TIMES},facts:{FACTS}>"
)
GROUP = f"struct<anchor:boolean,title:array<string>,key:string,members:array<int>,collapsed:array<int>,notes:array<struct<at:int,note:string>>,times:{TIMES},facts:{FACTS}>"
STATE = f"struct<groups:array<{GROUP}>,now:int,kind:string,slot:int>"

_not = "|".join(re.escape(normalized(w)) for w in sorted({*v.NOT_IN_NAMES, *(t for d in v.DATES for t in d.split())}, key=len, reverse=True))
NAME = rf"(?:[ \t]+(?!(?:{_not})(?!\w))(?!\d+(?!\w))[^\W_]{{2,}}(?!\w)){{1,4}}(?:[ \t]+\d+(?!\w))*"


def equivalent(text: Column) -> Column:
    """Wording compared between fragments: no word and no digit may differ."""
    return F.trim(F.regexp_replace(texts.normalize(text), r"(?U)\s+", " "))


def named(text: Column, found: Column, heads: tuple[str, ...], quoted: tuple[str, ...]) -> Column:
    """The words of the first name: in quotes after one of ``quoted``, or up to four words after one of ``heads`` that opens its line; null without one.

    A name ends at punctuation, at a word no name holds, and at whatever else
    the text says: a date, a price, an invitation.  Numbers right after it count.
    """
    low = texts.normalize(text)
    in_quotes = F.regexp_extract(low, rf"(?U)(?<!\w)((?:{wording.any_of(quoted)})[ \t]*(?:«[^»\n]+»|“[^”\n]+”|\"[^\"\n]+\"))", 1)
    claims = wording.of_kind(found, "retrospective", "attendance", "place_context", "registration", "price", "date", "time")
    lines = F.split(low, "\n")

    def opened(line: Column, i: Column) -> Column:
        start = F.char_length(F.array_join(F.slice(lines, F.lit(1), i), "\n")) + F.when(i > 0, 1).otherwise(0)
        stop = F.array_min(F.concat(F.array(F.char_length(line)), F.transform(F.filter(claims, lambda s: (s["start"] >= start) & (s["start"] < start + F.char_length(line))), lambda s: s["start"] - start)))
        return F.regexp_extract(F.substring(line, F.lit(1), stop), rf"(?U)^[^\w]*((?:{wording.any_of(heads)})(?!\w){NAME})", 1)

    first = F.get(F.filter(F.transform(lines, opened), lambda x: x != ""), 0)
    return F.when(in_quotes != "", texts.tokens(in_quotes)).when(first.isNotNull(), texts.tokens(first))


def has(found: Column, *kinds: str) -> Column:
    return F.exists(found, lambda s: s["kind"].isin(*kinds))


def supports(line: Column, found: Column) -> Column:
    """Does a line only state a fact: a label with its value, a date, a price, opening hours, or where to register?"""
    low = texts.normalize(line)
    first = F.char_length(F.regexp_extract(low, r"(?sU)^([\W_]*)", 1))
    opens = lambda kind, *more: F.exists(found, lambda s: (s["kind"] == kind) & (s["start"] == first) & (s["term"].isin(*more) if more else F.lit(True)))
    label = "|".join(wording.label_pattern(n) for n in wording.LABELS)
    without = F.aggregate(wording.of_kind(found, "registration", "url"), line, lambda rest, s: F.concat(F.substring(rest, F.lit(1), s["start"]), F.repeat(F.lit(" "), s["stop"] - s["start"]), F.substring(rest, s["stop"] + 1, F.char_length(rest))))
    date = bound(wording.source_date(line, found), lambda d: d.isNotNull() & (texts.tokens(d) == texts.tokens(line)))
    return (first < F.char_length(low)) & (
        low.rlike(rf"(?sU)^[\W_]*(?:{label})\s*\S") | F.coalesce(date, F.lit(False)) | (opens("price") & wording.price(line, found).isNotNull())
        | opens("place_context", *v.OPENING, *v.DAILY) | (opens("registration") & wording.registration_url(line, found).isNotNull() & ~texts.meaningful(without, v.FUNCTION_WORDS))
    )


def factless(line: Column, found: Column) -> Column:
    """Does a line carry nothing that discovery reads?"""
    label = "|".join(wording.label_pattern(n) for n in wording.LABELS)
    return (F.size(found) == 0) & ~texts.normalize(line).rlike(f"(?sU){label}") & wording.city(line).isNull() & named(line, found, v.EVENT_HEADS, (*v.STRONG, *v.WEAK)).isNull() & named(line, found, v.PLACE_HEADS, v.PLACE_HEADS).isNull()


def profile(text: Column, kind: Column, found: Column) -> Column:
    """A fragment's struct of what it is: anchor, support, ambiguous or insufficient, its title, lines and facts."""
    lines = F.split(text, "\n")
    placed = F.transform(lines, lambda x, i: F.struct(x.alias("text"), (F.char_length(F.array_join(F.slice(lines, F.lit(1), i), "\n")) + F.when(i > 0, 1).otherwise(0)).alias("start")))
    placed = F.filter(placed, lambda x: x["text"].rlike(r"(?U)\S"))

    def with_signals(x: Column) -> Column:
        inside = F.filter(found, lambda s: (s["start"] >= x["start"]) & (s["start"] < x["start"] + F.char_length(x["text"])))
        return F.struct(x["text"].alias("text"), F.transform(inside, lambda s: s.withField("start", s["start"] - x["start"]).withField("stop", s["stop"] - x["start"])).alias("s"))

    return bound(F.transform(placed, with_signals), lambda own: _profile(text, kind, found, own))


def _profile(text: Column, kind: Column, found: Column, own: Column) -> Column:
    line = F.transform(own, lambda x: F.struct(
        texts.tokens(x["text"]).alias("words"), texts.meaningful(x["text"], v.FUNCTION_WORDS).alias("meaningful"), F.trim(texts.normalize(x["text"])).rlike(ISOLATED).alias("weak"),
        factless(x["text"], x["s"]).alias("factless"), supports(x["text"], x["s"]).alias("support"),
    ))
    event = lambda t, s: named(t, s, v.EVENT_HEADS, (*v.STRONG, *v.WEAK))
    place = lambda t, s: named(t, s, v.PLACE_HEADS, v.PLACE_HEADS)
    several = lambda x: F.size(F.array_distinct(F.filter(x, lambda y: y.isNotNull()))) > 1
    ambiguous = (
        several(F.transform(own, lambda x: event(x["text"], x["s"]))) | several(F.transform(own, lambda x: place(x["text"], x["s"])))
        | several(F.transform(own, lambda x: F.when(analysis.classify(x["text"], x["s"]) == "event", equivalent(x["text"]))))
    )
    date = wording.source_date(text, found)
    low = texts.normalize(text)
    read = {"address": wording.labelled(text, low, "address"), "venue": wording.labelled(text, low, "venue"), "city": wording.city(text), "price": wording.price(text, found), "url": wording.registration_url(text, found), "hours": wording.opening_hours(text, found)}
    parts = F.struct(
        line.alias("lines"), event(text, found).alias("event"), place(text, found).alias("place"), ambiguous.alias("ambiguous"), equivalent(date).alias("date"),
        F.struct(*(equivalent(read[c]).alias(c) for c in SINGLE)).alias("facts"),
    )

    def judged(p: Column) -> Column:
        anchor = (p["event"].isNotNull() | p["place"].isNotNull() | (analysis.classify(text, found) != "other")) & ~p["ambiguous"]
        insufficient = kind.isin(*MEDIA) & F.forall(F.filter(p["lines"], lambda x: x["meaningful"]), lambda x: x["weak"])
        support = ~(anchor | p["ambiguous"] | insufficient | has(found, "event_strong", "event_weak", "place_term", "retrospective", "attendance")) & (F.size(p["lines"]) > 0) & F.forall(p["lines"], lambda x: x["support"])
        title = F.when(anchor & p["event"].isNotNull(), F.concat(F.array(F.lit("event")), p["event"])).when(anchor & p["place"].isNotNull(), F.concat(F.array(F.lit("place")), p["place"]))
        times = F.when(p["date"].isNotNull(), F.array(F.struct(p["date"].alias("wording"), has(found, "date").alias("dated"), has(found, "time").alias("timed")))).otherwise(F.array())
        return F.struct(
            equivalent(text).alias("key"), anchor.alias("anchor"), support.alias("support"), p["ambiguous"].alias("ambiguous"), insufficient.alias("insufficient"), title.alias("title"),
            p["lines"].alias("lines"), times.cast(TIMES).alias("times"), p["facts"].alias("facts"),
        )

    return bound(parts, judged)


# ---- the fold


def conflicts(g: Column, p: Column) -> Column:
    """Does a profile state other facts than a group?  A date alone and a clock alone are two sides of one fact."""
    facts = [F.coalesce(g["facts"][c] != p["facts"][c], F.lit(False)) for c in SINGLE]
    sides = lambda a, b: a["dated"] & ~a["timed"] & b["timed"] & ~b["dated"]
    times = F.exists(g["times"], lambda a: F.exists(p["times"], lambda b: (a["wording"] != b["wording"]) & ~sides(a, b) & ~sides(b, a)))
    for f in facts:
        times = times | f
    return times


def begun(p: Column) -> Column:
    none = F.array()
    return F.struct(p["anchor"].alias("anchor"), p["title"].alias("title"), p["key"].alias("key"), F.array(p["at"]).alias("members"), none.alias("collapsed"), none.alias("notes"), p["times"].alias("times"), p["facts"].alias("facts")).cast(GROUP)


def noted(g: Column, p: Column, note: Column) -> Column:
    return g.withField("notes", F.concat(g["notes"], F.when(note.isNotNull(), F.array(F.struct(p["at"].alias("at"), note.alias("note")))).otherwise(F.array()).cast("array<struct<at:int,note:string>>")))


def joined(g: Column, p: Column, note: Column) -> Column:
    facts = F.struct(*(F.coalesce(g["facts"][c], p["facts"][c]).alias(c) for c in SINGLE))
    more = g.withField("members", F.concat(g["members"], F.array(p["at"]))).withField("key", p["key"]).withField("times", F.array_distinct(F.concat(g["times"], p["times"]))).withField("facts", facts)
    return noted(more, p, note)


def collapsed(g: Column, p: Column, note: Column) -> Column:
    return noted(g.withField("collapsed", F.concat(g["collapsed"], F.array(p["at"]))), p, note)


def relation(p: Column, title: Column) -> Column:
    """How a media fragment relates to an anchor: the note under which it is collapsed or attached, null if it does not."""
    words = F.slice(title, F.lit(2), F.size(title))
    run = lambda x: F.concat(F.lit("|"), F.array_join(x, "|"), F.lit("|"))
    repeats = lambda x: (F.size(x["words"]) > 0) & ((x["words"] == words) | ((F.size(x["words"]) >= 2) & (F.size(x["words"]) <= F.size(words)) & F.contains(run(words), run(x["words"]))))
    rest = F.filter(p["lines"], lambda x: ~repeats(x))

    def judged(left: Column) -> Column:
        said = F.filter(left, lambda x: x["meaningful"])
        plain = F.filter(said, lambda x: ~x["weak"])
        return (
            F.when(F.size(left) == F.size(p["lines"]), None)
            .when(F.forall(plain, lambda x: x["factless"]), F.when(F.exists(said, lambda x: x["weak"]), INSUFFICIENT).otherwise(REPEATED))
            .when(p["title"].isNotNull() & F.forall(plain, lambda x: x["support"]), SUPPORT)
        )

    other = p["ambiguous"] | ~p["kind"].isin(*MEDIA) | F.coalesce(p["title"] != title, F.lit(False))
    return F.when(~other & title.isNotNull(), bound(rest, judged))


def admission(g: Column, p: Column, title: Column) -> Column:
    """The note under which a group takes a repetition of ``title``, or null."""
    return bound(relation(p, title), lambda r: F.when((r != SUPPORT) | ~conflicts(g, p), r))


def admitted(g: Column, p: Column, note: Column) -> Column:
    return F.when(note == SUPPORT, joined(g, p, note)).otherwise(collapsed(g, p, note))


def _replaced(groups: Column, at: Column, g: Column) -> Column:
    return F.transform(groups, lambda x, i: F.when(i + 1 == at, g).otherwise(x))


def _step(state: Column, p: Column) -> Column:
    def to(groups: Column, now: Column) -> Column:
        return F.struct(groups.alias("groups"), now.cast("int").alias("now"), p["kind"].alias("kind"), p["slot"].alias("slot")).cast(STATE)

    groups, now = state["groups"], state["now"]
    beside = F.coalesce((state["kind"] == p["kind"]) & (((p["kind"] == SLIDE) & (p["slot"] == state["slot"] + 1)) | (p["kind"] == FRAME)), F.lit(False)) & (now > 0)

    def at_group(g: Column) -> Column:
        repeated = (p["kind"] == FRAME) & (g["key"] == p["key"])
        support = g["anchor"] & p["support"] & ~conflicts(g, p)
        how = F.when(~beside, "away").when(p["insufficient"] & g["anchor"], "weak").when(repeated, "repeated").when(support, "support").otherwise("away")

        def as_judged(how: Column) -> Column:
            own = F.when(how == "weak", collapsed(g, p, F.lit(INSUFFICIENT))).when(how == "repeated", joined(g, p, F.lit(None).cast("string"))).otherwise(joined(g, p, F.lit(SUPPORT)))
            return F.when(how == "away", elsewhere()).otherwise(to(_replaced(groups, now, own), now))

        return bound(how, as_judged)

    def elsewhere() -> Column:
        notes = F.transform(groups, lambda g, i: F.struct((i + 1).alias("i"), admission(g, p, g["title"]).alias("note")))

        def aimed(target: Column) -> Column:
            fresh = to(F.concat(groups, F.array(begun(p))), F.size(groups) + 1)
            return F.when(target.isNull(), fresh).otherwise(bound(F.get(groups, target["i"] - 1), lambda g: to(_replaced(groups, target["i"], admitted(g, p, target["note"])), target["i"])))

        return bound(F.array_max(F.filter(notes, lambda x: x["note"].isNotNull())), aimed)

    broken = F.struct(groups.alias("groups"), F.lit(0).alias("now"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("slot")).cast(STATE)
    later = bound(F.when(now > 0, F.get(groups, now - 1)), lambda g: F.when(g.isNull(), elsewhere()).otherwise(at_group(g)))
    return F.when(~p["usable"], broken).when(p["kind"].isin(CAPTION, LISTING), state).otherwise(later)


def _absorbed(lead: Column, group: Column, title: Column, profiles: Column) -> Column:
    """The caption's group with all of a media group that repeats its title, or null: all or nothing."""
    trial = F.struct(lead.alias("g"), F.lit(True).alias("ok"), F.lit(True).alias("first")).cast(f"struct<g:{GROUP},ok:boolean,first:boolean>")

    def take(state: Column, at: Column) -> Column:
        p = F.get(profiles, at)
        kept = lambda g, ok: F.struct(g.alias("g"), ok.alias("ok"), F.lit(False).alias("first")).cast(f"struct<g:{GROUP},ok:boolean,first:boolean>")

        def judged(note: Column) -> Column:
            holds = ~state["first"] & p["support"] & ~conflicts(state["g"], p)
            return F.when(note.isNotNull(), kept(admitted(state["g"], p, note), state["ok"])).otherwise(kept(F.when(holds, joined(state["g"], p, F.lit(None).cast("string"))).otherwise(state["g"]), state["ok"] & holds))

        return F.when(state["ok"], bound(admission(state["g"], p, title), judged)).otherwise(state)

    done = F.aggregate(group["members"], trial, take)
    return bound(done, lambda x: F.when(x["ok"], x["g"].withField("collapsed", F.concat(x["g"]["collapsed"], group["collapsed"])).withField("notes", F.array_distinct(F.concat(x["g"]["notes"], group["notes"])))))


def _captioned(groups: Column, caption: Column, profiles: Column) -> Column:
    """The groups with the caption: it takes groups that repeat its title, joins the only group if they go together, or stands first."""
    start = F.struct(begun(caption).alias("lead"), F.array().cast(f"array<{GROUP}>").alias("rest"), F.lit(False).alias("any"))
    kind = f"struct<lead:{GROUP},rest:array<{GROUP}>,any:boolean>"

    def over(state: Column, g: Column) -> Column:
        kept = F.struct(state["lead"].alias("lead"), F.concat(state["rest"], F.array(g)).alias("rest"), state["any"].alias("any")).cast(kind)
        return bound(F.when(caption["title"].isNotNull(), _absorbed(state["lead"], g, caption["title"], profiles)), lambda x: F.when(x.isNull(), kept).otherwise(F.struct(x.alias("lead"), state["rest"].alias("rest"), F.lit(True).alias("any")).cast(kind)))

    def joined_up(x: Column) -> Column:
        only = F.get(x["rest"], 0)
        parts = F.transform(only["members"], lambda i: F.get(profiles, i))
        safe = ~caption["ambiguous"] & ~F.exists(parts, lambda p: p["ambiguous"]) & ~conflicts(only, caption)
        alike = F.forall(parts, lambda p: p["key"] == caption["key"]) | (caption["anchor"] & F.forall(parts, lambda p: p["support"])) | (caption["support"] & only["anchor"])
        whole = only.withField("members", F.concat(F.array(caption["at"]), only["members"])).withField("facts", joined(only, caption, F.lit(None).cast("string"))["facts"])
        return F.when(~x["any"] & (F.size(x["rest"]) == 1) & safe & alike, F.array(whole)).otherwise(F.concat(F.array(x["lead"]), x["rest"]))

    return bound(F.aggregate(groups, start.cast(kind), over), joined_up)


def _listed(groups: Column, profiles: Column) -> Column:
    """Listing cards join the only group with a page's text; where there is not one such, they are a group."""
    cards = F.filter(profiles, lambda p: (p["kind"] == LISTING) & p["usable"])
    paged = lambda g: F.exists(g["members"], lambda i: F.get(profiles, i)["kind"] == PAGE)
    ids = F.transform(cards, lambda p: p["at"])
    more = F.transform(groups, lambda g: F.when(paged(g), g.withField("members", F.concat(g["members"], ids))).otherwise(g))
    own = begun(F.get(cards, 0)).withField("members", ids)
    return F.when(F.size(cards) == 0, groups).when(F.size(F.filter(groups, paged)) == 1, more).otherwise(F.concat(groups, F.array(own)))


def fold(profiles: Column) -> Column:
    """The groups of a post, from its profiles in fragment order.

    A fragment goes to the group before it if it stands beside it in the same
    medium and is a weak reading, a repetition or support without a conflict;
    else to the latest group whose title it repeats; else it begins one.  An
    unusable fragment breaks the chain.
    """
    start = F.struct(F.array().alias("groups"), F.lit(0).alias("now"), F.lit(None).alias("kind"), F.lit(None).alias("slot")).cast(STATE)
    media = F.aggregate(profiles, start, _step)["groups"]
    caption = F.get(F.filter(profiles, lambda p: (p["kind"] == CAPTION) & p["usable"]), 0)
    with_caption = bound(F.struct(media.alias("g"), caption.alias("c")), lambda x: F.when(x["c"].isNull(), x["g"]).otherwise(_captioned(x["g"], x["c"], profiles)))
    return bound(with_caption, lambda g: _listed(g, profiles))


def headings(text: Column, found: Column) -> Column:
    """(start, stop) of the blocks of a caption that announces 2 to 12 things, each under its own named heading and with its own date or registration; else none."""
    lines = F.split(text, "\n")

    def heading(line: Column, i: Column) -> Column:
        start = F.char_length(F.array_join(F.slice(lines, F.lit(1), i), "\n")) + F.when(i > 0, 1).otherwise(0)
        inside = F.transform(F.filter(found, lambda s: (s["start"] >= start) & (s["start"] < start + F.char_length(line))), lambda s: s.withField("start", s["start"] - start).withField("stop", s["stop"] - start))

        def judged(own: Column) -> Column:
            first = F.char_length(F.regexp_extract(texts.normalize(line), r"(?sU)^([\W_]*)", 1))
            words = named(line, own, v.EVENT_HEADS, (*v.STRONG, *v.WEAK))
            opens = F.exists(own, lambda s: (s["kind"] == "event_strong") & (s["start"] == first)) & ~has(own, "date", "time", "registration") & (F.char_length(F.trim(line)) <= HEADING)
            return F.when(opens & words.isNotNull(), F.struct(start.alias("start"), words.alias("words")))

        return bound(inside, judged)

    def blocks(heads: Column) -> Column:
        spans = F.transform(heads, lambda h, i: F.struct(h["start"].alias("start"), F.coalesce(F.get(heads, i + 1)["start"], F.char_length(text)).alias("stop")))
        stated = F.forall(spans, lambda x: F.exists(found, lambda s: s["kind"].isin("date", "registration") & (s["start"] >= x["start"]) & (s["start"] < x["stop"])))
        apart = F.size(F.array_distinct(F.transform(heads, lambda h: h["words"]))) == F.size(heads)
        return F.when(F.size(heads).between(2, MOST) & apart & stated, spans).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))

    return bound(F.filter(F.transform(lines, heading), lambda h: h.isNotNull()), blocks)


def read_once(fragments: DataFrame, item: str, **made) -> DataFrame:
    """``fragments`` (item, kind, text, ...) with columns made of (kind, text, found): each text is read once, however many fragments repeat it.

    Slides and frames repeat each other, and what a reading gives depends on a
    text and its kind alone.  What is read is copied to ``SPREAD`` rows at most,
    where fragments meet it by their items' hash, so that a text that most posts
    repeat does not meet all of them in one task.  A column is a function of
    three: text, kind and signals; null kinds are one.
    """
    parts = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fragments.withColumn("_d", F.pmod(F.xxhash64(item), F.lit(SPREAD)))
    dealt = rows.select(F.col("text").alias("_text"), F.col("kind").alias("_kind"), F.col("_d").alias("_n")).distinct()
    each = dealt.select(F.col("_text").alias("_t"), F.col("_kind").alias("_k")).distinct().repartition(parts).withColumn("_found", analysis.signals(F.col("_t")))
    read = each.select("_t", "_k", *(f(F.col("_t"), F.col("_k"), F.col("_found")).alias(c) for c, f in made.items()))
    copies = dealt.join(read, F.col("_text").eqNullSafe(F.col("_t")) & F.col("_kind").eqNullSafe(F.col("_k"))).drop("_t", "_k")
    return rows.join(copies, F.col("text").eqNullSafe(F.col("_text")) & F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("_d") == F.col("_n"))).drop("_d", "_text", "_kind", "_n")


def profiled(fragments: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, profiles) of fragments (item, fragment_id, kind, slot, text, failed): one row a post, its fragments in order.

    A post's fragments are gathered in one row, as its collector gathered them:
    a caption and a few slides or frames.  A null text or a failed reading is
    unusable; ties in order are decided by the id.
    """
    usable = ~F.coalesce(F.col("failed"), F.lit(False)) & F.coalesce(texts.meaningful(F.col("text"), v.FUNCTION_WORDS), F.lit(False))
    rows = fragments.select(item, "fragment_id", "kind", F.col("slot").cast("int").alias("slot"), F.coalesce("text", F.lit("")).alias("text"), usable.alias("usable"))
    rows = read_once(rows, item, p=profile, blocks=lambda text, kind, found: F.when(kind == CAPTION, headings(text, found)))
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    gathered = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.coalesce("slot", F.lit(-1)).alias("slot"), "fragment_id", "kind", "usable", "text", "p", "blocks")))
    posts = rows.groupBy(item).agg(gathered.alias("x"))
    fields = [f for f in ("key", "anchor", "support", "ambiguous", "insufficient", "title", "lines", "times", "facts")]
    made = F.transform("x", lambda r, i: F.struct(i.cast("int").alias("at"), r["fragment_id"].cast("string").alias("id"), r["kind"].alias("kind"), r["slot"].alias("slot"), r["usable"].alias("usable"), *(r["p"][c].alias(c) for c in fields)).cast(PROFILE))
    return posts.select(item, made.alias("profiles"), F.transform("x", lambda r: r["text"]).alias("texts"), F.filter(F.transform("x", lambda r: r["blocks"]), lambda b: b.isNotNull()).alias("blocks"))


def units(posts: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, unit, fragments, collapsed, notes, text) of ``profiled`` posts: what each announces, in order.

    ``fragments`` are ids whose texts make up the unit, ``collapsed`` those kept
    as provenance alone.  A caption that stands alone and announces several
    things under headings is a unit each; a post without a usable fragment has
    none.
    """
    grouped = posts.withColumn("g", fold(F.col("profiles"))).select(item, "profiles", "texts", "blocks", F.posexplode("g").alias("_n", "g"))
    ids = lambda at: F.transform(at, lambda i: F.get(F.col("profiles"), i)["id"])
    members = F.array_sort("g.members")
    alone = (F.size(members) == 1) & (F.get(F.col("profiles"), F.get(members, 0))["kind"] == CAPTION)
    text = F.array_join(F.transform(members, lambda i: F.get(F.col("texts"), i)), "\n")
    parts = F.when(alone, F.get("blocks", 0)).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    spans = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.char_length(text).alias("stop"))))
    rows = grouped.select(
        item, "_n", ids(members).alias("fragments"), ids(F.col("g.collapsed")).alias("collapsed"), F.transform("g.notes", lambda x: F.struct(F.get(F.col("profiles"), x["at"])["id"].alias("id"), x["note"].alias("note"))).alias("notes"),
        text.alias("whole"), (F.size(parts) > 0).alias("split"), F.posexplode(spans).alias("_m", "span"),
    )
    provenance = F.when(F.col("split"), F.concat("fragments", "collapsed")).otherwise(F.col("collapsed"))
    unit = F.concat_ws(".", F.col("_n").cast("string"), F.when(F.col("split"), F.col("_m").cast("string")))
    return rows.select(item, unit.alias("unit"), "fragments", provenance.alias("collapsed"), "notes", wording.cut(F.col("whole"), F.col("span.start"), F.col("span.stop")).alias("text"))
