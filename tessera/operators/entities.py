"""Entity resolution: pair decisions, lossless blocking, complete-link groups, survivorship."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import keys, text
from tessera.operators.storage import settled

# Places and clocks that are compared, kinds of schedules that name no single day, and fields whose diagnostics leave a date reliable.
PLACES = ("city", "venue_name", "address")
CLOCKS = ("start_time", "end_time")
UNDECIDED = ("discrete", "recurring", "conflict")
PRECISE = ("exact", "day")
PRICE_FIELDS = ("price_text", "price_amount", "currency")

#: The columns of a prepared context that ``matched`` compares.
COMPARED = ("candidate_id", "is_event", "title_key", "tokens", "city_key", "venue_name_key", "address_key", "place_words", "registration", "home", "sittings", "days", "hours", "reliable", "start_date", "start_time", "end_time", "timezone", "publisher_key", "source_id", "identity_slot", "content_url")

#: What ``prepared`` expects of a context beside candidate_id; a column that is missing counts as null.
CONTEXT = {
    "is_event": "boolean", "title": "string", "city": "string", "venue_name": "string", "address": "string", "registration_url": "string", "start_date": "date", "end_date": "date",
    "start_time": "string", "end_time": "string", "timezone": "string", "schedule_kind": "string", "date_precision": "string", "diagnostics": "array<struct<code:string,field:string>>",
    "occurrences": "array<struct<start_date:date,end_date:date,start_time:string,end_time:string,timezone:string,date_precision:string,diagnostics:array<string>>>",
    "publisher_key": "string", "source_id": "string", "source_url": "string", "identity_slot": "string", "content_url": "string",
}


def differ(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def reliable(c: Column) -> Column:
    """Names a context one day without doubt?  No range, no several days, and no diagnostic but on the price."""
    doubts = F.exists(F.coalesce(c["diagnostics"], F.array()), lambda d: ~d["field"].isin(*PRICE_FIELDS))
    return c["start_date"].isNotNull() & c["end_date"].isNull() & c["date_precision"].isin(*PRECISE) & ~F.coalesce(c["schedule_kind"].isin(*UNDECIDED), F.lit(False)) & ~doubts


def prepared(contexts: DataFrame) -> DataFrame:
    """Contexts with all columns of ``CONTEXT`` and what pairs are compared by, computed once for each: keys, tokens, dated occurrences."""
    missing = {k: F.lit(None).cast(kind) for k, kind in CONTEXT.items() if k not in contexts.columns}
    made = contexts.withColumns(missing) if missing else contexts
    made = made.withColumn("is_event", F.coalesce("is_event", F.lit(True)))
    made = made.withColumns({f"{f}_key": text.text_key(F.nullif(F.col(f), F.lit(""))) for f in ("title", *PLACES)})
    made = made.withColumn("tokens", text.distinctive(F.coalesce("title_key", F.lit("")))).withColumn("weak", ~F.exists("tokens", lambda t: ~text.is_number(t)))
    made = made.withColumn("place_words", F.array_distinct(F.filter(F.split(F.coalesce("address_key", F.lit("")), " "), lambda w: w != "")))
    made = made.withColumn("registration", keys.registration_key(F.col("registration_url"))).withColumn("home", keys.registration_key(F.col("source_url")))
    dated = F.filter(F.coalesce("occurrences", F.array()), lambda o: o["date_precision"].isin(*PRECISE) & (F.size(F.coalesce(o["diagnostics"], F.array())) == 0))
    part = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    made = made.withColumn("sittings", F.array_sort(F.array_distinct(F.transform(dated, lambda o: F.concat_ws("|", *(part(o[c]) for c in ("start_date", "end_date", "start_time", "end_time", "timezone")))))))
    made = made.withColumn("days", F.array_distinct(F.transform(dated, lambda o: o["start_date"])))
    whole = F.array(F.struct(F.col("start_date").alias("d"), F.coalesce("end_date", "start_date").alias("e"), F.col("start_time").alias("s"), F.col("end_time").alias("t"), F.col("timezone").alias("z")))
    each = F.transform("occurrences", lambda o: F.struct(o["start_date"].alias("d"), F.coalesce(o["end_date"], o["start_date"]).alias("e"), o["start_time"].alias("s"), o["end_time"].alias("t"), o["timezone"].alias("z")))
    made = made.withColumn("hours", F.filter(F.when(F.size(F.coalesce("occurrences", F.array())) > 0, each).otherwise(whole), lambda o: o["d"].isNotNull() & o["s"].isNotNull() & o["t"].isNotNull()))
    return made.withColumn("reliable", F.coalesce(reliable(F.struct(*CONTEXT)), F.lit(False)))


def matched(pairs: DataFrame) -> DataFrame:
    """(a, b, kind, reasons) of pairs of prepared contexts; symmetric, without scores or transitivity.

    Any conflict makes a pair distinct, but for differently written places beside
    a shared name, shared address words and overlapping days with the same hours:
    that is possible.  Same needs a strong title and one page of a publisher, or
    a reliable date in one zone with the publisher, or with the start time and a
    place or registration.  Dates and clocks that are not reliable are uncertain
    and conflict with nothing.
    """
    a, b, c = F.col("a"), F.col("b"), F.col
    no = F.lit(False)
    key = lambda x: F.when(~F.coalesce(x["registration"].isin(a["home"], b["home"]), no), x["registration"])
    primary = F.coalesce((a["identity_slot"] == "primary") & (b["identity_slot"] == "primary"), no)
    meet = lambda x, y: x["z"].eqNullSafe(y["z"]) & (x["s"] == y["s"]) & (x["t"] == y["t"]) & (F.greatest(x["d"], y["d"]) <= F.least(x["e"], y["e"]))
    facts = pairs.withColumns({
        "title": text.title_relation(a["title_key"], b["title_key"], a["tokens"], b["tokens"]),
        "sure": a["reliable"] & b["reliable"],
        "zone": same(a["timezone"], b["timezone"]),
        "several": (F.size(a["sittings"]) > 0) & (F.size(b["sittings"]) > 0) & (a["sittings"] != b["sittings"]),
        "day": same(a["start_date"], b["start_date"]),
        "otherday": differ(a["start_date"], b["start_date"]),
        "u": key(a), "v": key(b),
        "publisher": a["publisher_key"].eqNullSafe(b["publisher_key"]),
        "hours": F.exists(a["hours"], lambda x: F.exists(b["hours"], lambda y: meet(x, y))),
        "events": a["is_event"] & b["is_event"],
    })
    flags = {
        "conflicting_occurrence_dates": c("several") & ~F.arrays_overlap(a["days"], b["days"]),
        "conflicting_exact_date": c("otherday") & c("sure"),
        "distinctive_title_conflict": c("title") == "different",
        "timezone_conflict": differ(a["timezone"], b["timezone"]),
        "different_occurrence_sets": c("several"),
        "exact_date_match": c("day") & c("sure"),
        "uncertain_date_match": c("day") & ~c("sure"),
        "uncertain_date_difference": c("otherday") & ~c("sure"),
        "distinctive_title_exact": c("title") == "exact",
        "distinctive_title_strong": c("title") == "strong",
        "title_similarity_only": c("title") == "partial",
        "registration_url_match": same(c("u"), c("v")),
        "different_registration_urls": differ(c("u"), c("v")),
        "same_publisher": c("publisher"),
        "same_source_page": c("publisher") & differ(a["source_id"], b["source_id"]) & primary & same(a["content_url"], b["content_url"]),
    }
    for f in PLACES:
        flags |= {f"{f}_conflict": differ(a[f"{f}_key"], b[f"{f}_key"]), f"{f}_match": same(a[f"{f}_key"], b[f"{f}_key"])}
    for f in CLOCKS:
        flags |= {f"conflicting_{f}": differ(a[f], b[f]) & c("sure") & c("zone"), f"uncertain_{f}_difference": differ(a[f], b[f]) & ~(c("sure") & c("zone")), f"{f}_match": same(a[f], b[f]) & c("zone")}
    hard = ("conflicting_occurrence_dates", "conflicting_exact_date", "distinctive_title_conflict", "city_conflict", "timezone_conflict", "conflicting_start_time", "conflicting_end_time")
    words = (F.size(F.array_intersect(a["tokens"], b["tokens"])) >= 2) & (F.size(F.array_intersect(a["place_words"], b["place_words"])) >= 4)
    told = facts.select("a", "b", "day", "zone", "hours", "events", words.alias("words"), F.struct(*(v.alias(k) for k, v in flags.items())).alias("f"))
    f = lambda k: c(f"f.{k}")
    strong, place, soft = f("distinctive_title_exact") | f("distinctive_title_strong"), f("venue_name_match") | f("address_match"), f("venue_name_conflict") | f("address_conflict")
    certain = strong & ~f("different_occurrence_sets") & (f("same_source_page") | (f("exact_date_match") & c("zone") & (c("f.same_publisher") | (f("start_time_match") & (place | f("registration_url_match"))))))
    judged = told.withColumns({
        "hard": functools.reduce(Column.__or__, map(f, hard)), "soft": soft, "variant": soft & c("words") & c("hours"),
        "certain": certain, "maybe": strong | f("registration_url_match") | (c("day") & (place | f("city_match"))),
    })
    kind = (
        F.when(~c("events"), "insufficient").when(~c("hard") & c("variant"), "possible").when(c("hard") | c("soft"), "distinct")
        .when(c("certain"), "same_event").when(c("maybe"), "possible").otherwise("insufficient")
    )
    named = {k: f(k) for k in flags} | {"overlapping_schedule_address_variant": ~c("hard") & c("variant"), "insufficient_occurrence_evidence": ~c("hard") & ~c("soft") & ~c("certain")}
    reasons = F.array_sort(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in named.items()))))
    return judged.select("a", "b", kind.alias("kind"), F.when(c("events"), reasons).otherwise(F.array(F.lit("not_two_events"))).alias("reasons"))


def rare_tokens(contexts: DataFrame, percent: int = 85) -> DataFrame:
    """(candidate_id, x): of each title the n - ceil(0.85 n) + 1 rarest tokens; two strongly related titles share one."""
    words = contexts.select("candidate_id", F.size("tokens").alias("n"), F.explode("tokens").alias("x"))
    often = words.groupBy("x").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("candidate_id").orderBy("df", "x"))
    return words.join(often, "x").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("candidate_id", "x")


def met(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(candidate_id, other) of rows (candidate_id, k) that share a key, the lesser first; of one table, or across two."""
    other = (left if right is None else right).select(F.col("candidate_id").alias("other"), "k")
    pairs = left.join(other, "k").where("candidate_id < other" if right is None else "candidate_id <> other")
    return pairs.select(F.least("candidate_id", "other").alias("candidate_id"), F.greatest("candidate_id", "other").alias("other"))


def joined(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Pairs of ids, each once, to pairs of contexts: (a, b)."""
    c = F.struct("candidate_id", *contexts.drop("candidate_id").columns)
    left = contexts.select("candidate_id", c.alias("a"))
    right = contexts.select(F.col("candidate_id").alias("other"), c.alias("b"))
    return pairs.distinct().join(left, "candidate_id").join(right, "other").select("a", "b")


def sure_pairs(contexts: DataFrame) -> DataFrame:
    """(a, b) structs of prepared contexts that can be the same event.

    They share a rare title token beside a page, or beside a reliable date and
    the publisher or the start time; so a title that many announcements share
    makes no block of its own.  Contexts travel to their blocks, pairs never
    travel: a pair is made in the first block that its two share, so once.  They
    meet by a shuffled join, whatever their size: judging takes many tasks.
    """
    rare = rare_tokens(contexts.where("is_event")).groupBy("candidate_id").agg(F.array_sort(F.collect_set("x")).alias("rare"))
    dated = lambda x: F.when(F.col("reliable"), F.concat_ws("|", x, "start_date"))
    kinds = (
        lambda x: F.when(F.col("publisher_key").isNotNull(), F.concat(dated(x), F.lit("|p|"), "publisher_key")), lambda x: F.when(F.col("publisher_key").isNull(), F.concat(dated(x), F.lit("|n"))),
        lambda x: F.concat(x, F.lit("|u|"), "content_url"), lambda x: F.concat(dated(x), F.lit("|c|"), "start_time"),
    )
    blocks = F.array_compact(F.concat(*(F.transform("rare", k) for k in kinds)))
    own = rare.join(contexts, "candidate_id").select(F.struct(*COMPARED).alias("c"), blocks.alias("ks")).select("c", "ks", F.explode("ks").alias("k"))
    left, right = own.select(F.col("c").alias("a"), F.col("ks").alias("ka"), "k"), own.select(F.col("c").alias("b"), F.col("ks").alias("kb"), "k")
    return left.join(right.hint("merge"), "k").where((F.col("a.candidate_id") < F.col("b.candidate_id")) & (F.get(F.array_intersect("ka", "kb"), F.lit(0)) == F.col("k"))).select("a", "b")


def blocked_pairs(contexts: DataFrame) -> DataFrame:
    """(a, b) structs of prepared contexts that can be same or possible, each pair once, the lesser candidate_id first.

    Strong titles share a rare token; two reliable dates must agree as well, so
    those meet by token and date.  Titles that share nothing are a conflict, so
    all other blocks hold a title token beside what two contexts share: day and
    place, registration, or hours and an address word; titles too weak to differ
    are met apart.  Pairs outside the blocks are distinct or insufficient, and a
    block makes few pairs that are not returned as possible.
    """
    own = contexts.where("is_event")
    rare = rare_tokens(own).join(own.select("candidate_id", "reliable", "start_date"), "candidate_id")
    firm = rare.where("reliable").select("candidate_id", F.concat_ws("|", F.lit("t"), "x", "start_date").alias("k"))
    loose = rare.where("not reliable").select("candidate_id", F.concat_ws("|", F.lit("t"), "x").alias("k"))
    every = rare.where("reliable").select("candidate_id", F.concat_ws("|", F.lit("t"), "x").alias("k"))
    places = F.array_compact(F.array(*(F.when(F.col(f"{f}_key").isNotNull() & F.col("start_date").isNotNull(), F.concat_ws("|", F.lit(f), "start_date", f"{f}_key")) for f in PLACES), F.when(F.col("registration").isNotNull(), F.concat_ws("|", F.lit("r"), "registration"))))
    at = own.select("candidate_id", "tokens", "weak", F.explode(places).alias("p"))
    shared = at.where("not weak").select("candidate_id", F.explode(F.transform("tokens", lambda x: F.concat_ws("|", "p", x))).alias("k"))
    clock = own.where((F.size("tokens") >= 2) & (F.size("place_words") >= 4)).select("candidate_id", "tokens", "place_words", F.explode("hours").alias("h"))
    clock = clock.select("candidate_id", F.explode("tokens").alias("x"), "place_words", F.concat_ws("|", F.lit("h"), "h.s", "h.t").alias("h")).select("candidate_id", F.explode(F.transform("place_words", lambda w: F.concat_ws("|", "h", "x", w))).alias("k"))
    faint = at.where("weak").select("candidate_id", F.col("p").alias("k"))
    pairs = met(firm.union(loose).union(shared).union(clock).distinct()).union(met(loose, every)).union(met(faint, at.select("candidate_id", F.col("p").alias("k"))))
    return joined(pairs, contexts)


def decisions(contexts: DataFrame, sure: bool = False) -> DataFrame:
    """(candidate_id_a, candidate_id_b, kind, reasons) of all blocked pairs, or of those alone that can be the same event; contexts need not be prepared."""
    made = contexts if "sittings" in contexts.columns else prepared(contexts)
    pairs = sure_pairs(made) if sure else blocked_pairs(made)
    return matched(pairs).select(F.col("a.candidate_id").alias("candidate_id_a"), F.col("b.candidate_id").alias("candidate_id_b"), "kind", "reasons")


def same_events(contexts: DataFrame) -> DataFrame:
    """(candidate_id_a, candidate_id_b, kind) of all same-event pairs, written once without their reasons, as ``complete_link`` and ``blocked_edges`` read them."""
    return settled(decisions(contexts, sure=True).where("kind = 'same_event'").select("candidate_id_a", "candidate_id_b", "kind"))


def spanning(edges: DataFrame, a: str, b: str, nodes: int = 200_000) -> DataFrame:
    """(u, v) edges that connect what ``edges`` do: each task replaces its own by one star a component, and starts anew after ``nodes`` nodes."""

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, r) for x in list(up) if (r := root(x)) != x]
            up.clear()
            return pa.record_batch([pa.array([e[k] for e in found], kind) for k in (0, 1)], names=["u", "v"])

        kind = pa.string()
        for batch in batches:
            kind = batch.column(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > nodes:
                yield stars()
        if up:
            yield stars()

    kind = edges.schema[a].dataType.simpleString()
    return edges.select(F.col(a).alias("u"), F.col(b).alias("v")).mapInArrow(contracted, f"u {kind}, v {kind}")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root): the least id that each node reaches; labels are written each round and spread until none changes."""
    few = settled(spanning(edges, a, b))
    both = settled(few.select("u", "v").union(few.select("v", "u")).distinct())
    labels = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("u").alias("root"), F.col("root").alias("far"))
        moved = labels.join(near, "u").join(jump, "root", "left").select("u", F.least("root", "near", F.coalesce("far", "root")).alias("new"), "root")
        moved = settled(moved)
        labels = moved.select("u", F.col("new").alias("root"))
        if moved.where("new <> root").isEmpty():
            return labels.withColumnRenamed("u", "id")


def folded(part: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(id, first id of its group) of a component of same-event edges, the lesser id first in each."""
    earlier: dict[str, list[str]] = {}
    for x, y in part:
        earlier.setdefault(x, [])
        earlier.setdefault(y, []).append(x)
    home: dict[str, int] = {}
    size: list[int] = []
    first: list[str] = []
    for x in sorted(earlier):
        seen = Counter(home[y] for y in earlier[x])  # groups by how many members are the same event as x
        at = min((g for g, n in seen.items() if n == size[g]), default=len(size))
        if at == len(size):
            size.append(0)
            first.append(x)
        size[at] += 1
        home[x] = at
    return [(x, first[g]) for x, g in home.items()]


def complete_link(contexts: DataFrame, decided: DataFrame) -> DataFrame:
    """(candidate_id, group_id): in id order each joins the first group whose members are all the same event.

    Only components of same-event edges meet in a task, one after another;
    across them no edge is the same event, so the order within a component gives
    the order overall.  The work there is in proportion to the edges.
    ``decided`` is read twice, so it should be written before.
    """
    edges = decided.where("kind = 'same_event'").select("candidate_id_a", "candidate_id_b")
    roots = components(edges, "candidate_id_a", "candidate_id_b")
    own = edges.join(roots, edges["candidate_id_a"] == roots["id"]).select("root", F.col("candidate_id_a").alias("a"), F.col("candidate_id_b").alias("b"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, []
        made = lambda rows: pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["candidate_id", "group_id"])
        for batch in batches:
            done = []
            for root, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if root != at:
                    done += folded(part)
                    at, part = root, []
                part.append((a, b))
            yield made(done)
        yield made(folded(part))

    grouped = own.repartition("root").sortWithinPartitions("root").mapInArrow(fold, "candidate_id string, group_id string")
    return contexts.select("candidate_id").join(grouped, "candidate_id", "left").select("candidate_id", F.coalesce("group_id", "candidate_id").alias("group_id"))


def blocked_edges(decided: DataFrame, groups: DataFrame) -> DataFrame:
    """Same-event pairs whose members ended in different groups."""
    a = groups.select(F.col("candidate_id").alias("candidate_id_a"), F.col("group_id").alias("ga"))
    b = groups.select(F.col("candidate_id").alias("candidate_id_b"), F.col("group_id").alias("gb"))
    return decided.where("kind = 'same_event'").join(a, "candidate_id_a").join(b, "candidate_id_b").where("ga <> gb").select("candidate_id_a", "candidate_id_b", F.lit("all_member_grouping_blocked").alias("code"))


def survivors(members: DataFrame, group: str, anchor: Column, fields: list[str]) -> DataFrame:
    """One row a group: each field's value where all known ones agree, else null, and the names of fields that conflict."""
    value = lambda f: F.when(F.min(f) == F.max(f), F.min(f))
    conflicts = F.array_compact(F.array(*(F.when(F.min(f) != F.max(f), F.lit(f)) for f in fields)))
    return members.groupBy(group).agg(*(value(f).alias(f) for f in fields), conflicts.alias("conflicts"), F.count("*").alias("n_members"))
