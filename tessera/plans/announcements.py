"""Announcements made of orders, and queries on signals, entities, relevance, state and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.functions import keys, signals, temporal, text
from tessera.functions.temporal import bound
from tessera.operators import admission as admissions
from tessera.operators import entities, relational, schedules, versions
from tessera.operators.storage import settled
from tessera.plans.registry import query
from tessera.streaming import logs

REFERENCE = "1998-06-15"
NOW = datetime.datetime(1998, 6, 15, 8, 0, tzinfo=datetime.UTC)

#: One announcement for each order and part, with every branch of the rules.
SQL = """a as (select o_orderkey, l_partkey, o_custkey, c_nationkey, o_orderdate::date as day, p_retailprice, p_name, o_orderkey || ':' || l_partkey id,
  case o_orderkey % 6 when 3 then 'Cafe "' || p_name || '"' || chr(10) || 'Visit us, see the menu' when 4 then 'We enjoyed the workshop "' || p_name || '"' when 5 then p_name else 'Workshop "' || p_name || '"' end
  || case when o_orderkey % 5 <> 0 then chr(10) || 'Date: ' || strftime(o_orderdate, '%Y-%m-%d') else '' end
  || case when o_orderkey % 4 = 0 then chr(10) || 'Time: ' || (o_orderkey % 24) || ':30' else '' end
  || case when o_orderkey % 3 = 0 then chr(10) || 'Price: ' || floor(p_retailprice)::bigint || ' usd' else '' end
  || case when o_orderkey % 7 = 0 then chr(10) || 'Register online, join us' else '' end || case when o_orderkey % 11 = 0 then chr(10) || 'In person, 2 hours' else '' end txt
  from orders join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey join part on p_partkey = l_partkey join customer on c_custkey = o_custkey),
s as (select *, list_distinct(regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+')) w from a),
g as (select *, len(list_intersect(w, ['workshop','seminar','concert','festival','webinar'])) strong, len(list_intersect(w, ['class','session','meeting'])) weak, len(list_intersect(w, ['join','attend'])) attendance,
  len(list_intersect(w, ['register','registration','ticket'])) registration, len(list_intersect(w, ['cafe','museum','gallery'])) place, len(list_intersect(w, ['menu','visit','open'])) place_context, len(list_intersect(w, ['enjoyed','held','attended'])) retrospective,
  regexp_matches(txt, '[0-9]{4}-[0-9]{2}-[0-9]{2}') has_date, regexp_matches(txt, '\\b[0-9]{1,2}:[0-9]{2}\\b') has_time, regexp_matches(lower(txt), '\\b[0-9]+(\\.[0-9]+)? (usd|toman)\\b') has_price, regexp_matches(txt, '"[^"]+"') named from s),
e as (select *, case when strong > 0 then 2.0 + least(1.0, 0.5 * (strong - 1)) else 0 end + case when weak > 0 then 1.0 else 0 end + case when named and strong > 0 then 2.0 else 0 end + case when has_date then 1.5 else 0 end + case when has_time then 1.0 else 0 end
  + case when registration > 0 then 1.5 else 0 end + case when attendance > 0 then 1.0 else 0 end + case when has_price then 0.5 else 0 end - 2.0 * retrospective event_score,
  case when place > 0 then 2.0 + least(1.0, 0.5 * (place - 1)) else 0 end + case when place_context > 0 then 1.5 else 0 end + case when has_price and place > 0 then 0.5 else 0 end - 2.0 * retrospective place_score from g),
c as (select *, case when ((strong + weak > 0 and (has_date or has_time or registration > 0)) or (attendance > 0 and strong > 0 and named)) and event_score >= 3 then 'event' when place > 0 and place_score >= 3 then 'place' else 'other' end kind,
  case when o_orderkey % 6 = 5 then p_name else coalesce(nullif(regexp_extract(txt, '"([^"]+)"', 1), ''), split_part(txt, chr(10), 1)) end title from e)"""


def announcements(t):
    k = F.col("o_orderkey")
    name = F.col("p_name")
    quoted = lambda head: F.concat(F.lit(f'{head} "'), name, F.lit('"'))
    head = F.when(k % 6 == 3, F.concat(quoted("Cafe"), F.lit("\nVisit us, see the menu"))).when(k % 6 == 4, quoted("We enjoyed the workshop")).when(k % 6 == 5, name).otherwise(quoted("Workshop"))
    line = lambda on, *parts: F.when(on, F.concat(F.lit("\n"), *parts)).otherwise("")
    wording = F.concat(
        head,
        line(k % 5 != 0, F.lit("Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")),
        line(k % 4 == 0, F.lit("Time: "), (k % 24).cast("string"), F.lit(":30")),
        line(k % 3 == 0, F.lit("Price: "), F.floor("p_retailprice").cast("string"), F.lit(" usd")),
        line(k % 7 == 0, F.lit("Register online, join us")),
        line(k % 11 == 0, F.lit("In person, 2 hours")),
    )
    rows = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(t.orders, F.col("l_orderkey") == k).join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select("o_orderkey", "l_partkey", "o_custkey", "c_nationkey", F.to_date("o_orderdate").alias("day"), F.concat_ws(":", "o_orderkey", "l_partkey").alias("id"), wording.alias("txt"))


def classified(t):
    rows = announcements(t).withColumn("s", bound(F.col("txt"), signals.signals))
    return rows.withColumn("kind", bound(F.col("s"), signals.classify)).withColumn("title", bound(F.col("txt"), signals.title))


@query("x_signal_counts", f"with {SQL} select id, strong::int strong, registration::int registration, place::int place, retrospective::int retrospective, has_date, has_time, has_price, named from c")
def signal_counts(t):
    return classified(t).select("id", "s.strong", "s.registration", "s.place", "s.retrospective", F.col("s.date").alias("has_date"), F.col("s.time").alias("has_time"), F.col("s.price").alias("has_price"), "s.named")


@query("x_score", f"with {SQL} select id, event_score::double event_score, place_score::double place_score from c")
def score(t):
    event, place = signals.score(F.col("s"))
    return classified(t).select("id", event.alias("event_score"), place.alias("place_score"))


@query("x_classify", f"with {SQL} select id, kind from c")
def classify(t):
    return classified(t).select("id", "kind")


@query("x_discovery_status", f"with {SQL} select kind, count(*) n from c group by 1")
def discovery_status(t):
    return classified(t).groupBy("kind").agg(F.count("*").alias("n"))


@query("a_discovery_summary", f"with {SQL} select kind, count(*) n, count(distinct title) titles, count(*) filter (where has_date) dated from c group by 1")
def discovery_summary(t):
    return classified(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"), F.count_if("s.date").alias("dated"))


@query("x_labelled_value", f"with {SQL} select id, nullif(trim(regexp_extract(txt, '(?m)^Date[ \\t]*[:=-][ \\t]*(.+)$', 1)), '') date_text, nullif(trim(regexp_extract(txt, '(?m)^Price[ \\t]*[:=-][ \\t]*(.+)$', 1)), '') price_text from c")
def labelled_value(t):
    return announcements(t).select("id", signals.labelled(F.col("txt"), "Date").alias("date_text"), signals.labelled(F.col("txt"), "Price").alias("price_text"))


@query("x_price_line", f"with {SQL} select id, (list_filter(string_split(txt, chr(10)), lambda l: regexp_matches(lower(l), '[0-9]+ (usd|toman)')))[1] line from c")
def price_line(t):
    lines = F.filter(F.split("txt", "\n"), lambda x: F.lower(x).rlike(r"[0-9]+ (usd|toman)"))
    return announcements(t).select("id", F.get(lines, 0).alias("line"))


@query("x_regex_temporal", f"with {SQL} select id, nullif(regexp_extract(txt, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '') date_text, nullif(regexp_extract(txt, '[0-9]{{1,2}}:[0-9]{{2}}'), '') clock_text from c")
def regex_temporal(t):
    return announcements(t).select("id", F.nullif(F.regexp_extract("txt", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit("")).alias("date_text"), F.nullif(F.regexp_extract("txt", r"[0-9]{1,2}:[0-9]{2}", 0), F.lit("")).alias("clock_text"))


@query("x_event_format", f"with {SQL} select id, case when o_orderkey % 7 = 0 and o_orderkey % 11 = 0 then 'hybrid' when o_orderkey % 7 = 0 then 'online' when o_orderkey % 11 = 0 then 'in_person' end event_format from c")
def event_format(t):
    return announcements(t).select("id", signals.event_format(F.col("txt")).alias("event_format"))


@query("x_duration_minutes", f"with {SQL} select id, case when o_orderkey % 11 = 0 then 120 end::bigint as minutes from c")
def duration_minutes(t):
    return announcements(t).select("id", signals.minutes(F.col("txt")).alias("minutes"))


@query("x_reference_urls", "select page_id, array_to_string(list_distinct([url, url || '/more'])[1:5], ' ') != '' has_urls, 2::bigint n_urls from pages")
def reference_urls(t):
    found = signals.urls(F.concat(F.lit("See "), "url", F.lit(" and "), "url", F.lit("/more "), "url"))
    return t.pages.select("page_id", (F.size(found) > 0).alias("has_urls"), F.size(found).cast("long").alias("n_urls"))


@query("x_sold_out", "select l_orderkey, bool_or(l_quantity > 45) sold_out from lineitem group by 1")
def sold_out(t):
    line = F.when(F.col("l_quantity") > 45, " Sold  OUT ").otherwise("places left")
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(text.fold(line).isin("sold out", "full")).alias("sold_out"))


@query("x_unique_preferred_title", f"with {SQL} select o_orderkey, case when count(distinct title) = 1 then min(title) end title, count(distinct title) > 1 conflict from c where kind = 'event' group by 1")
def unique_preferred_title(t):
    differ = F.coalesce(F.min("title") != F.max("title"), F.lit(False))
    return classified(t).where("kind = 'event'").groupBy("o_orderkey").agg(relational.unanimous(F.col("title"), F.col("id")).alias("title"), differ.alias("conflict"))


@query("x_tiered_merge", "with r as (select l_orderkey, case when l_linenumber <= 2 then 0 else 1 end tier, l_returnflag v from lineitem), m as (select l_orderkey, min(tier) tier from r group by 1) select l_orderkey, case when count(distinct v) = 1 then min(v) end as flag from r join m using (l_orderkey, tier) group by 1")
def tiered_merge(t):
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") <= 2, 0).otherwise(1).alias("tier"), "l_returnflag")
    best = rows.groupBy("l_orderkey").agg(F.min("tier").alias("tier"))
    return rows.join(best, ["l_orderkey", "tier"]).groupBy("l_orderkey").agg(relational.unanimous(F.col("l_returnflag"), F.col("tier")).alias("flag"))


@query("x_city_lookup", "select s_suppkey, n_name city from supplier join nation on n_nationkey = s_nationkey")
def city_lookup(t):
    said = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.concat(F.lit("Office in "), "n_name", F.lit(", ground floor")).alias("line"))
    words = F.filter(F.split(F.lower("line"), r"[\s,]+"), lambda w: w != "")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.array_join(F.slice("w", k, n), " "))))
    grams = said.withColumn("w", words).select("s_suppkey", F.explode(F.array_distinct(runs)).alias("gram"))
    return grams.join(t.nation.select("n_name", F.concat(F.lit("in "), F.lower("n_name")).alias("gram")), "gram").select("s_suppkey", F.col("n_name").alias("city"))


@query("x_category_map", f"with {SQL} select id, case when kind = 'other' then null when starts_with(txt, 'Workshop ') then 'education' when starts_with(txt, 'Cafe ') then 'food' end category from c")
def category_map(t):
    names = t.spark.createDataFrame([("workshop", "education"), ("cafe", "food")], "term string, category string")
    rows = classified(t).select("id", "kind", F.lower(F.split_part("txt", F.lit(" "), F.lit(1))).alias("term"))
    return rows.join(F.broadcast(names), "term", "left").select("id", F.when(F.col("kind") != "other", F.col("category")).alias("category"))


@query("p_admission", f"with {SQL} select id, case when kind <> 'event' then 'not_established_event' when o_orderkey % 13 = 0 then 'placeholder_title' when o_orderkey % 17 = 0 then 'unsupported_title' when o_orderkey % 19 = 0 then 'missing_title' end reason from c")
def admission(t):
    k = F.col("o_orderkey")
    name = F.when(k % 13 == 0, "Untitled").when(k % 17 == 0, "something else entirely").when(k % 19 != 0, F.col("title"))
    return classified(t).select("id", signals.admission(F.col("kind"), name, F.col("txt")).alias("reason"))


@query("p_title_support", """with r as (select p_partkey k, string_split(lower(p_name), ' ') w from part)
select k p_partkey, case when k % 7 = 0 then 'not_established_event' when k % 11 = 0 then 'placeholder_title' when k % 13 = 0 then 'missing_title' when k % 3 = 1 and w <> list_reverse(w) then 'unsupported_title' when k % 17 = 0 or k % 19 = 0 then 'unsupported_title' end reason from r""")
def title_support(t):
    """Part names as titles: a third is stated with its words the other way round, some are placeholders, guarded, or attributed to nothing."""
    k, name = F.col("p_partkey"), F.col("p_name")
    words = F.split(name, " ")
    spaced = lambda x: F.concat(F.lit("Here: "), F.array_join(x, " or "), F.lit("!"))
    one = F.array(F.lit("c1"))
    event = F.struct(
        F.when(k % 7 == 0, "non_event: product_promotion").alias("detection_reason"), F.lit(None).cast("string").alias("description_text"),
        F.when(k % 11 == 0, F.lit("«Untitled  Event»")).when(k % 13 == 0, " … ").otherwise(name).alias("title"),
        F.when(k % 3 < 2, "explicit_caption").alias("origin"), F.when(k % 3 == 1, spaced(F.reverse(words))).otherwise(spaced(words)).alias("title_evidence_text"), F.array(F.lit("f1")).alias("title_evidence_ids"),
        F.array(F.lit("f1"), F.lit("f2")).alias("fragment_ids"), one.alias("candidate_ids"), F.when(k % 17 > 0, F.array(F.lit("s1"))).alias("source_ids"), F.lit("https://a.example/x").alias("source_url"),
        F.array(F.struct(F.lit("title").alias("field"), F.when(k % 19 == 0, F.array(F.lit("c2"))).otherwise(one).alias("candidate_ids"))).alias("provenance"),
    )
    return t.part.select("p_partkey", admissions.exclusion(event, admissions.title_key(event["title"])).alias("reason"))


@query("p_ordered_slices", """select p_partkey, p_partkey % 3 = 0 or (p_partkey % 3 = 1 and p_brand = p_name) or (p_partkey % 3 = 2 and p_partkey % 2 = 0) admitted from part""")
def ordered_slices(t):
    """A name and a brand as parts of a description: in the source's order, the other way round, and as one slice or one that is not there."""
    k, a, b = F.col("p_partkey") % 3, F.col("p_name"), F.col("p_brand")
    text = F.concat(F.lit("About "), a, F.lit(". Program: "), b, F.lit("."))
    both = lambda x, y: F.concat(x, F.lit("\n\n"), y)
    value = F.when(k == 0, both(a, b)).when(k == 1, both(b, a)).when(F.col("p_partkey") % 2 == 0, F.concat(a, F.lit(". Program"))).otherwise(F.concat(a, F.lit(" Program")))
    return t.part.select("p_partkey", admissions.source_slice(value, text, True).alias("admitted"))


@query("p_context_guard", f"with {SQL} select id, case when o_orderkey % 6 = 4 and o_orderkey % 7 <> 0 then 'past_only' end guard from c")
def context_guard(t):
    return announcements(t).select("id", signals.context_guard(F.col("txt")).alias("guard"))


@query("a_admission_summary", f"with {SQL} select coalesce(case when kind <> 'event' then 'not_established_event' end, 'admitted') reason, count(*) n from c group by 1")
def admission_summary(t):
    reason = F.coalesce(signals.admission(F.col("kind"), F.col("title"), F.col("txt")), F.lit("admitted"))
    return classified(t).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


#: The window ends at the midnight of Tehran after 60 more days: 1998-08-14 19:30 in UTC.
RELEVANCE = "case when o_orderkey % 23 = 0 then 'otherwise_excluded' when o_orderkey % 29 = 0 or o_orderkey % 5 = 0 then 'needs_schedule_review' when (day + (o_orderkey % 4)::int + 1)::timestamp <= timestamp '1998-06-15 08:00' then 'expired' when day::timestamp >= timestamp '1998-08-14 19:30' then 'beyond_horizon' else 'actionable' end"
REASON = "case when o_orderkey % 23 = 0 then 'explicit_cancelled' when o_orderkey % 29 = 0 or o_orderkey % 5 = 0 then 'unresolved_date_or_clock' when (day + (o_orderkey % 4)::int + 1)::timestamp <= timestamp '1998-06-15 08:00' then 'last_date_passed' when day::timestamp >= timestamp '1998-08-14 19:30' then 'starts_after_horizon' else 'ongoing_or_upcoming' end"


def event_of(start, stop, cancelled, unsafe, zone="UTC"):
    """An event without sessions, as ``relevance`` reads it."""
    none = lambda kind: F.lit(None).cast(kind)
    sessions = "array<struct<occurrence_id:string,start_date:date,end_date:date,start_time:string,end_time:string,timezone:string,date_precision:string,starts_at:timestamp,ends_at:timestamp,diagnostics:array<string>>>"
    code = F.struct(F.lit("conflicting_dates").alias("code"), F.lit("temporal").alias("field"))
    return F.struct(
        start.alias("start_date"), stop.alias("end_date"), none("string").alias("start_time"), none("string").alias("end_time"), F.lit(zone).alias("timezone"),
        F.when(start.isNull(), "unknown").otherwise("day").alias("date_precision"), none("timestamp").alias("starts_at"), none("timestamp").alias("ends_at"),
        F.when(cancelled, "cancelled").otherwise("unknown").alias("status"), none("string").alias("schedule_kind"), none("string").alias("recurrence_rule"),
        F.when(unsafe, F.array(code)).alias("diagnostics"), none(sessions).alias("occurrences"),
    )


def disposed(rows):
    """The rows with where their announcement stands at the reference instant."""
    k = F.col("o_orderkey")
    start = F.col("said_day")
    stop = F.when(k % 4 > 0, F.date_add(start, (k % 4).cast("int")))
    made = rows.withColumn("said_day", temporal.parse_iso(F.col("txt")))
    return made.withColumn("r", schedules.relevance(event_of(start, stop, k % 23 == 0, k % 29 == 0), NOW, 60))


@query("e_relevance", f"with {SQL} select id, {RELEVANCE} disposition, {REASON} reason from c")
def relevance(t):
    return disposed(announcements(t)).select("id", "r.disposition", "r.reason")


@query("e_relevance_sessions", f"with {SQL} select {RELEVANCE} disposition, count(*) n from c where kind = 'event' group by 1")
def relevance_sessions(t):
    return disposed(classified(t).where("kind = 'event'")).groupBy("r.disposition").agg(F.count("*").alias("n"))


@query("e_relevance_occurrences", """with s as (select l_orderkey, l_linenumber, l_shipdate::date as day, (l_shipdate + to_days(1)) <= timestamp '1995-06-15 08:00' gone, l_shipdate >= timestamp '1995-06-29 19:30' later, l_linenumber % 5 = 0 doubt from (select distinct l_orderkey, l_linenumber, l_shipdate from lineitem)),
d as (select l_orderkey, count(*) filter (where not gone and not later and not doubt) n_actionable, bool_or(doubt and not gone) doubt, bool_or(later and not doubt) later from s group by 1)
select l_orderkey, case when n_actionable > 0 then 'actionable' when doubt then 'needs_schedule_review' when later then 'beyond_horizon' else 'expired' end disposition,
  case when n_actionable > 0 then 'supported_occurrences_in_window' when doubt then 'unresolved_sessions' when later then 'remaining_sessions_after_horizon' else 'all_sessions_ended' end reason, n_actionable from d""")
def relevance_occurrences(t):
    """Orders as events, shipments as their sessions; every fifth session has a shape that is not verified."""
    none = lambda kind: F.lit(None).cast(kind)
    session = F.struct(
        F.col("l_linenumber").cast("string").alias("occurrence_id"), F.to_date("l_shipdate").alias("start_date"), none("date").alias("end_date"), none("string").alias("start_time"), none("string").alias("end_time"),
        F.lit("UTC").alias("timezone"), F.lit("day").alias("date_precision"), none("timestamp").alias("starts_at"), none("timestamp").alias("ends_at"),
        F.when(F.col("l_linenumber") % 5 == 0, F.array(F.lit("unverified_shape"))).alias("diagnostics"),
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").distinct().groupBy("l_orderkey").agg(F.collect_list(session).alias("sessions"))
    event = event_of(none("date"), none("date"), F.lit(False), F.lit(False)).withField("occurrences", F.col("sessions"))
    r = schedules.relevance(event, datetime.datetime(1995, 6, 15, 8, 0, tzinfo=datetime.UTC), 14)
    return rows.select("l_orderkey", r.alias("r")).select("l_orderkey", "r.disposition", "r.reason", F.size("r.occurrence_ids").cast("long").alias("n_actionable"))


_FLAGSHIP = f"""with {SQL}, named as (select *, case when has_date then day end d, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: not list_contains(['event','events','workshop','concert','exhibition','festival','the','a','an','of','and','in','at','for'], x)))) tk from c where kind = 'event'),
joined as (select min(id) anchor, min(title) title, o_custkey, d start_date, count(*) n_members, count(distinct o_orderkey) n_orders from named group by o_custkey, tk, d, case when d is null then id end)
select 'event:' || sha256(to_json([anchor, 'primary'])::varchar) event_id, title, o_custkey, start_date, n_members, n_orders, n_members > 1 merged,
  case when start_date is null then 'needs_schedule_review' when (start_date + 1)::timestamp <= timestamp '1998-06-15 08:00' then 'expired' when start_date::timestamp >= timestamp '1998-08-14 19:30' then 'beyond_horizon' else 'actionable' end disposition from joined"""


@query("flagship", _FLAGSHIP)
def flagship(t):
    """Announcements to events: classification, pair decisions, complete-link groups, survivorship, and what is actionable at the reference instant."""
    found = classified(t).where("kind = 'event'")
    named = found.select(F.col("id").alias("candidate_id"), "title", "o_orderkey", "o_custkey", F.col("c_nationkey").cast("string").alias("city"), F.col("o_custkey").cast("string").alias("publisher_key"), temporal.parse_iso(F.col("txt")).alias("start_date"))
    made = settled(entities.prepared(named.withColumn("timezone", F.lit("UTC")).withColumn("date_precision", F.when(F.col("start_date").isNull(), "unknown").otherwise("day"))))
    groups = entities.complete_link(made, entities.same_events(made))
    members = made.join(groups, "candidate_id")
    kept = entities.survivors(members, "group_id", F.col("candidate_id"), ["title", "o_custkey", "start_date"])
    orders = members.groupBy("group_id").agg(F.count_distinct("o_orderkey").alias("n_orders"))
    never = F.lit(False)
    rows = kept.join(orders, "group_id").withColumn("r", schedules.relevance(event_of(F.col("start_date"), F.lit(None).cast("date"), never, never), NOW, 60))
    return rows.select(keys.stable_id("event", "group_id", F.lit("primary")).alias("event_id"), "title", "o_custkey", "start_date", "n_members", "n_orders", (F.col("n_members") > 1).alias("merged"), "r.disposition")


def contexts(t):
    """Each distinct part name as a candidate, with a city, a day and a publisher of its parts."""
    rows = t.part.groupBy(F.col("p_name").alias("title")).agg(F.lpad(F.min("p_partkey").cast("string"), 9, "0").alias("candidate_id"), F.min("p_size").alias("size"), F.min("p_brand").alias("publisher_key"))
    none = F.lit(None).cast("string")
    city, day = (F.col("size") % 2).cast("string"), F.date_add(F.lit(REFERENCE).cast("date"), (F.col("size") % 3).cast("int"))
    return rows.select("candidate_id", "title", city.alias("city"), none.alias("venue_name"), none.alias("address"), none.alias("registration_url"), day.alias("start_date"), F.lit(None).cast("string").alias("start_time"), F.lit("UTC").alias("timezone"), F.lit("day").alias("date_precision"), "publisher_key", F.col("candidate_id").alias("source_id"), F.col("candidate_id").alias("source_url"))


_DECIDED = """with x as (select p_name title, lpad(min(p_partkey)::varchar, 9, '0') k, min(p_size) % 3 d, min(p_size) % 2 n, min(p_brand) o from part group by 1),
w as (select *, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda y: not list_contains(['event','events','workshop','concert','exhibition','festival','the','a','an','of','and','in','at','for'], y)))) w from x),
e as (select k, unnest(w) t, len(w) m from w), f as (select t, count(*) df from e group by 1),
r as (select k, t from (select k, t, m, row_number() over (partition by k order by df, t) i from e join f using (t)) where i <= m - ceil(m * 85 / 100.0) + 1),
rare as (select distinct a.k a, b.k b from r a join r b on a.t = b.t and a.k < b.k),
p as (select a.k a, b.k b, a.d = b.d and a.n = b.n near, a.d = b.d sameday, a.o = b.o sp, len(list_intersect(a.w, b.w)) s, len(list_distinct(list_concat(a.w, b.w))) u from w a join w b on a.k < b.k)
select p.a candidate_id_a, p.b candidate_id_b, case when not near or s = 0 then 'distinct' when s >= 2 and 100 * s >= 85 * u and sp then 'same_event' else 'possible' end kind
from p left join rare on rare.a = p.a and rare.b = p.b where (near and s > 0) or (sameday and rare.a is not null)"""


@query("e_pair_decisions", _DECIDED)
def pair_decisions(t):
    """Of every pair that shares a day, a city and a title token, or whose titles are strongly related: what it is."""
    return entities.decisions(contexts(t)).select("candidate_id_a", "candidate_id_b", "kind")


@query("e_pair_reasons")
def pair_reasons(t):
    """The same pairs with their reasons; tests compare with a plain version."""
    return entities.decisions(contexts(t)).select("candidate_id_a", "candidate_id_b", "kind", "reasons")


@query("e_reliable", "select o_orderkey, o_orderkey % 3 <> 2 and o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 not in (1, 2) reliable from orders")
def reliable(t):
    """Undated, ranges, several days, and doubts about the date or only about the price."""
    k = F.col("o_orderkey")
    start = F.when(k % 3 != 2, F.to_date("o_orderdate"))
    stop = F.when(k % 5 == 0, F.date_add("o_orderdate", 2))
    doubt = lambda code, field: F.array(F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    doubts = F.when(k % 11 == 1, doubt("inferred_year", "source_date_text")).when(k % 11 == 2, doubt("unreliable_temporal_ocr", "temporal")).when(k % 11 == 3, doubt("ambiguous_price", "price_text"))
    never = F.lit(False)
    context = F.struct(start.alias("start_date"), stop.alias("end_date"), schedules.precision(start, stop, F.lit(None), never).alias("date_precision"), schedules.kind(start, stop, never, F.when(k % 7 == 0, 2).otherwise(1)).alias("schedule_kind"), doubts.alias("diagnostics"))
    return t.orders.select("o_orderkey", context.alias("c")).select("o_orderkey", entities.reliable(F.col("c")).alias("reliable"))


@query("e_fact_conflict", "select a.s_suppkey a, b.s_suppkey b, coalesce(nullif(a.s_nationkey % 7, 0) <> nullif(b.s_nationkey % 7, 0), false) conflict from supplier a join supplier b on a.s_suppkey < b.s_suppkey")
def fact_conflict(t):
    pairs = relational.every_pair(t.supplier.select("s_suppkey", F.nullif(F.col("s_nationkey") % 7, F.lit(0)).alias("v")), "s_suppkey")
    return pairs.select("a", "b", entities.differ(F.col("v_x"), F.col("v_y")).alias("conflict"))


@query("e_survivorship", "select l_orderkey, case when count(distinct l_returnflag) = 1 then min(l_returnflag) end l_returnflag, case when count(distinct l_linestatus) = 1 then min(l_linestatus) end l_linestatus, concat_ws(',', case when count(distinct l_returnflag) > 1 then 'l_returnflag' end, case when count(distinct l_linestatus) > 1 then 'l_linestatus' end) conflicts, count(*) n_members from lineitem group by 1")
def survivorship(t):
    kept = entities.survivors(t.lineitem, "l_orderkey", F.struct("l_partkey", "l_linenumber"), ["l_returnflag", "l_linestatus"])
    return kept.withColumn("conflicts", F.array_join("conflicts", ","))


@query("e_channel_provenance", "select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) channels, count(*) n from orders group by 1")
def channel_provenance(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("channels"), F.count("*").alias("n"))


@query("e_duplicate_rows", "select least(l_partkey, l_suppkey) a, greatest(l_partkey, l_suppkey) b, string_agg(distinct l_returnflag, ',' order by l_returnflag) reasons from lineitem where l_partkey <> l_suppkey group by 1, 2")
def duplicate_rows(t):
    pairs = t.lineitem.where("l_partkey <> l_suppkey").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"))
    return pairs.agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("reasons"))


@query("e_slot_selection", "select user_id, event_type, coalesce(max_by(case when value > 50 then event_id end, case when value > 50 then event_id end), max(event_id)) event_id from events group by 1, 2")
def slot_selection(t):
    usable = F.when(F.col("value") > 50, F.col("event_id"))
    return t.events.groupBy("user_id", "event_type").agg(F.coalesce(F.max(usable), F.max("event_id")).alias("event_id"))


def walks(t):
    """Orders as announcements of one walk a customer, some without a clock: these are the same as two that exclude each other."""
    k = F.col("o_orderkey")
    clock = F.when(k % 3 == 1, "10:00").when(k % 3 == 2, "11:00")
    city = F.lit("Shiraz")
    return t.orders.select(
        F.lpad(k.cast("string"), 9, "0").alias("candidate_id"), F.concat(F.lit("Garden walk "), F.col("o_custkey").cast("string")).alias("title"), city.alias("city"), F.col("o_custkey").cast("string").alias("publisher_key"),
        F.lit("1998-06-20").cast("date").alias("start_date"), clock.alias("start_time"), F.lit("UTC").alias("timezone"), F.lit("day").alias("date_precision"),
    )


#: Groups take the clock of their first member that has one; what has another clock is the second group.
_WALKS = """o as (select lpad(o_orderkey::varchar, 9, '0') id, o_custkey c, o_orderkey % 3 t from orders), f as (select c, min(id) g1, min_by(t, id) filter (where t > 0) t1 from o group by 1),
h as (select o.c, min(id) g2 from o join f using (c) where t > 0 and t <> t1 group by 1), g as (select o.id, o.c, o.t, case when t = 0 or t = t1 then g1 else g2 end grp from o join f using (c) left join h using (c))"""


@query("e_complete_link", f"with {_WALKS} select id candidate_id, grp group_id from g")
def complete_link(t):
    made = settled(entities.prepared(walks(t)))
    return entities.complete_link(made, entities.same_events(made))


@query("e_blocked_edges", f"with {_WALKS} select a.id candidate_id_a, b.id candidate_id_b, 'all_member_grouping_blocked' code from g a join g b on a.c = b.c and a.id < b.id and (a.t = 0 or b.t = 0 or a.t = b.t) and a.grp <> b.grp")
def blocked_edges(t):
    made = settled(entities.prepared(walks(t)))
    decided = entities.same_events(made)
    return entities.blocked_edges(decided, settled(entities.complete_link(made, decided)))


@query("d_snapshot_latest", "select user_id, max_by(event_type, {'a': ts, 'b': event_id}) event_type, max_by(event_id, {'a': ts, 'b': event_id}) event_id from events group by 1")
def snapshot_latest(t):
    from tessera.operators import snapshots

    runs = t.events.select("user_id", "event_type", "event_id", F.col("ts").alias("started_at"), F.col("event_id").alias("run_id"))
    return snapshots.latest(runs, "user_id").select("user_id", "event_type", "event_id")


@query("d_load_document", "select doc_id, source, coalesce(quality, 1) quality from documents left join labels using (doc_id) where coalesce(toxic, 0) = 0")
def load_document(t):
    joined = t.documents.join(t.labels, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    return joined.select("doc_id", "source", F.coalesce("quality", F.lit(1)).alias("quality"))


@query("d_three_way_merge", "select doc_id, case when i is not distinct from b or i is not distinct from c then 'skipped' when c is distinct from b then 'conflict' else 'apply' end decision from (select doc_id, quality b, case when doc_id % 3 = 0 then 1 - quality else quality end c, case when doc_id % 2 = 0 then quality + 5 else quality end i from labels)")
def three_way_merge(t):
    k, base = F.col("doc_id"), F.col("quality")
    current, incoming = F.when(k % 3 == 0, 1 - base).otherwise(base), F.when(k % 2 == 0, base + 5).otherwise(base)
    return t.labels.select("doc_id", relational.three_way(base, current, incoming).alias("decision"))


@query("d_review_import", """with e as (select doc_id k, quality seen, case when doc_id % 3 = 0 then 1 - quality else quality end now, case when doc_id % 2 = 0 then quality + 5 else quality end said from labels)
select k doc_id, case when said = now then 'unchanged' when seen = now then 'apply' else 'conflict' end decision, said quality from e
union all select -k - 1, 'unknown', said from e where k % 7 = 0""")
def review_import(t):
    """Labels as they were exported, edited outside, against a state in which a third has changed since; some rows are of no document."""
    k, seen = F.col("doc_id"), F.col("quality")
    stored = t.labels.select("doc_id", F.when(k % 3 == 0, 1 - seen).otherwise(seen).alias("quality"))
    edited = t.labels.select("doc_id", versions.token("doc_id", "quality").alias("token"), F.when(k % 2 == 0, seen + 5).otherwise(seen).alias("quality"))
    foreign = edited.where(k % 7 == 0).withColumn("doc_id", -k - 1)
    return versions.decisions(stored, edited.union(foreign), "doc_id", ["quality"])


@query("d_carry_forward", "select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) carried from events")
def carry_forward(t):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(own).alias("carried"))


@query("d_status", "select count(*) n_events, count(distinct user_id) n_keys, strftime(max(ts), '%Y-%m-%d %H:%M:%S') latest from events")
def status(t):
    return t.events.agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_keys"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("d_fingerprint", """with p as (select lang, doc_id % 1000 part, sha256(string_agg(doc_id::varchar || ':' || sha256(text), ',' order by doc_id)) f, count(*) n from documents group by 1, 2)
select lang, sum(n)::bigint n_documents, sha256(string_agg(part::varchar || ':' || f, ',' order by part)) fingerprint from p group by 1""")
def fingerprint(t):
    """One of a language's documents: from those of a thousand shares of them, so that no task holds a language."""
    part = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("p")))), lambda x: x["p"]), ",")
    shares = t.documents.groupBy("lang", (F.col("doc_id") % 1000).alias("part")).agg(F.sha2(ordered("doc_id", part), 256).alias("f"), F.count("*").alias("n"))
    of = F.concat_ws(":", F.col("part").cast("string"), F.col("f"))
    return shares.groupBy("lang").agg(F.sum("n").alias("n_documents"), F.sha2(ordered("part", of), 256).alias("fingerprint"))


@query("r_tumbling", "select strftime(date_trunc('day', ts), '%Y-%m-%d') start, event_type, count(*) n from events group by 1, 2")
def tumbling(t):
    return logs.tumbling(t.events).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("r_sliding", "select strftime(s, '%Y-%m-%d %H') start, event_type, count(*) n from (select event_type, unnest([time_bucket(interval '12 hours', ts, timestamp '1970-01-01'), time_bucket(interval '12 hours', ts, timestamp '1970-01-01') - interval '12 hours']) s from events) group by 1, 2")
def sliding(t):
    return logs.tumbling(t.events, "1 day", slide="12 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query("r_session", "select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start, count(*) n from (select *, sum(b) over (partition by user_id order by ts, event_id) g from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end b from events)) group by user_id, g")
def session(t):
    return logs.sessions(t.events).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
