"""Queries on dates in prose, phrases, addresses, the registry, stored readings, sessions and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import analysis, dates, net, phrases, temporal
from tessera.functions import text as texts
from tessera.operators import readings, registry
from tessera.plans.registry import query
from tessera.sources import sinks


@query("n_parse_dates", "select o_orderkey, case when o_orderkey % 5 < 3 then o_orderdate::date when o_orderkey % 5 = 3 then o_orderdate::date + 1 end as start, case o_orderkey % 5 when 3 then 'relative_date' when 4 then 'broad_relative_date' else '' end codes, o_orderkey % 5 = 4 blocked from orders")
def parse_dates(t):
    """Days written with Persian and English months, as ISO, as tomorrow, and as a week."""
    k, day = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    line = F.when(k == 0, F.concat(F.lit("تاریخ: "), temporal.jalali_text(day))).when(k == 1, F.date_format(day, "MMMM d, yyyy")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).when(k == 3, "فردا").otherwise("next week")
    got = t.orders.select("o_orderkey", dates.parse(texts.fold(line), day).alias("d"))
    return got.select("o_orderkey", "d.start", F.array_join("d.codes", ",").alias("codes"), "d.blocked")


@query("n_parse_date_ranges", "select o_orderkey, case when o_orderkey % 3 < 2 then o_orderdate::date end as start, case when o_orderkey % 3 = 1 then o_orderdate::date + 3 end as stop, case when o_orderkey % 3 = 2 then 2 else 0 end::bigint n_days from orders")
def parse_date_ranges(t):
    """One day of a Persian month, a range over its end, and lists of two days, all with years."""
    k, day = F.col("o_orderkey") % 3, F.to_date("o_orderdate")
    j = temporal.date_to_jalali(day)
    first = F.when(j["d"] > 1, j["d"] - 1).otherwise(2)
    month = F.element_at(F.array(*map(F.lit, temporal.PERSIAN_MONTHS)), j["m"].cast("int"))
    listed = F.concat_ws(" ", first.cast("string"), F.lit("و"), j["d"].cast("string"), month, j["y"].cast("string"))
    ranged = F.concat_ws(" ", temporal.jalali_text(day), F.lit("تا"), temporal.jalali_text(F.date_add(day, 3)))
    line = F.when(k == 0, temporal.jalali_text(day)).when(k == 1, ranged).otherwise(listed)
    got = t.orders.select("o_orderkey", dates.parse(texts.fold(line), day).alias("d"))
    return got.select("o_orderkey", "d.start", "d.stop", F.size("d.days").cast("long").alias("n_days"))


@query("t_phrase_spans")
def phrase_spans(t):
    """Where terms of the benchmark stand in documents; places are code points, which tests compare with a plain search."""
    found = t.documents.select("doc_id", F.explode(phrases.spans(F.col("text"), ["all rights reserved", "all rights", "rights", "copyright", "license", "permission is hereby granted"])).alias("s"))
    return found.select("doc_id", "s.phrase", "s.start", "s.stop")


_OPEN = """select event_id, not (a in (0, 10, 127) or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 198 and b in (18, 19)) or a >= 224) open
from (select event_id, event_id % 240 a, (event_id * 7) % 256 b from events)"""


@query("p_public_address", _OPEN)
def public_address(t):
    k = F.col("event_id")
    address = F.concat_ws(".", (k % 240).cast("string"), ((k * 7) % 256).cast("string"), F.lit("5"), F.lit("9"))
    return t.events.select("event_id", net.public_address(address).alias("open"))


_EFFECTIVE = """with b as (select 's' || s_suppkey id, 'i' || (s_suppkey * 10) identity, s_suppkey % 7 = 0 locked, s_suppkey k from supplier),
l as (select case when c_custkey % 2 = 0 then 's' else 'c' end || c_custkey id, 'i' || c_custkey identity from customer)
select id, not locked and not (k % 3 = 0 and k % 5 = 0) and (k % 3 <> 0 or k % 2 = 0) enabled, k % 3 = 0 and k % 5 = 0 archived, 'base' origin from b
union all select id, true, false, 'local' from l where id not in (select id from b) and identity not in (select identity from b)"""


@query("s_registry_effective", _EFFECTIVE)
def registry_effective(t):
    none, k, c = F.lit(None).cast("string"), F.col("s_suppkey"), F.col("c_custkey")
    name = lambda a, b: F.concat(a if not isinstance(a, str) else F.lit(a), b.cast("string"))
    rest = [none.alias("url"), none.alias("type"), F.lit(True).alias("enabled")]
    base = t.supplier.select(name("s", k).alias("id"), name("i", k * 10).alias("identity"), *rest, F.when(k % 7 == 0, "robots").alias("disabled_reason"))
    local = t.customer.select(name(F.when(c % 2 == 0, "s").otherwise("c"), c).alias("id"), name("i", c).alias("identity"), *rest, none.alias("disabled_reason"))
    states = t.supplier.where(k % 3 == 0).select(name("s", k).alias("id"), (k % 2 == 0).alias("enabled"), (k % 5 == 0).alias("archived"))
    return registry.overlay(base, states, local).select("id", "enabled", "archived", "origin")


@query("s_reading_cache", """with r as (select user_id, max_by(value > 50, {'t': ts, 'e': event_id}) usable from events where event_type = 'view' group by 1)
select u.user_id, coalesce(usable, false) reuse, case when coalesce(usable, false) then '' when usable is null then 'x,y' else 'y' end missing from (select distinct user_id from events) u left join r using (user_id)""")
def reading_cache(t):
    """Views as readings of one engine, of a user's only slot; a second engine has read nothing."""
    slot = [F.col("user_id").alias("item_id"), F.lit("h").alias("content_hash"), F.lit("slide").alias("kind"), F.lit(0).alias("slot")]
    wanted = t.events.select(*slot).distinct()
    stored = t.events.where("event_type = 'view'").select(*slot, F.lit("x").alias("engine"), F.col("event_id").alias("version"), (F.col("value") > 50).alias("usable"), F.col("value").alias("score"), F.struct("ts", "event_id").alias("at"))
    got = readings.cached(wanted, stored, ["x", "y"])
    return got.select(F.col("item_id").alias("user_id"), "reuse", F.array_join("missing", ",").alias("missing"))


@query("p_session_admission", "select l_orderkey, case when count(*) = count(distinct l_linenumber % 6) and l_orderkey % 9 <> 0 then count(*) end::bigint n_admitted, case when l_orderkey % 9 = 0 or count(*) <> count(distinct l_linenumber % 6) then 'known,embedded_session_identity_conflict' else 'known' end codes from (select distinct l_orderkey, l_linenumber from lineitem) group by 1")
def session_admission(t):
    """Lines as sessions of their order: numbers that agree modulo 6 are one session twice, and some pages are another order's."""
    k = F.col("l_orderkey")
    line = F.struct(k.cast("string").alias("event_id"), (F.col("l_linenumber") % 6).cast("string").alias("session_id"), F.lit(None).cast("string").alias("timeslot_id"))
    items = t.lineitem.select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.collect_list(line).alias("sessions"))
    foreign = F.transform("sessions", lambda s: s.withField("event_id", F.when(k % 9 == 0, "another").otherwise(s["event_id"])))
    items = items.select("l_orderkey", F.lit("site/3").alias("adapter"), F.lit("router/1").alias("schema"), F.concat(F.lit("/events/"), k.cast("string"), F.lit("/")).alias("path"), k.cast("string").alias("external_id"), F.array(F.lit("known"), F.lit("unheard")).alias("codes"), foreign.alias("sessions"))
    got = readings.admitted(items, "site/3", "router/1", ("known",))
    return got.select("l_orderkey", F.when(F.col("admitted").isNotNull(), F.size("admitted").cast("long")).alias("n_admitted"), F.array_join("codes", ",").alias("codes"))


@query("s_media_paths", "select 'media/text-' || left(sha256(text), 12) path, count(*) n from documents where text <> '' group by text")
def media_paths(t):
    return sinks.media(t.documents, "media", "text", "text").select("path", "n")


@query("x_structured_occurrence", "select user_id, bool_or(event_type = 'view') and bool_or(event_type = 'click') and bool_or(event_type = 'purchase') proves from events group by 1")
def structured_occurrence(t):
    kind = F.when(F.col("event_type") == "view", "date").when(F.col("event_type") == "click", "time").when(F.col("event_type") == "purchase", "price").otherwise("other")
    return readings.structured_occurrence(t.events.withColumn("kind", kind), F.col("user_id")).withColumnRenamed("slot", "user_id")


def bilingual():
    """Announcements in two languages, made of an order's number and status."""
    k, name = F.col("o_orderkey") % 6, F.col("o_orderstatus")
    return (
        F.when(k == 0, F.concat(F.lit("کارگاه «"), name, F.lit("»\nپنجشنبه ۵ آبان ساعت ۱۸\nثبت نام کنید")))
        .when(k == 1, F.concat(F.lit("گالری "), name, F.lit("\nساعات کاری: هر روز 10:00")))
        .when(k == 2, "کارگاه سفال هفته گذشته برگزار شد")
        .when(k == 3, F.concat(F.lit('Concert "'), name, F.lit('" on friday 7 pm, tickets for free')))
        .when(k == 4, F.concat(F.lit("کلاسیک رویدادهای "), name))
        .otherwise("An exhibition. https://x.example/register/ticket")
    )


@query("x_classify_bilingual", "select o_orderkey, case o_orderkey % 6 when 0 then 'event' when 1 then 'place' when 3 then 'event' else 'other' end kind, case o_orderkey % 6 when 2 then 'non_event: retrospective_without_new_attendance' end guard from orders")
def classify_bilingual(t):
    rows = t.orders.select("o_orderkey", bilingual().alias("txt")).withColumn("s", analysis.signals(F.col("txt")))
    return rows.select("o_orderkey", analysis.classify(F.col("txt"), F.col("s")).alias("kind"), analysis.guard(F.col("txt")).alias("guard"))


_KINDS = """select o_orderkey, case o_orderkey % 6 when 0 then 'attendance,date,event_strong,named_event,time' when 1 then 'place_context,place_term,time' when 2 then 'event_strong,retrospective' when 3 then 'date,event_strong,named_event,price,registration,time' when 5 then 'event_strong,url' else '' end kinds,
  case o_orderkey % 6 when 0 then 7.5 when 1 then 1.0 when 2 then -2.0 when 3 then 8.5 when 5 then 2.0 else 0.0 end::double event_score from orders"""


@query("x_signals", _KINDS)
def signals_of(t):
    """Kinds of signals and the score of an event; where one stands is tested on hand-made lines."""
    rows = t.orders.select("o_orderkey", analysis.signals(bilingual()).alias("s"))
    return rows.select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(F.transform("s", lambda x: x["kind"]))), ",").alias("kinds"), analysis.score(F.col("s"))[0].cast("double").alias("event_score"))
