"""Queries that resolve groups to events, with an order's lines as the members of a group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import resolution
from tessera.plans.registry import query

_MEMBERS = """l as (select l_orderkey k, l_linenumber n, min(l_partkey) p, min(l_suppkey) s, min(l_shipdate)::date ship, min(l_quantity) q from lineitem group by all),
m as (select k, n, lpad(n::varchar, 2, '0') c, 'Night ' || (p % 2) title, case when s % 3 > 0 then 'city ' || (s % 2) end city, case when p % 3 > 0 then case when q > 25 then 10 else 5 end end amount, case when p % 3 > 0 then 'USD' end currency,
  (min(ship) over (partition by k)) + case when p % 7 = 0 then 1 else 0 end d, case when p % 4 = 0 then '18:00' end t, s % 5 = 0 rel, (min(ship) over (partition by k)) + (n % 2)::int day0, p % 6 seats from l)"""
_EVENTS = f"""with {_MEMBERS},
a as (select *, rel or not bool_or(rel) over (partition by k) strong from m),
u as (select k, count(distinct title) nt, min(title) title, count(distinct city) nc, min(city) city, count(distinct amount) np, min(amount) amount, min(currency) currency, count(distinct d) filter (strong) nd, min(d) filter (strong) ud, max(t) filter (strong) ut, count(distinct n % 2) n_occ from a group by k),
c as (select u.*, u.nd = 1 and exists (select 1 from a where a.k = u.k and a.strong and a.t is not distinct from u.ut) chosen,
  exists (select 1 from a where a.k = u.k and (a.d <> u.ud or a.t <> u.ut)) against, exists (select 1 from a where a.k = u.k and a.t is not null and u.ut is null) more from u)
select k, case when nt = 1 then title end title, case when nc = 1 then city end city, case when np = 1 then amount end::double price_amount, case when np = 1 then currency end currency,
  case when chosen and n_occ = 1 then ud end start_date, case when chosen and n_occ = 1 then ut end start_time, case when n_occ > 1 then 'discrete' else 'single' end schedule_kind, n_occ::bigint n_occurrences,
  array_to_string(list_sort(list_filter([case when nt > 1 then 'field_conflict:title' end, case when nt > 1 then 'missing_canonical_title:title' end, case when nc > 1 then 'field_conflict:city' end, case when np > 1 then 'field_conflict:price' end,
    case when not chosen then 'unresolved_temporal_interpretations:temporal' end, case when chosen and against then 'stronger_explicit_temporal_selected:temporal' end, case when chosen and more then 'partial_temporal_not_combined:temporal' end], lambda x: x is not null)), ',') diagnostics from c"""
_SITTINGS = f"""with {_MEMBERS} select k, (n % 2)::varchar session_id, min(day0) start_date, min(t) start_time, case when count(distinct seats) = 1 then min(seats) end::bigint remaining_seats, string_agg(c, ',' order by c) candidates,
  case when count(distinct seats) > 1 then 'occurrence_field_conflict:remaining_seats' else '' end diagnostics from m group by k, n % 2"""


def members(t):
    lines = t.lineitem.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.to_date(F.min("l_shipdate")).alias("ship"), F.min("l_quantity").alias("q"))
    rows = lines.where("k is not null").withColumn("first", F.min("ship").over(Window.partitionBy("k")))
    p, s, n = F.col("p"), F.col("s"), F.col("n")
    none = lambda kind: F.lit(None).cast(kind)
    clock = F.when(p % 4 == 0, "18:00")
    sitting = F.struct(
        F.date_add("first", (n % 2).cast("int")).alias("start_date"), none("date").alias("end_date"), clock.alias("start_time"), none("string").alias("end_time"), none("timestamp").alias("starts_at"), none("timestamp").alias("ends_at"), F.lit("UTC").alias("timezone"), F.lit("day").alias("date_precision"),
        (n % 2).cast("string").alias("session_id"), none("string").alias("timeslot_id"), none("decimal(18,4)").alias("price_amount"), none("string").alias("currency"), none("string").alias("availability_text"), (p % 6).cast("long").alias("remaining_seats"), none("boolean").alias("enabled"), F.array().alias("diagnostics"),
    ).cast(resolution.OCCURRENCE)
    priced = p % 3 > 0
    return rows.select(
        "k", F.lpad(n.cast("string"), 2, "0").alias("candidate_id"), F.concat(F.lit("Night "), (p % 2).cast("string")).alias("title"), F.when(s % 3 > 0, F.concat(F.lit("city "), (s % 2).cast("string"))).alias("city"),
        F.when(priced, F.when(F.col("q") > 25, 10).otherwise(5)).cast("decimal(18,4)").alias("price_amount"), F.when(priced, "USD").alias("currency"), F.date_add("first", F.when(p % 7 == 0, 1).otherwise(0)).alias("start_date"), none("date").alias("end_date"), clock.alias("start_time"),
        none("string").alias("end_time"), none("timestamp").alias("starts_at"), none("timestamp").alias("ends_at"), F.lit("UTC").alias("timezone"), F.lit("day").alias("date_precision"), (s % 5 == 0).alias("reliable"), F.lit("single").alias("schedule_kind"), none("string").alias("recurrence_rule"), F.array(sitting).alias("occurrences"),
    )


@query("e_resolution", _EVENTS)
def resolved_events(t):
    events, _ = resolution.resolved(members(t), "k", F.col("candidate_id"), ["title", "city"], ("title",))
    return events.select("k", "title", "city", F.col("price_amount").cast("double").alias("price_amount"), "currency", "start_date", "start_time", "schedule_kind", "n_occurrences", F.array_join("diagnostics", ",").alias("diagnostics"))


@query("e_resolved_sittings", _SITTINGS)
def resolved_sittings(t):
    sittings = resolution.merged(members(t), "k")
    return sittings.select("k", "session_id", "start_date", "start_time", "remaining_seats", F.array_join("candidate_ids", ",").alias("candidates"), F.array_join("diagnostics", ",").alias("diagnostics"))
