"""Queries that reconcile readings of a schedule, with orders as events and lines as what is said of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import reconciliation as rc
from tessera.operators import recurrence
from tessera.plans.registry import query


def _orders_with(t, sittings):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("ship")).groupBy("o_orderkey", "l_linenumber").agg(F.min("ship").alias("ship"))
    per = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_set(sittings)).alias("said"), F.min("ship").alias("first"))
    return t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(per, "o_orderkey", "left")


@query("n_reconcile", """with p as (select o_orderkey k, o_orderdate::date as day, case when o_orderkey % 2 = 0 then '18:00' end t from orders),
l as (select distinct l_orderkey k, l_linenumber n from lineitem),
s as (select distinct p.k, p.day + (n % 3)::int as day, case when n <= 3 then '18:00' end t from l join p using (k)),
c as (select p.k, (select count(*) from s where s.k = p.k) n, exists (select 1 from s where s.k = p.k and s.day = p.day and (p.t is null or s.t = p.t)) by_s,
  not exists (select 1 from s where s.k = p.k and not (s.day = p.day and (s.t is null or coalesce(s.t = p.t, false)))) by_p,
  (select count(*) from s where s.k = p.k and s.day = p.day and s.t is not distinct from p.t) same from p)
select k o_orderkey, case when n = 0 then 'single' when by_s then case when n = 1 then 'single' else 'discrete' end when by_p then 'single' else 'conflict' end kind,
  (case when n = 0 then 1 when by_s then n when by_p then 1 else n + 1 - same end)::bigint n_sittings, case when n = 0 then 'unresolved_schedule' when by_s or by_p then '' else 'schedule_conflict' end codes from c""")
def reconcile(t):
    """An order's day, with a clock on every second, against days and clocks of its lines."""
    rows = _orders_with(t, F.struct((F.col("l_linenumber") % 3).cast("int").alias("plus"), F.when(F.col("l_linenumber") <= 3, "18:00").alias("t")))
    primary = rc.reading(F.array(rc.sitting(occurrence_id=F.lit("p"), start_date=F.col("day"), start_time=F.when(F.col("o_orderkey") % 2 == 0, "18:00"), timezone=F.lit("UTC"))), schedule_kind=F.lit("single"), timezone=F.lit("UTC"))
    said = F.transform("said", lambda x: rc.sitting(occurrence_id=F.lit("s"), start_date=F.date_add("day", x["plus"]), start_time=x["t"], timezone=F.lit("UTC")))
    n = F.coalesce(F.size("said"), F.lit(0))
    schedule = rc.reading(said, schedule_kind=F.when(n == 1, "single").when(n > 1, "discrete").otherwise("unknown"), timezone=F.lit("UTC"))
    got = rows.select("o_orderkey", rc.reconciled(primary, schedule).alias("r"))
    return got.select("o_orderkey", F.col("r.schedule_kind").alias("kind"), F.size("r.occurrences").cast("long").alias("n_sittings"), F.array_join("r.diagnostics", ",").alias("codes"))


@query("n_schedule_driver", """with l as (select l_orderkey k, l_linenumber n, min(l_shipdate)::date as day from lineitem group by all),
s as (select k, count(*) n, min(day) as first, max(day) as last from l group by k)
select o_orderkey, case when n is null then 'single' when o_orderkey % 3 = 0 then 'conflict' when n = 1 then 'single' else 'discrete' end kind, (case when n is null then 1 when o_orderkey % 3 = 0 then n + 1 else n end)::bigint n_sittings,
  case when n is null then 'embedded_sessions_absent' when o_orderkey % 3 = 0 then 'schedule_conflict' else '' end codes, case when n is null then o_orderdate::date when o_orderkey % 3 = 0 then first else first end as first_day
from orders left join s on k = o_orderkey""")
def schedule_driver(t):
    """The first day a page shows, then the sessions it embeds: one for each line, two hours long; every third page shows a day that no session has."""
    rows = _orders_with(t, F.struct("ship", "l_linenumber"))
    none = F.lit(None).cast("string")
    session = lambda x: F.struct(
        x["l_linenumber"].cast("string").alias("session_id"), none.alias("timeslot_id"), F.concat(x["ship"].cast("string"), F.lit("T18:00:00Z")).alias("start_iso"), none.alias("end_iso"), F.lit("2").alias("duration_hours"), none.alias("price_per_person"),
        none.alias("unit_price"), none.alias("host_discount_pct"), none.alias("platform_discount_pct"), F.lit(None).cast("long").alias("remaining_seats"), F.lit(None).cast("boolean").alias("sold_out"), none.alias("schema_status"),
    )
    shown = F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.date_add("first", 4000)).otherwise(F.col("first")), F.col("day"))
    primary = rc.reading(F.array(rc.sitting(occurrence_id=F.lit("p"), start_date=shown, timezone=F.lit("UTC"))), schedule_kind=F.lit("single"), timezone=F.lit("UTC"))
    sessions = F.when(F.col("said").isNotNull(), rc.of_sessions(F.transform("said", session), F.lit("UTC")))
    got = rows.select("o_orderkey", rc.driven(primary, None, sessions, F.array(F.lit("embedded_sessions_absent"))).alias("r"))
    return got.select("o_orderkey", F.col("r.schedule_kind").alias("kind"), F.size("r.occurrences").cast("long").alias("n_sittings"), F.array_join("r.diagnostics", ",").alias("codes"), F.array_min(F.transform("r.occurrences", lambda o: o["start_date"])).alias("first_day"))


@query("n_covered_rows", """with a as (select l_orderkey k, l_linenumber n, case when l_linenumber % 2 = 1 then l_returnflag end f, case when l_linenumber % 3 > 0 then l_suppkey % 5 end m, case when l_linenumber % 5 > 0 then l_linestatus end s from lineitem),
b as (select distinct l_orderkey k, l_returnflag f, l_suppkey % 5 m, l_linestatus s from lineitem where l_linenumber <= 2)
select k, count(*) n_covered from a where exists (select 1 from b where b.k = a.k and (a.f is null or a.f = b.f) and (a.m is null or a.m = b.m) and (a.s is null or a.s = b.s)) group by k""")
def covered_rows(t):
    """Lines that state some of their flag, supplier class and status, covered by one of their order's first two."""
    n = F.col("l_linenumber")
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.when(n % 2 == 1, F.col("l_returnflag")).alias("f"), F.when(n % 3 > 0, F.col("l_suppkey") % 5).alias("m"), F.when(n % 5 > 0, F.col("l_linestatus")).alias("s"))
    by = t.lineitem.where(n <= 2).select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), (F.col("l_suppkey") % 5).alias("m"), F.col("l_linestatus").alias("s"))
    return rc.covered(rows, by, ["k"], ["f", "m", "s"]).groupBy("k").agg(F.count("*").alias("n_covered"))


@query("n_recurrence", """with w as (select o_orderkey k, o_orderdate::date as day, case when o_orderkey % 4 = 0 then 'FREQ=DAILY' when o_orderkey % 4 < 3 then 'FREQ=WEEKLY;BYDAY=' || upper(strftime(o_orderdate, '%a')[1:2]) end r from orders),
c as (select k, r, d::date d from w, generate_series(day, day + interval 30 day, interval 1 day) x(d) where r = 'FREQ=DAILY' or (k % 4 = 1 and dayofweek(d) = dayofweek(day)) or (k % 4 = 2 and dayofweek(d) = dayofweek(day)))
select w.k o_orderkey, w.r as rule, case when w.k % 4 < 3 then '18:30' end start_time, case when w.r is not null then (select count(*) from c where c.k = w.k) end n_days, (select max(d) from c where c.k = w.k) last_day from w""")
def recurrence_rules(t):
    """Every day, and every weekday of the order's day in two wordings, for a month; a fourth recurs without a rule."""
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    names = F.array(*map(F.lit, ("دوشنبه", "سه‌شنبه", "چهارشنبه", "پنجشنبه", "جمعه", "شنبه", "یکشنبه")))
    name = F.element_at(names, F.weekday(day) + 1)
    text = (
        F.when(k == 0, "هر روز ساعت ۱۸:۳۰").when(k == 1, F.concat(F.lit("زمان: هر "), name, F.lit(" ساعت 18:30"))).when(k == 2, F.concat(name, F.lit("‌ها 18:30"))).otherwise("every month, ask us")
    )
    rows = t.orders.select("o_orderkey", day.alias("day"), recurrence.recurring(text, F.lit("UTC")).alias("r"))
    days = recurrence.instances(F.col("r.recurrence_rule"), F.col("day"), F.date_add("day", 30))
    return rows.withColumn("d", days).select("o_orderkey", F.col("r.recurrence_rule").alias("rule"), F.col("r.start_time").alias("start_time"), F.when(F.col("d").isNotNull(), F.size("d").cast("long")).alias("n_days"), F.array_max("d").alias("last_day"))


@query("n_recurring_instants", """with s as (select o_orderkey k, o_orderdate::date as day, o_orderdate::date + (7 * i)::int d from orders, range(0, 5) x(i))
select k o_orderkey, count(*) n, count(*) filter (where month(d) in (3, 10) and day(d) >= 25 and dayofweek(d) = 0) n_ambiguous,
  min(case when not (month(d) in (3, 10) and day(d) >= 25 and dayofweek(d) = 0) then (d + interval 2 hour + interval 30 minute) - case when (month(d) between 4 and 9) or (month(d) = 3 and day(d) - dayofweek(d) >= 25) or (month(d) = 10 and day(d) - dayofweek(d) < 25) then interval 2 hour else interval 1 hour end end)::timestamp first_instant
from s where year(d) >= 1996 group by k""")
def recurring_instants(t):
    """Five weekly nights at half past two in a zone with daylight saving, from 1996 on: the nights when clocks change have no instant."""
    day = F.to_date("o_orderdate")
    rule = F.concat(F.lit("FREQ=WEEKLY;BYDAY="), F.upper(F.substring(F.date_format(day, "EEE"), 1, 2)))
    days = F.filter(recurrence.instances(rule, day, F.date_add(day, 34)), lambda d: F.year(d) >= 1996)
    made = t.orders.select("o_orderkey", recurrence.sittings(days, F.lit("02:30"), F.lit(None).cast("string"), F.lit("Europe/Berlin")).alias("s")).where("size(s) > 0")
    unsafe = F.filter("s", lambda o: F.array_contains(o["diagnostics"], "ambiguous_local_time"))
    return made.select("o_orderkey", F.size("s").cast("long").alias("n"), F.size(unsafe).cast("long").alias("n_ambiguous"), F.array_min(F.transform("s", lambda o: o["starts_at"])).alias("first_instant"))
