"""Posts made of orders and their lines: grouping of fragments, wording of dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import analysis, wording
from tessera.operators import grouping
from tessera.plans.registry import query

#: A slide for each line of an order: a named workshop, a day, a price, the workshop of another supplier, or prose.
NAMES = ("سفال", "نقاشی", "عکاسی")
_SLIDES = f"""lines as (select l_orderkey k, l_linenumber slot, min(l_partkey) p, min(l_suppkey) s, min(l_shipdate)::date as day from lineitem group by all),
f as (select k, slot, case when slot = 1 or p % 5 = 2 then ({list(NAMES)})[s % 3 + 1] end title, case when slot > 1 and p % 5 = 0 then day::varchar end as day, case when slot > 1 and p % 5 = 1 then s % 4 end price from lines),
n as (select *, row_number() over (partition by k order by slot) i from f)"""
#: The rules for such slides: support joins the anchor beside it unless it states another day or price, a title that was there is provenance.
_GROUPED = f"""with recursive {_SLIDES},
w as (
  select k, 0::bigint i, 0 now, -9 slot, []::struct(title varchar, "day" varchar, price bigint, members integer[], gone integer[])[] g from (select distinct k from n)
  union all
  select k, i, case when joins then now when t > 0 then t else len(g) + 1 end, slot,
    case when joins then list_concat(g[:now - 1], [{{'title': g[now].title, 'day': coalesce(g[now].day, x.day), 'price': coalesce(g[now].price, x.price), 'members': list_append(g[now].members, slot), 'gone': g[now].gone}}], g[now + 1:])
      when t > 0 then list_concat(g[:t - 1], [{{'title': g[t].title, 'day': g[t].day, 'price': g[t].price, 'members': g[t].members, 'gone': list_append(g[t].gone, slot)}}], g[t + 1:])
      else list_append(g, {{'title': x.title, 'day': x.day, 'price': x.price, 'members': [slot], 'gone': []::integer[]}}) end
  from (
    select y.*, w.now, w.g, coalesce(w.now > 0 and y.slot = w.slot + 1 and g[now].title is not null and (y.day is not null or y.price is not null) and coalesce(g[now].day = y.day, true) and coalesce(g[now].price = y.price, true), false) joins,
      coalesce(list_max(list_filter(range(1, len(g) + 1), lambda j: g[j].title = y.title)), 0)::int t
    from w join n y on y.k = w.k and y.i = w.i + 1) x),
last as (select k, max_by(g, i) g from w group by k)
select k, j - 1 as unit, array_to_string(g[j].members, ',') fragments, array_to_string(g[j].gone, ',') collapsed from last, range(1, 99) t(j) where j <= len(g)"""


@query("e_grouping", _GROUPED.replace("select k, j - 1 as unit", "select k, (j - 1)::varchar unit"))
def grouped(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.to_date(F.min("l_shipdate")).alias("day"))
    name = F.concat(F.lit("کارگاه "), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("s") % 3 + 1).cast("int")))
    kind = F.col("p") % 5
    text = (
        F.when((F.col("l_linenumber") == 1) | (kind == 2), name).when(kind == 0, F.concat(F.lit("تاریخ: "), F.col("day").cast("string")))
        .when(kind == 1, F.concat(F.lit("قیمت: "), (F.col("s") % 4 + 1).cast("string"), F.lit("00 تومان"))).otherwise("A different adventure awaits")
    )
    slides = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("string").alias("fragment_id"), F.lit(grouping.SLIDE).alias("kind"), F.col("l_linenumber").alias("slot"), text.alias("text"), F.lit(False).alias("failed"))
    found = grouping.units(grouping.profiled(slides, "k"), "k")
    return found.select("k", "unit", F.array_join("fragments", ",").alias("fragments"), F.array_join("collapsed", ",").alias("collapsed"))


@query("e_fragment_profile", f"with {_SLIDES} select k, slot, title is not null anchor, title is null and (day is not null or price is not null) support, day date_wording, case when price is not null then (price + 1) || '00 تومان' end price_wording from f")
def fragment_profile(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.to_date(F.min("l_shipdate")).alias("day"))
    name = F.concat(F.lit("کارگاه «"), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("s") % 3 + 1).cast("int")), F.lit("»"))
    kind = F.col("p") % 5
    text = (
        F.when((F.col("l_linenumber") == 1) | (kind == 2), name).when(kind == 0, F.concat(F.lit("زمان برگزاری: "), F.col("day").cast("string")))
        .when(kind == 1, F.concat(F.lit("هزینه شرکت‌: "), (F.col("s") % 4 + 1).cast("string"), F.lit("00 تومان"))).otherwise("A different adventure awaits")
    )
    rows = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("slot"), F.lit(grouping.SLIDE).alias("kind"), text.alias("text"))
    p = grouping.read_once(rows, "k", p=grouping.profile)
    return p.select("k", "slot", "p.anchor", "p.support", F.get("p.times", 0)["wording"].alias("date_wording"), F.col("p.facts.price").alias("price_wording"))


@query("x_source_date_text", """select o_orderkey, case o_orderkey % 6
  when 0 then strftime(o_orderdate, '%B %-d, %Y') || ' at 18:30' when 1 then strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'ساعت ' || (o_orderkey % 24) || ':30'
  when 2 then lower(strftime(o_orderdate, '%A')) when 3 then strftime(o_orderdate, '%-d') || ' تا ' || (day(o_orderdate) + 2) || ' مهر ' || strftime(o_orderdate, '%Y')
  when 4 then strftime(o_orderdate, '%B %-d, %Y') || chr(10) || strftime(o_orderdate + interval 40 day, '%B %-d, %Y') end wording from orders""")
def source_date_text(t):
    """Dates in prose, on lines beside their clocks, as ranges, and two that compete; a sixth of the texts has none."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    english = lambda d: F.date_format(d, "MMMM d, yyyy")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Concert "), english(day), F.lit(" at 18:30, join us")))
        .when(k % 6 == 1, F.concat(F.lit("کارگاه سفال\nتاریخ: "), F.date_format(day, "yyyy-MM-dd"), F.lit("\nساعت "), (k % 24).cast("string"), F.lit(":30\nثبت نام")))
        .when(k % 6 == 2, F.concat(F.lit("every "), F.lower(F.date_format(day, "EEEE")), F.lit(" we meet")))
        .when(k % 6 == 3, F.concat(F.lit("نمایشگاه از "), F.date_format(day, "d"), F.lit(" تا "), (F.dayofmonth(day) + 2).cast("string"), F.lit(" مهر "), F.date_format(day, "yyyy"), F.lit("، گالری نگاه")))
        .when(k % 6 == 4, F.concat(F.lit("Festival "), english(day), F.lit(" and "), english(F.date_add(day, 40)))).otherwise(F.concat(F.lit("order "), k.cast("string")))
    )
    return t.orders.select("o_orderkey", text.alias("text")).select("o_orderkey", wording.source_date(F.col("text"), analysis.signals(F.col("text"))).alias("wording"))
