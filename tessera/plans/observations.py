"""Queries on the observation log: revisions, change detection, joins of observations and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import relational
from tessera.plans.registry import query


@query("s_latest_revision", "select user_id, max_by(event_type, {'a': ts, 'b': event_id}) event_type, max_by(value, {'a': ts, 'b': event_id}) value, strftime(min(ts), '%Y-%m-%d %H:%M:%S') first_seen from events group by user_id")
def latest_revision(t):
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("v")
    return t.events.groupBy("user_id").agg(last, F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_seen")).select("user_id", "v.event_type", "v.value", "first_seen")


_CHANGE = "select event_id, case when p is null then 'new' when p = event_type then 'existing' else 'changed' end change from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) p from events)"


@query("s_append_change_detect", f"select change, count(*) n from ({_CHANGE}) group by 1")
def append_change_detect(t):
    return relational.change_class(t.events, "user_id", ["ts", "event_id"], "event_type").groupBy("change").agg(F.count("*").alias("n"))


@query("w_change_class", _CHANGE)
def change_class(t):
    return relational.change_class(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "change")


@query("s_insert_if_absent", "select min(doc_id) doc_id, text from documents where text not in (select text from documents where doc_id % 10 = 0) group by text")
def insert_if_absent(t):
    stored = t.documents.where("doc_id % 10 = 0").select("text").distinct()
    return relational.insert_if_absent(t.documents, stored, "text", ["doc_id"]).select("doc_id", "text")


@query("s_json_roundtrip", "select event_id, json_extract_string(props, '$.k') k, json_extract_string(props, '$.k') is not null valid from events")
def json_roundtrip(t):
    back = F.from_json(F.to_json(F.from_json("props", "k string")), "k string")["k"]
    return t.events.select("event_id", back.alias("k"), back.isNotNull().alias("valid"))


@query("s_embedded_json", "select coalesce(json_extract_string(props, '$.k'), 'null') k, count(*) n from events group by 1")
def embedded_json(t):
    return t.events.groupBy(F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")).alias("k")).agg(F.count("*").alias("n"))


@query("s_value_shape_report", "select case when k is null then 'null' when k = '' then 'empty' when regexp_matches(k, '^[0-9]+$') then 'integer' when regexp_matches(k, '^[A-Za-z0-9_-]+$') then 'token' else 'text' end form, count(*) n from (select json_extract_string(props, '$.k') k from events) group by 1")
def value_shape_report(t):
    from tessera.functions import text

    return t.events.select(text.string_form(F.get_json_object("props", "$.k")).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query("s_registry_overlay", "select s_suppkey, coalesce(n_name, 'local') name, s_acctbal > 0 and s_suppkey % 9 <> 0 enabled, s_suppkey % 9 = 0 archived from supplier left join nation on n_nationkey = s_nationkey and s_suppkey % 4 <> 0")
def registry_overlay(t):
    base = t.nation.select(F.col("n_nationkey"), F.col("n_name"))
    archived = F.col("s_suppkey") % 9 == 0
    joined = t.supplier.join(base, (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("s_suppkey") % 4 != 0), "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("local")).alias("name"), ((F.col("s_acctbal") > 0) & ~archived).alias("enabled"), archived.alias("archived"))


@query("s_intake_parse", "select page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') host, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') path, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') slug from pages")
def intake_parse(t):
    from tessera.functions import keys

    url = F.col("url")
    return t.pages.select("page_id", keys.host(url).alias("host"), keys.path(url).alias("path"), keys.slug(F.try_parse_url(url, F.lit("HOST"))).alias("slug"))


ROBOTS = [("/en/1", False), ("/en/12", True), ("/fr", False), ("/", True)]


@query("s_robots_allows", "select page_id, coalesce(max_by(allow, {'n': length(rule), 'a': allow}), true) allowed from (select page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) path from pages) left join (values ('/en/1', false), ('/en/12', true), ('/fr', false), ('/', true)) r(rule, allow) on starts_with(path, rule) group by page_id")
def robots_allows(t):
    from tessera.sources import robots

    return robots.allows(t.pages, t.spark.createDataFrame(ROBOTS, "rule string, allow boolean"))


@query("s_bounded_collect", "select page_id, host from (select page_id, host, row_number() over (partition by host order by page_id) n from (select page_id, regexp_extract(url, '([a-z]+)(:|/|$)[^.]*$', 1) host from (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) url from pages))) where n <= 5")
def bounded_collect(t):
    top = F.regexp_extract(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), r"([a-z]+)(:|/|$)[^.]*$", 1)
    return relational.first_k(t.pages.select("page_id", top.alias("host")), ["host"], ["page_id"], 5)


@query("s_dedupe_prefer_bound", "select event_id, user_id from (select *, row_number() over (partition by user_id order by (event_type = 'purchase') desc, ts, event_id) n from events) where n = 1 order by user_id limit 20")
def dedupe_prefer_bound(t):
    one = relational.first_k(t.events, ["user_id"], [F.desc(F.col("event_type") == "purchase"), "ts", "event_id"], 1)
    return one.orderBy("user_id").limit(20).select("event_id", "user_id")


@query("s_fallback_choose", "select source, coalesce(min(case when usable then doc_id end), max_by(doc_id, {'l': n_chars, 'd': doc_id})) doc_id from (select *, n_chars between 1000 and 1200 usable from documents) group by source")
def fallback_choose(t):
    usable = F.col("n_chars").between(1000, 1200)
    return t.documents.groupBy("source").agg(F.coalesce(F.min(F.when(usable, F.col("doc_id"))), F.max_by("doc_id", F.struct("n_chars", "doc_id"))).alias("doc_id"))


@query("s_even_sampling", "select o_orderkey, i, round_even(i * (o_orderkey % 9000 + 100) / 5.0, 0)::bigint place from orders, range(0, 6) r(i)")
def even_sampling(t):
    last = F.col("o_orderkey") % 9000 + 100
    return t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("i"), last.alias("_l")).select("o_orderkey", "i", F.bround(F.col("i") * F.col("_l") / 5.0, 0).cast("long").alias("place"))


@query("s_csv_guard", "select c_custkey, case when regexp_matches(v, '^\\s*[=+\\-@]') then '''' || v else v end cell from (select c_custkey, (case when c_custkey % 3 = 0 then '=' when c_custkey % 3 = 1 then ' -' else '' end) || c_name v from customer)")
def csv_guard(t):
    from tessera.functions import text

    k = F.col("c_custkey") % 3
    value = F.concat(F.when(k == 0, "=").when(k == 1, " -").otherwise(""), F.col("c_name"))
    return t.customer.select("c_custkey", text.csv_guard(value).alias("cell"))


@query("s_overflow_chunks", "select doc_id, i::int part, sha256(substr(text, i * 3200 + 1, 3200)) chunk_hash from documents, unnest(range(0, greatest(1, (length(text) + 3199) // 3200))) r(i)")
def overflow_chunks(t):
    from tessera.sources import sinks

    return sinks.chunks(t.documents, "doc_id", "text", 3200).select("doc_id", "part", F.sha2("chunk", 256).alias("chunk_hash"))


@query("s_manifest_counts", "select 'documents' name, count(*) n from documents union all select 'pages', count(*) from pages union all select 'conversations', count(*) from conversations")
def manifest_counts(t):
    from tessera.sources import sinks

    return sinks.manifest({"documents": t.documents, "pages": t.pages, "conversations": t.conversations})


@query("s_hashtags_mentions", "select turn_id, tags, mentions from (select conv_id * 1000 + turn turn_id, array_to_string(regexp_extract_all(x, '#(\\w+)', 1), ',') tags, array_to_string(regexp_extract_all(x, '@(\\w+)', 1), ',') mentions from (select conv_id, turn, case when turn = 0 then '#a' || role || ' @u' || conv_id else '#b' end x from conversations))")
def hashtags_mentions(t):
    from tessera.sources import pages

    x = F.when(F.col("turn") == 0, F.concat(F.lit("#a"), "role", F.lit(" @u"), F.col("conv_id").cast("string"))).otherwise("#b")
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.array_join(pages.marked(x, "#"), ",").alias("tags"), F.array_join(pages.marked(x, "@"), ",").alias("mentions"))


@query("s_link_grammar", "select page_id, len(regexp_extract_all(html, 'href=\"([^\"#]+)\"', 1))::bigint n_links, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"#]+)\"', 1)))::bigint n_distinct from pages")
def link_grammar(t):
    from tessera.sources import pages

    links = pages.links(F.col("html"))
    return t.pages.select("page_id", F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_distinct"))


@query("s_html_text")
def html_text(t):
    from tessera.sources import pages

    return pages.with_text(t.pages).select("page_id", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@query("s_link_discovery", """with h as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) origin, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#]+)"', 1))) href from pages)
select distinct page_id, lower(origin) || href link from h where starts_with(href, '/')""")
def link_discovery(t):
    from tessera.sources import pages

    return pages.discovered(t.pages)


@query("w_newest_per_identity", "select user_id, event_type, event_id, copies from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) n, count(*) over (partition by user_id, event_type) copies from events) where n = 1")
def newest_per_identity(t):
    keyed = t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("copies"))
    return keyed


@query("w_anchor", "select o_custkey, min_by(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) anchor from orders group by o_custkey")
def anchor(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("anchor"))


@query("w_ordinal_tail", "select o_orderkey, case when o_orderstatus = 'O' then row_number() over (partition by o_custkey, o_orderstatus = 'O' order by o_orderdate, o_orderkey) else count(*) filter (where o_orderstatus = 'O') over (partition by o_custkey) + 1 end ordinal from orders")
def ordinal_tail(t):
    seen = F.col("o_orderstatus") == "O"
    nth = F.row_number().over(Window.partitionBy("o_custkey", seen).orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_orderkey", F.when(seen, nth).otherwise(F.count_if(seen).over(Window.partitionBy("o_custkey")) + 1).cast("long").alias("ordinal"))


@query("w_last_k", "select event_id from (select event_id, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n <= 20")
def last_k(t):
    return relational.first_k(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("event_id")


@query("w_next_session", "select o_custkey, min_by(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) next_order, count(*) remaining from orders where o_orderdate >= timestamp '1998-06-15' group by 1")
def next_session(t):
    return t.orders.where(F.col("o_orderdate") >= F.lit("1998-06-15").cast("timestamp_ntz")).groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("next_order"), F.count("*").alias("remaining"))


@query("w_adjacency", "select conv_id, turn, coalesce(lag(turn) over (partition by conv_id order by turn) + 1 = turn, false) adjacent from conversations")
def adjacency(t):
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.coalesce(before + 1 == F.col("turn"), F.lit(False)).alias("adjacent"))


@query("w_islands", "select user_id, island, count(*) n, min(event_id) first_event from (select *, sum(b) over (partition by user_id order by ts, event_id)::bigint island from (select *, case when lag(event_type) over (partition by user_id order by ts, event_id) = event_type then 0 else 1 end b from events)) group by 1, 2")
def islands(t):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = relational.islands(t.events, ["user_id"], ["ts", "event_id"], F.lag("event_type").over(own) != F.col("event_type"))
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("w_keep_unless_changed", "select event_id, case when lag(event_type) over w = event_type then lag(event_id) over w else event_id end decided_by from events window w as (partition by user_id order by ts, event_id)")
def keep_unless_changed(t):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.when(F.lag("event_type").over(own) == F.col("event_type"), F.lag("event_id").over(own)).otherwise(F.col("event_id")).alias("decided_by"))


@query("w_monotone_latest", "select user_id, max_by(event_type, {'a': ts, 'b': event_id}) payload, strftime(max(ts), '%Y-%m-%d %H:%M:%S') started_at from events where event_type <> 'error' group by user_id")
def monotone_latest(t):
    last = relational.latest(t.events.where("event_type <> 'error'"), ["user_id"], ["ts", "event_id"], ["event_type", "ts"])
    return last.select("user_id", F.col("event_type").alias("payload"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("w_sibling_overlap", "select user_id, count(*) filter (where nxt < ts + interval 1 hour) n_overlaps from (select user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) nxt from events) group by 1")
def sibling_overlap(t):
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("nxt", nxt).groupBy("user_id").agg(F.count_if(F.col("nxt") < F.col("ts") + F.expr("interval 1 hour")).alias("n_overlaps"))
