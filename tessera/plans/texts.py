"""Queries on text, dates and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import temporal, text
from tessera.plans.registry import query

ARABIC = "translate(%s, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩يىكةأإآٱ', '01234567890123456789ییکهاااا')"
GENERIC = "['event','events','workshop','concert','exhibition','festival','the','a','an','of','and','in','at','for']"  # those in Latin letters
#: An announcement line in Persian letters and digits made of a number, the same in both engines.
WORDING_SQL = "translate(o_orderkey::varchar, '0123456789', '۰۱۲۳۴٥٦٧۸۹') || ' كارگاه Workshop ' || o_orderpriority"


def wording():
    return F.concat(F.translate(F.col("o_orderkey").cast("string"), "0123456789", "۰۱۲۳۴٥٦٧۸۹"), F.lit(" كارگاه Workshop "), "o_orderpriority")


@query("t_normalize", f"select o_orderkey, lower({ARABIC % WORDING_SQL}) folded from orders")
def normalize(t):
    return t.orders.select("o_orderkey", text.normalize(wording()).alias("folded"))


@query("t_fold", f"select o_orderkey, trim(regexp_replace(lower({ARABIC % WORDING_SQL}), '\\s+', ' ', 'g')) folded from orders")
def fold(t):
    return t.orders.select("o_orderkey", text.fold(wording()).alias("folded"))


@query("t_text_key")
def text_key(t):
    """Over every document; DuckDB has no NFKC, so tests compare with a plain version."""
    return t.documents.select("doc_id", F.sha2(text.text_key(F.col("text")), 256).alias("key_hash"))


@query("t_tokenize", "select doc_id, len(w)::bigint n, sha256(array_to_string(w, ' ')) token_hash from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents)")
def tokenize(t):
    w = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"), F.sha2(F.array_join(w, " "), 256).alias("token_hash"))


@query("t_title_key", f"select p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '' and not list_contains({GENERIC}, x)))), ' ') title_key from part")
def title_key(t):
    return t.part.select("p_partkey", F.array_join(text.title_tokens(F.col("p_name")), " ").alias("title_key"))


_PAIRS = """with n as (select min(p_partkey) k, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) w from part group by p_name),
p as (select a.k a, b.k b, len(list_intersect(a.w, b.w)) s, len(list_distinct(list_concat(a.w, b.w))) u from n a join n b on a.k < b.k)
select a, b, case when s >= 2 and 100 * s >= 85 * u then 'strong' when s > 0 then 'partial' else 'different' end relation from p"""


@query("t_title_relation", _PAIRS)
def title_relation(t):
    key = text.text_key(F.col("p_name"), True)
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select("k", key.alias("n"), text.distinctive(key).alias("w"))
    pairs = names.select(F.struct("*").alias("x")).join(names.select(F.struct("*").alias("y")), F.col("x.k") < F.col("y.k"))
    return pairs.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), text.title_relation(F.col("x.n"), F.col("y.n"), F.col("x.w"), F.col("y.w")).alias("relation"))


@query("t_phrase_hits", "with v as (select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) w from benchmark) select doc_id, count(w)::bigint n_terms from (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) x from documents) left join v on v.w = x group by doc_id")
def phrase_hits(t):
    vocabulary = t.benchmark.select(F.explode(text.tokens(F.col("text"))).alias("x")).distinct()
    terms = t.documents.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("x"))
    return terms.join(vocabulary.withColumn("hit", F.lit(1)), "x", "left").groupBy("doc_id").agg(F.count("hit").alias("n_terms"))


@query("t_detect_language", f"select o_orderkey, case when o_orderkey % 2 = 0 then 'en' else case when o_orderkey % 3 = 0 then null else 'fa' end end lang from orders")
def detect_language(t):
    k = F.col("o_orderkey")
    line = F.when(k % 2 == 0, "Workshop کار").when(k % 3 == 0, "abc آبپ").otherwise("کارگاه ab")
    return t.orders.select("o_orderkey", text.detect_language(line).alias("lang"))


@query("t_lines", "select doc_id, i::int line, sha256(x) line_hash from (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from documents)")
def lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).select("doc_id", "line", F.sha2("x", 256).alias("line_hash"))


@query("t_display_text", "select doc_id, sha256(regexp_replace(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'), '^[ «»“”\",،.؛:]+|[ «»“”\",،.؛:]+$', '', 'g')) display_hash from documents")
def display_text(t):
    return t.documents.select("doc_id", F.sha2(text.display_text(F.col("text")), 256).alias("display_hash"))


@query("t_jalali_format", "with j as (select o_orderkey, (o_orderdate::date - date '1970-01-01') + 2440588 jdn from orders), y as (select *, (33 * (jdn - 1948320) + 3) // 12053 + 1 y from j), n as (select *, jdn - (365 * (y - 1) + (8 * y + 21) // 33 + 1948319) nth from y), m as (select *, case when nth <= 186 then (nth - 1) // 31 + 1 else (nth - 187) // 30 + 7 end m, case when nth <= 186 then (nth - 1) % 31 + 1 else (nth - 187) % 30 + 1 end d from n) select o_orderkey, translate(d::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' ' || ['فروردین','اردیبهشت','خرداد','تیر','مرداد','شهریور','مهر','آبان','آذر','دی','بهمن','اسفند'][m] || ' ' || translate(y::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹') jalali from m")
def jalali_format(t):
    return t.orders.select("o_orderkey", temporal.jalali_text(F.to_date("o_orderdate")).alias("jalali"))


@query("t_agreement_key", "select doc_id, sha256(regexp_replace(lower(text), '\\s+', '', 'g')) agreement_hash from documents")
def agreement_key(t):
    return t.documents.select("doc_id", F.sha2(text.agreement_key(F.col("text")), 256).alias("agreement_hash"))


@query("t_near_word", "select c_custkey, c_custkey % 4 in (0, 1) or c_custkey % 8 = 2 near from customer")
def near_word(t):
    """Readings with one character more, the same, one letter for another beyond ASCII or not, and another word."""
    k, word = F.col("c_custkey"), F.col("c_mktsegment")
    tail = F.expr("substr(c_mktsegment, 2)")
    cut = F.expr("substr(c_mktsegment, 1, length(c_mktsegment) - 1)")
    other = F.when(k % 4 == 0, cut).when(k % 4 == 1, word).when(k % 8 == 2, F.concat(F.lit("ü"), tail)).when(k % 8 == 6, F.concat(F.lit("z"), tail)).otherwise("zz")
    return t.customer.select("c_custkey", text.near_word(F.when(k % 4 == 2, F.concat(F.lit("é"), tail)).otherwise(word), other, k % 2 == 0).alias("near"))


@query("t_string_form", "select form, count(*) n from (select case when regexp_matches(v, '^[0-9]+$') then 'integer' when regexp_matches(v, '^[0-9]+\\.[0-9]+$') then 'decimal' when regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then 'date' when regexp_matches(v, '^[A-Za-z0-9_-]+$') then 'token' else 'text' end form from (select case o_orderkey % 4 when 0 then o_orderkey::varchar when 1 then o_orderstatus when 2 then strftime(o_orderdate, '%Y-%m-%d') else o_orderpriority || ' !' end v from orders)) group by 1")
def string_form(t):
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, F.col("o_orderkey").cast("string")).when(k == 1, F.col("o_orderstatus")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat("o_orderpriority", F.lit(" !")))
    return t.orders.select(text.string_form(value).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query("t_clip_page", "select doc_id, case when length(text) <= 80 then text else substr(text, 1, 79) || '…' end clipped, ((row_number() over (order by doc_id) - 1) // 25 + 1)::bigint page from documents")
def clip_page(t):
    from tessera.operators import ordering

    paged = ordering.numbered(t.documents, ["doc_id"], "n")
    return paged.select("doc_id", text.clip(F.col("text"), 80).alias("clipped"), (F.floor((F.col("n") - 1) / 25) + 1).cast("long").alias("page"))


@query("p_meaningful", "select doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: regexp_matches(x, '[0-9]') or (length(x) > 1 and not list_contains(['the','a','an','of','and','in','at','for','event','workshop','course','class','session'], x)))) > 0 meaningful from documents")
def meaningful(t):
    return t.documents.select("doc_id", text.meaningful(F.col("text")).alias("meaningful"))


_QUALITY = """with q as (select doc_id, text, regexp_replace(text, '\\s', '', 'g') v, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') p, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S')) ls from documents),
r as (select doc_id, v, length(regexp_replace(v, '[^\\p{L}]', '', 'g')) / nullif(length(v), 0) lr, len(list_filter(p, lambda w: regexp_matches(w, '\\p{L}.*\\p{L}'))) / nullif(len(p), 0) wr, len(ls) n, len(list_filter(ls, lambda l: not regexp_matches(l, '\\p{L}\\S*\\p{L}'))) noisy from q)
select doc_id, case when v = '' then 'empty' when lr < 0.5 then 'mostly_symbols' when wr < 0.5 then 'fragmented' when noisy >= 2 and noisy / n >= 0.3 then 'noisy_lines' else 'plausible' end verdict from r"""


@query("s_text_quality", _QUALITY)
def text_quality(t):
    return t.documents.select("doc_id", text.quality(F.col("text"))["verdict"].alias("verdict"))


@query("n_gregorian_to_jalali", "with j as (select o_orderkey, (o_orderdate::date - date '1970-01-01') + 2440588 jdn from orders), y as (select *, (33 * (jdn - 1948320) + 3) // 12053 + 1 y from j), n as (select *, jdn - (365 * (y - 1) + (8 * y + 21) // 33 + 1948319) nth from y) select o_orderkey, y::bigint y, (case when nth <= 186 then (nth - 1) // 31 + 1 else (nth - 187) // 30 + 7 end)::bigint m, (case when nth <= 186 then (nth - 1) % 31 + 1 else (nth - 187) % 30 + 1 end)::bigint d from n")
def gregorian_to_jalali(t):
    j = temporal.date_to_jalali(F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", *(j[k].alias(k) for k in "ymd"))


@query("n_jalali_roundtrip", "select o_orderkey, o_orderdate::date as day from orders")
def jalali_roundtrip(t):
    j = temporal.date_to_jalali(F.to_date("o_orderdate"))
    parts = t.orders.select("o_orderkey", *(j[k].alias(k) for k in "ymd"))
    return parts.select("o_orderkey", temporal.jalali_to_date(F.col("y"), F.col("m"), F.col("d")).alias("day"))


@query("n_parse_iso", "select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderdate::date end as day from orders")
def parse_iso(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = F.when(F.col("o_orderkey") % 5 == 0, F.concat_ws(" ", day, F.lit("1997-02-30"))).otherwise(F.concat(F.lit("on "), F.translate(day, "0123456789", text.PERSIAN_DIGITS)))
    return t.orders.select("o_orderkey", temporal.parse_iso(line).alias("day"))


@query("n_parse_english_date", "select o_orderkey, o_orderdate::date as day from orders")
def parse_english(t):
    line = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return t.orders.select("o_orderkey", temporal.parse_english(F.concat(F.lit("Opens "), line, F.lit("."))).alias("day"))


@query("n_infer_year", "select o_orderkey, o_orderdate::date as day from orders")
def infer_year(t):
    """Days without their year, seen from up to 40 days before or after; those of 29 February too."""
    day = F.to_date("o_orderdate")
    reference = F.date_add(day, (F.col("o_orderkey") % 80 - 40).cast("int"))
    return t.orders.select("o_orderkey", temporal.infer_year(F.month(day), F.dayofmonth(day), reference).alias("day"))


@query("n_ordinal_day", "select o_orderkey, ['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth','sixteenth','seventeenth','eighteenth','nineteenth','twentieth','twenty-first','twenty-second','twenty-third','twenty-fourth','twenty-fifth','twenty-sixth','twenty-seventh','twenty-eighth','twenty-ninth','thirtieth','thirty-first'][day(o_orderdate)] word from orders")
def ordinal_day(t):
    from tessera.functions import ordinals

    return t.orders.select("o_orderkey", ordinals.word(F.dayofmonth("o_orderdate")).alias("word"))


_CLOCKS = """select o_orderkey, case k when 0 then h * 3600 + 1800 when 1 then (h % 12 + 12) * 3600 when 2 then case when h between 6 and 11 then (h + 12) * 3600 end when 3 then 9 * 3600 when 5 then case when h not between 1 and 6 then h * 3600 end end::int as seconds,
  case k when 3 then case when h = 0 then null else 34200 end end::int as end_seconds,
  case k when 2 then case when h not between 6 and 11 then 'ambiguous_meridiem' end when 4 then 'unparsed_temporal' when 5 then case when h between 1 and 6 then 'ambiguous_meridiem' end end code
from (select o_orderkey, o_orderkey % 6 k, case o_orderkey % 6 when 1 then 1 + o_orderkey % 12 when 2 then 1 + o_orderkey % 11 when 3 then 1 else o_orderkey % 24 end h from orders)"""


@query("n_parse_clock", _CLOCKS)
def parse_clock(t):
    """Clocks, halves of the day, Persian parts of the day, ranges, other numbers, and bare hours."""
    key = F.col("o_orderkey")
    n = lambda x: x.cast("string")
    line = (
        F.when(key % 6 == 0, F.concat(F.lit("زمان: "), n(key % 24), F.lit(":30"))).when(key % 6 == 1, F.concat(n(1 + key % 12), F.lit(" p.m.")))
        .when(key % 6 == 2, F.concat(F.translate(n(1 + key % 11), "0123456789", text.PERSIAN_DIGITS), F.lit(" شب"))).when(key % 6 == 3, "از ساعت 9:00 تا 9:30")
        .when(key % 6 == 4, F.concat(n(key % 24), F.lit(" people"))).otherwise(F.concat(F.lit("ساعت "), n(key % 24)))
    )
    got = temporal.parse_clock(line)
    return t.orders.select("o_orderkey", *(got[c].cast("int").alias(c) for c in ("seconds", "end_seconds")), got["code"].alias("code"))


@query("n_local_instant")
def local_instant(t):
    """Over every order, whatever the clocks did; tests compare with the zone's rules in zoneinfo."""
    return t.orders.select("o_orderkey", F.date_format(temporal.local_instant(F.col("o_orderdate").cast("timestamp"), "Asia/Tehran"), "yyyy-MM-dd HH:mm").alias("utc"))


@query("n_saturday_week", "select o_orderkey, o_orderdate::date - ((isodow(o_orderdate) + 1) % 7)::int as start from orders")
def saturday_week(t):
    return t.orders.select("o_orderkey", temporal.saturday(F.to_date("o_orderdate")).alias("start"))


@query("n_price", "select p_partkey, case when p_partkey % 5 = 0 then 0 when p_partkey % 5 = 4 then null else floor(p_retailprice) * case when p_partkey % 5 = 3 then 1000 else 1 end end::decimal(38,6) amount, case p_partkey % 5 when 1 then 'USD' when 2 then 'TOMAN' when 3 then 'GBP' end currency, case when p_partkey % 5 = 4 then 'ambiguous_price' end code from part")
def price(t):
    k, amount = F.col("p_partkey") % 5, F.floor("p_retailprice").cast("string")
    line = F.when(k == 0, "Free").when(k == 1, F.concat(F.lit("Price: "), amount, F.lit(" USD"))).when(k == 2, F.concat(F.translate(amount, "0123456789", text.PERSIAN_DIGITS), F.lit(" تومان"))).when(k == 3, F.concat(F.lit("£ "), amount, F.lit(" thousand."))).otherwise(F.concat(amount, F.lit(" or more")))
    got = temporal.price(line)
    return t.part.select("p_partkey", got["amount"].cast("decimal(38,6)").alias("amount"), got["currency"].alias("currency"), got["code"].alias("code"))


@query("n_status", "select o_orderkey, case o_orderkey % 4 when 0 then 'invalid' when 1 then 'unresolved' when 2 then 'partial' else 'normalized' end status from orders")
def status(t):
    k = F.col("o_orderkey") % 4
    marks = F.array_compact(F.array(F.when(k == 0, "error"), F.when(k == 2, "review"), F.lit("info")))
    return t.orders.select("o_orderkey", temporal.status(k != 1, marks).alias("status"))


@query("n_status_counts", "select case o_orderkey % 4 when 0 then 'invalid' when 1 then 'unresolved' when 2 then 'partial' else 'normalized' end status, count(*) n from orders group by 1")
def status_counts(t):
    return status(t).groupBy("status").agg(F.count("*").alias("n"))


@query("n_precision_kind", "select o_orderkey, case when o_orderkey % 3 = 2 then 'unknown' when o_orderkey % 2 = 0 then 'range' when o_orderkey % 5 = 0 then 'inferred' when o_orderkey % 3 = 0 then 'exact' else 'day' end date_precision, case when o_orderkey % 11 = 0 then 'recurring' when o_orderkey % 7 = 0 then 'discrete' when o_orderkey % 3 = 2 then 'unknown' when o_orderkey % 2 = 0 then 'range' else 'single' end schedule_kind from orders")
def precision_kind(t):
    from tessera.operators import schedules

    k = F.col("o_orderkey")
    start = F.when(k % 3 != 2, F.to_date("o_orderdate"))
    stop = F.when((k % 3 != 2) & (k % 2 == 0), F.date_add(start, 2))
    clock = F.when(k % 3 == 0, F.lit(36000))
    return t.orders.select("o_orderkey", schedules.precision(start, stop, clock, k % 5 == 0).alias("date_precision"), schedules.kind(start, stop, k % 11 == 0, F.when(k % 7 == 0, 3).otherwise(1)).alias("schedule_kind"))


@query("n_session_expand", "select l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') first_day, strftime(max(l_shipdate + to_days(l_quantity::int)), '%Y-%m-%d') last_day, count(*) n_sessions from lineitem group by 1")
def session_expand(t):
    stop = F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int"))
    return t.lineitem.groupBy("l_orderkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(stop), "yyyy-MM-dd").alias("last_day"), F.count("*").alias("n_sessions"))


@query("n_reconcile_covering", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate >= o_orderdate covered from lineitem join orders on o_orderkey = l_orderkey")
def reconcile_covering(t):
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_shipdate") >= F.col("o_orderdate")).alias("covered"))


@query("n_iso_instant", "select event_id, case when event_id % 3 <> 2 then strftime(date_trunc('second', ts) - case when event_id % 3 = 1 then interval '210 minutes' else interval '0 minutes' end, '%Y-%m-%d %H:%M:%S') end instant from events")
def iso_instant(t):
    k, local = F.col("event_id") % 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    line = F.concat(local, F.when(k == 0, "Z").when(k == 1, "+03:30").otherwise(""))
    return t.events.select("event_id", F.date_format(temporal.iso_instant(line), "yyyy-MM-dd HH:mm:ss").alias("instant"))


@query("n_stale_cache", "with c as (select user_id, max(ts) checked from events where event_type = 'view' group by 1), m as (select max(ts) now from events) select u.user_id, case when checked is null then 'check' when checked < now - interval 7 day then 'recheck' else 'reuse' end decision from (select distinct user_id from events) u left join c using (user_id), m")
def stale_cache(t):
    checked = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("checked"))
    now = t.events.agg(F.max("ts").alias("now"))
    joined = t.events.select("user_id").distinct().join(checked, "user_id", "left").crossJoin(F.broadcast(now))
    stale = F.col("checked") < F.col("now") - F.expr("interval 7 days")
    return joined.select("user_id", F.when(F.col("checked").isNull(), "check").when(stale, "recheck").otherwise("reuse").alias("decision"))


_FAILED = """select event_id, case k when 0 then 'unavailable' when 1 then 'policy_blocked' when 2 then case when h = 429 then 'temporary_failure' else 'access_restricted' end when 3 then 'temporary_failure' when 4 then case when h = 429 or h >= 500 then 'temporary_failure' else 'parse_failure' end when 5 then case when h = 429 or h >= 500 then 'temporary_failure' else 'unavailable' end else 'temporary_failure' end status,
  case k when 1 then 'robots:robots' when 3 then 'listing:dns' when 4 then 'detail:layout' else 'collect:collection_failure' end || case when h is not null then ':http_' || h else '' end report
from (select event_id, event_id % 7 k, case event_id % 4 when 0 then 429 when 1 then 503 when 2 then 404 end h from events)"""


@query("p_classify_failure", _FAILED)
def classify_failure(t):
    """Failures made of event numbers: a kind, a category, an operation and an HTTP status."""
    from tessera.operators import readiness

    k, h = F.col("event_id") % 7, F.col("event_id") % 4
    kind = F.when(k == 0, "disabled").when(k == 1, "restricted").when(k == 2, "authentication").when(k == 5, "unavailable").otherwise("error")
    category = F.when(k == 1, "robots").when(k == 3, "dns").when(k == 4, "layout").otherwise("a secret message")
    operation = F.when(k == 1, "robots").when(k == 3, "listing").when(k == 4, "detail").otherwise("other")
    status = F.when(h == 0, 429).when(h == 1, 503).when(h == 2, 404)
    return t.events.select("event_id", readiness.failure(kind, category, status).alias("status"), readiness.safe_failure(operation, category, status).alias("report"))
