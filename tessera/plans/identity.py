"""Queries on identity and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.operators import relational
from tessera.plans.registry import query

HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '')"
RAW_HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
BARE = f"regexp_replace({PATH}, '/+$', '')"
PARAMS = "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '')"
VALID = "regexp_matches(url, '^https?://[^\\s/@?#]+([/?#][^\\s]*)?$')"


@query("k_content_hash", "select doc_id, sha256(concat_ws(chr(31), text, '', source)) content_hash from documents")
def content_hash(t):
    return t.documents.select("doc_id", keys.digest("text", F.lit(None), "source").alias("content_hash"))


@query("k_fragment_digest", "select conv_id, turn, sha256(concat_ws(chr(31), conv_id::varchar, turn::varchar, role, text, '')) fragment_id from conversations")
def fragment_digest(t):
    return t.conversations.select("conv_id", "turn", keys.digest("conv_id", "turn", "role", "text", F.lit(None)).alias("fragment_id"))


@query("k_stable_id", "select s_suppkey, 'supplier:' || sha256(to_json([s_suppkey::varchar, s_name])::varchar) stable_id from supplier")
def stable_id(t):
    return t.supplier.select("s_suppkey", keys.stable_id("supplier", "s_suppkey", "s_name").alias("stable_id"))


@query("k_candidate_id", "select doc_id, 'candidate:' || sha256(concat_ws(chr(31), doc_id::varchar, sha256(concat_ws(chr(31), text, '', source)))) candidate_id from documents")
def candidate_id(t):
    return t.documents.select("doc_id", keys.candidate_id(F.col("doc_id"), keys.digest("text", F.lit(None), "source")).alias("candidate_id"))


@query("k_unit_id", "select conv_id, 'unit:' || sha256(to_json(list_concat([conv_id::varchar], list(turn::varchar order by turn)))::varchar) unit_id from conversations group by conv_id")
def unit_id(t):
    turns = F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string"))
    return t.conversations.groupBy("conv_id").agg(turns.alias("_t")).select("conv_id", F.concat(F.lit("unit:"), F.sha2(F.to_json(F.concat(F.array(F.col("conv_id").cast("string")), "_t")), 256)).alias("unit_id"))


@query("k_occurrence_id", "select o_orderkey, 'occurrence:' || substr(sha256(to_json([o_custkey::varchar, strftime(o_orderdate, '%Y-%m-%d'), case when o_orderkey % 2 = 0 then 'session' else 'time' end])::varchar), 1, 24) occurrence_id from orders")
def occurrence_id(t):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "session").otherwise("time")
    return t.orders.select("o_orderkey", keys.occurrence_id(F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), kind).alias("occurrence_id"))


@query("k_identity_slot", "select conv_id, turn, case when turn = 0 then 'primary' else role || ':' || turn::varchar end slot from conversations")
def identity_slot(t):
    first = F.col("turn") == 0
    return t.conversations.select("conv_id", "turn", keys.identity_slot(F.when(first, "caption").otherwise(F.col("role")), F.when(~first, F.col("turn"))).alias("slot"))


@query("k_raw_item_id", f"select page_id, 'website:' || {HOST} || ':' || case when regexp_extract({BARE}, '([^/]*)$', 1) <> '' then regexp_extract({BARE}, '([^/]*)$', 1) else sha256(url) end raw_item_id from pages")
def raw_item_id(t):
    url = F.col("url")
    return t.pages.select("page_id", F.concat_ws(":", F.lit("website"), keys.host(url), keys.external_id(url)).alias("raw_item_id"))


@query("k_website_key", f"select page_id, {HOST} || {BARE} || case when len(p) > 0 then '?' || array_to_string(p, '&') else '' end website_key from (select *, list_sort(list_filter({PARAMS}, lambda p: not starts_with(lower(p), 'utm_'))) p from pages)")
def website_key(t):
    return t.pages.select("page_id", keys.website_key(F.col("url")).alias("website_key"))


_REGISTRATION = f"""select page_id, case when {VALID} and {BARE} <> '' then regexp_extract(url, '^([a-z]+://[^/?#]+[^?#]*)', 1) || case when len(p) > 0 then '?' || array_to_string(p, '&') else '' end
  || case when contains(url, '#') then '#' || regexp_extract(url, '#(.*)$', 1) else '' end end registration_key
from (select *, list_filter({PARAMS}, lambda q: not list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid'], lower(split_part(q, '=', 1)))) p from pages)"""


@query("k_registration_key", _REGISTRATION)
def registration_key(t):
    return t.pages.select("page_id", keys.registration_key(F.col("url")).alias("registration_key"))


_CANONICAL = f"""select page_id, case when {VALID} then regexp_extract(url, '^(https?)', 1) || '://' || {RAW_HOST} || {PATH} || case when len(p) > 0 then '?' || array_to_string(p, '&') else '' end end canonical_url
from (select *, list_filter({PARAMS}, lambda q: not (starts_with(lower(split_part(q, '=', 1)), 'utm_') or list_contains(['fbclid','gclid','ref'], lower(split_part(q, '=', 1))))) p from pages)"""


@query("k_canonical_url", _CANONICAL)
def canonical_url(t):
    return t.pages.select("page_id", keys.canonical_url(F.col("url"), ("ref",)).alias("canonical_url"))


@query("k_detail_url", f"select page_id, regexp_matches({PATH}, '^(/en|/fr)/[A-Za-z0-9_-]+/?$') is_detail from pages")
def detail_url(t):
    return t.pages.select("page_id", keys.detail_url(F.col("url"), ("/en", "/fr")).alias("is_detail"))


@query("k_valid_url", f"select page_id, {VALID} and page_id % 7 <> 0 valid from pages")
def valid_url(t):
    broken = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("ftp://user@"), "url")).otherwise(F.col("url"))
    return t.pages.select("page_id", keys.valid_url(broken).alias("valid"))


@query("k_safe_component", "select page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') component from pages")
def safe_component(t):
    return t.pages.select("page_id", keys.safe_component(F.col("url")).alias("component"))


@query("p_unique_slug", "select s_suppkey, s || case when n = 1 then '' else '_' || n end slug from (select *, row_number() over (partition by s order by s_suppkey) n from (select s_suppkey, regexp_replace(regexp_replace(lower(substr(s_name, 1, 12)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') s from supplier))")
def unique_slug(t):
    from pyspark.sql import Window

    named = t.supplier.select("s_suppkey", keys.slug(F.substring("s_name", 1, 12)).alias("_s"))
    n = F.row_number().over(Window.partitionBy("_s").orderBy("s_suppkey"))
    return named.select("s_suppkey", F.concat("_s", F.when(n == 1, "").otherwise(F.concat(F.lit("_"), n.cast("string")))).alias("slug"))


@query("p_quarantine_dupes", "select doc_id, count(*) over (partition by text, source) = 1 accepted from documents")
def quarantine_dupes(t):
    return relational.alone(t.documents, ["text", "source"]).select("doc_id", "accepted")
