"""One event from the members of a group: what survives of their texts, prices, times and sessions.

Nothing is gathered: every rule is a combining aggregate of the group, and what a
rule needs of the group it gets by a window on its key, so members that are dealt
by group are not shuffled again.  A price is an amount with
its currency, never one of each; a time is one member's whole tuple, never put
together from several; sessions keep their own facts.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as texts

TIMES = ("start_date", "end_date", "start_time", "end_time", "starts_at", "ends_at", "timezone")
FACTS = ("price_amount", "currency", "availability_text", "remaining_seats", "enabled")
OCCURRENCE = (
    "struct<start_date:date,end_date:date,start_time:string,end_time:string,starts_at:timestamp,ends_at:timestamp,timezone:string,date_precision:string,session_id:string,timeslot_id:string,"
    "price_amount:decimal(18,4),currency:string,availability_text:string,remaining_seats:bigint,enabled:boolean,diagnostics:array<string>>"
)


def _any(conditions) -> Column:  # noqa: ANN001
    return functools.reduce(Column.__or__, conditions)


def _all(conditions) -> Column:  # noqa: ANN001
    return functools.reduce(Column.__and__, conditions)


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(on, F.lit(False)), code) for on, code in pairs)))


def agreed(value: Column, key: Column, order: Column) -> Column:
    """The first known value of a group whose known ones have one key; null where they have several."""
    return F.when(F.min(key) == F.max(key), F.min_by(value, F.when(value.isNotNull(), order)))


def timed(members: DataFrame, group: str, order: Column) -> DataFrame:
    """(group, TIMES, date_precision, time_codes): the first reliable member's times that say all that reliable ones say.

    Members whose times are known and ``reliable`` count, or all with known times
    if none is.  If two of them disagree, or none says everything, there is none.
    """
    known = _any(F.col(f).isNotNull() for f in TIMES if f != "timezone")
    rows = members.withColumn("_order", order).withColumn("_known", known)
    own = Window.partitionBy(group)
    sure = F.bool_or(F.col("_known") & F.coalesce("reliable", F.lit(False))).over(own)
    rows = rows.where(F.col(group).isNotNull()).withColumn("_sure", sure).withColumn("_counts", F.col("_known") & (F.coalesce("reliable", F.lit(False)) | ~F.col("_sure")))
    strong = lambda f: F.when(F.col("_counts"), F.col(f))
    rows = rows.withColumns({f"_u_{f}": F.min(strong(f)).over(own) for f in TIMES} | {f"_v_{f}": F.max(strong(f)).over(own) for f in TIMES} | {"_some": F.bool_or("_counts").over(own)})
    rows = rows.withColumn("_clash", _any([F.coalesce(F.col(f"_u_{f}") != F.col(f"_v_{f}"), F.lit(False)) for f in TIMES]))
    whole = F.col("_counts") & ~F.col("_clash") & _all(F.col(f).eqNullSafe(F.col(f"_u_{f}")) for f in TIMES)
    against = F.col("_known") & _any(F.coalesce(F.col(f) != F.col(f"_u_{f}"), F.lit(False)) for f in TIMES)
    more = F.col("_known") & _any(F.col(f).isNotNull() & F.col(f"_u_{f}").isNull() for f in TIMES)
    zone = agreed(F.col("timezone"), F.col("timezone"), F.col("_order")).alias("_zone")
    found = rows.groupBy(group).agg(F.min_by(F.struct(*TIMES, "date_precision"), F.when(whole, F.col("_order"))).alias("t"), F.bool_or("_some").alias("_some"), F.bool_or(against).alias("_against"), F.bool_or(more).alias("_more"), zone)
    has = F.col("t").isNotNull()
    codes = _codes((F.col("_some") & ~has, "unresolved_temporal_interpretations:temporal"), (has & F.col("_against"), "stronger_explicit_temporal_selected:temporal"), (has & F.col("_more"), "partial_temporal_not_combined:temporal"))
    return found.select(group, *(F.col(f"t.{f}").alias(f) for f in TIMES if f != "timezone"), F.when(has, F.col("t.timezone")).otherwise(F.col("_zone")).alias("timezone"), F.coalesce("t.date_precision", F.lit("unknown")).alias("date_precision"), codes.alias("time_codes"))


def merged(members: DataFrame, group: str) -> DataFrame:
    """(group, occurrence fields, candidate_ids, diagnostics, split): the group's sittings, each once.

    A source's session is one under its ids, others under their times.  Copies
    fill each other's unknown times and facts; facts that disagree are null, with
    a code; sessions whose times disagree stay apart, marked.  A day without a
    clock is evidence of the one clocked sitting of that day, if there is one.
    """
    fields = [x.partition(":")[0] for x in OCCURRENCE[7:-1].replace("decimal(18,4)", "decimal").split(",")]
    rows = members.select(group, "candidate_id", F.explode("occurrences").alias("o")).select(group, "candidate_id", *(F.col(f"o.{f}").alias(f) for f in fields))
    places = F.to_json(F.struct("start_date", "end_date", "start_time", "end_time", "timezone"))
    key = F.when(F.col("session_id").isNotNull(), F.to_json(F.struct("session_id", "timeslot_id"))).otherwise(places)
    rows = rows.withColumn("_sitting", key)
    of = Window.partitionBy(group, "_sitting")
    clash = _any([F.coalesce(F.min(f).over(of) != F.max(f).over(of), F.lit(False)) for f in TIMES])
    rows = rows.where(F.col(group).isNotNull()).withColumn("split", clash).withColumn("_sitting", F.when(F.col("split"), F.concat("_sitting", F.to_json(F.struct(*TIMES)))).otherwise(F.col("_sitting")))
    facts = [F.when(F.min(f) == F.max(f), F.min(f)).alias(f) for f in FACTS]
    odd = _codes((F.bool_or("split"), "occurrence_temporal_conflict"), *((F.min(f) != F.max(f), f"occurrence_field_conflict:{f}") for f in FACTS))
    codes = F.array_union(F.flatten(F.collect_set(F.coalesce("diagnostics", F.array().cast("array<string>")))), odd)
    one = rows.groupBy(group, "_sitting").agg(*(F.min(f).alias(f) for f in TIMES), F.min("date_precision").alias("date_precision"), F.min("session_id").alias("session_id"), F.min("timeslot_id").alias("timeslot_id"), *facts, F.collect_set("candidate_id").alias("candidate_ids"), F.array_sort(F.array_distinct(codes)).alias("diagnostics"), F.bool_or("split").alias("split"))
    bare = F.col("session_id").isNull() & F.col("start_time").isNull() & F.col("end_date").isNull()
    clocked = F.col("end_date").isNull() & F.col("start_time").isNotNull()
    day = Window.partitionBy(group, "start_date", "timezone")
    kept = one.withColumns({"_n": F.count_if(clocked).over(day), "_more": F.flatten(F.collect_list(F.when(bare, F.col("candidate_ids"))).over(day))}).where(~(bare & (F.col("_n") == 1)))
    ids = F.array_sort(F.when(clocked & (F.col("_n") == 1), F.array_union("candidate_ids", "_more")).otherwise(F.col("candidate_ids")))
    return kept.select(group, *(f for f in fields if f != "diagnostics"), ids.alias("candidate_ids"), "diagnostics", "split")


def resolved(members: DataFrame, group: str, order: Column, fields: list[str], folded: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(events, occurrences) of groups.

    ``members`` has candidate_id, ``fields``, price_amount, currency, TIMES,
    date_precision, reliable, schedule_kind, recurrence_rule and occurrences, an
    array of ``OCCURRENCE``.  A field survives if all that is known of it is one
    value, or one after folding for ``folded``; of ``first`` the first known value
    in ``order`` survives whatever others say.  An event of several sittings has
    no time of its own.  ``diagnostics`` are codes with the field they are about.
    """
    key = lambda f: texts.text_key(F.col(f), True) if f in folded else F.col(f)
    rows = members.withColumn("_o", order).withColumns({f"_k_{f}": key(f) for f in fields}).withColumn("_p", F.when(F.col("price_amount").isNotNull() | F.col("currency").isNotNull(), F.struct("price_amount", "currency")))
    kinds = F.when(F.col("schedule_kind") != "unknown", F.col("schedule_kind"))
    odd = lambda k: F.min(k) != F.max(k)
    base = rows.groupBy(group).agg(
        F.count("*").alias("n_members"), *(agreed(F.col(f), F.col(f"_k_{f}"), F.col("_o")).alias(f) for f in fields), *(F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_o"))).alias(f) for f in first), F.when(F.min("_p") == F.max("_p"), F.min("_p")).alias("_price"),
        F.when(F.min(kinds) == F.max(kinds), F.min(kinds)).when(F.min(kinds).isNotNull(), "conflict").otherwise("unknown").alias("_kind"), F.when(F.min("recurrence_rule") == F.max("recurrence_rule"), F.min("recurrence_rule")).alias("recurrence_rule"),
        _codes(*((odd(f"_k_{f}"), f"field_conflict:{f}") for f in fields), (odd("_p"), "field_conflict:price")).alias("_codes"),
    )
    occurrences = merged(members, group)
    sittings = occurrences.groupBy(group).agg(F.count("*").alias("_n"), F.bool_or("split").alias("_split"))
    joined = base.join(timed(members, group, order), group).join(sittings, group, "left")
    several = F.coalesce(F.col("_n") > 1, F.lit(False))
    split = F.coalesce("_split", F.lit(False))
    kind = F.when(split, "conflict").when(several & ~F.col("_kind").isin("conflict", "recurring"), "discrete").otherwise(F.col("_kind"))
    codes = F.array_sort(F.concat("_codes", "time_codes", _codes((split, "occurrence_temporal_conflict:occurrences"), (F.col("title").isNull() if "title" in fields else F.lit(False), "missing_canonical_title:title"))))
    events = joined.select(
        group, "n_members", *fields, *first, F.col("_price.price_amount").alias("price_amount"), F.col("_price.currency").alias("currency"), *(F.when(~several, F.col(f)).alias(f) for f in TIMES if f != "timezone"), "timezone",
        F.when(several, "unknown").otherwise(F.col("date_precision")).alias("date_precision"), kind.alias("schedule_kind"), "recurrence_rule", F.coalesce("_n", F.lit(0)).alias("n_occurrences"), codes.alias("diagnostics"),
    )
    return events, occurrences
