"""Readings of images: which stored ones are used again; and sessions of a page that are admitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ["item_id", "content_hash", "kind", "slot"]
SESSIONS = 200  # of one page


def cached(wanted: DataFrame, stored: DataFrame, engines: list[str]) -> DataFrame:
    """The wanted slots with the stored reading to use again, or the engines that are still to be tried.

    ``wanted`` and ``stored`` have item_id, content_hash, kind and slot;
    ``stored`` also engine, version, usable, score and at.  The latest usable
    reading is used; without one, the best of the latest of all engines, once
    all have been tried, and none before that.  Columns added: engine, version,
    score, reuse and missing.
    """
    newest = F.row_number().over(Window.partitionBy(*SLOT, "engine").orderBy(F.desc("at"), F.desc("version")))
    rows = stored.where(F.col("engine").isin(*engines)).withColumn("_n", newest).where("_n = 1")
    rank = F.struct(F.col("usable").cast("int"), F.when(F.col("usable"), F.col("at")), "score", "at", "engine")
    best = rows.groupBy(*SLOT).agg(F.max_by(F.struct("engine", "version", "score", "usable"), rank).alias("_b"), F.collect_set("engine").alias("_tried"))
    joined = wanted.join(best, SLOT, "left")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, engines)), F.coalesce("_tried", F.array())))
    reuse = F.coalesce(F.col("_b.usable") | (F.size(missing) == 0), F.lit(False))
    field = lambda k: F.when(reuse, F.col(f"_b.{k}")).alias(k)
    return joined.select(*wanted.columns, field("engine"), field("version"), field("score"), reuse.alias("reuse"), F.when(reuse, F.array().cast("array<string>")).otherwise(missing).alias("missing"))


def admitted(items: DataFrame, adapter: str, schema: str, codes: tuple[str, ...], prefix: str = "/events/") -> DataFrame:
    """Items with ``admitted``, their sessions or none, and ``codes`` of the fixed vocabulary.

    ``items`` have adapter, schema, path, external_id, codes and sessions
    (event_id, session_id, timeslot_id).  Only sessions of the declared adapter and
    schema on the item's own page count; one session of another event, a session
    or timeslot given twice, or a session that is both whole and cut in timeslots
    refuses all.
    """
    none = F.lit(None).cast(items.schema["sessions"].dataType)
    sessions = F.coalesce("sessions", F.array().cast(items.schema["sessions"].dataType))
    own = (F.col("adapter") == adapter) & (F.col("schema") == schema)
    page = F.regexp_replace("path", "/+$", "") == F.concat(F.lit(prefix), "external_id")
    whole, parts = F.filter(sessions, lambda s: s["timeslot_id"].isNull()), F.filter(sessions, lambda s: s["timeslot_id"].isNotNull())
    ids = lambda rows, c: F.transform(rows, lambda s: s[c])
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    clash = ~unique(ids(whole, "session_id")) | ~unique(ids(parts, "timeslot_id")) | F.arrays_overlap(ids(whole, "session_id"), ids(parts, "session_id"))
    foreign = F.exists(sessions, lambda s: ~s["event_id"].eqNullSafe(F.col("external_id")))
    known = F.filter(F.array_distinct(F.coalesce("codes", F.array().cast("array<string>"))), lambda c: c.isin(*codes))
    fault = F.when(F.size(sessions) > SESSIONS, "embedded_session_schema_drift").when(foreign | F.coalesce(clash, F.lit(False)) | ~F.coalesce(page, F.lit(False)), "embedded_session_identity_conflict")
    empty = F.array().cast("array<string>")
    told = F.when(~own, empty).when(~F.coalesce(page, F.lit(False)), F.array(fault)).when(fault.isNotNull(), F.concat(known, F.array(fault))).otherwise(known)
    return items.withColumn("_codes", told).withColumn("admitted", F.when(own & fault.isNull(), sessions).otherwise(none)).withColumn("codes", F.col("_codes")).drop("_codes")


def structured_occurrence(found: DataFrame, slot: Column) -> DataFrame:
    """Observations whose one detail slot proves an occurrence: a date and a clock beside a price, a registration or an attendance.

    ``found`` has a row for each signal: kind and the columns of ``slot``'s group.
    """
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    rows = found.groupBy(slot.alias("slot")).agg(has("date").alias("d"), has("time").alias("t"), has("price", "registration", "attendance").alias("p"))
    return rows.select("slot", (F.col("d") & F.col("t") & F.col("p")).alias("proves"))
