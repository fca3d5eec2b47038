"""Status vocabularies: failures of collection and readiness of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories of failure that pass by themselves, and that a changed layout causes; categories and operations that may be reported.
TEMPORARY = ("dns", "timeout", "network", "tls")
PARSE = ("layout", "encoding", "content_type")
CATEGORIES = ("dns", "timeout", "network", "tls", "robots", "http_status", "redirect", "encoding", "content_type", "layout", "collection_failure")
OPERATIONS = ("collect", "request", "robots", "listing", "detail")


def failure(kind: Column, category: Column, status: Column) -> Column:
    """The channel status of a failed collection, never by its message.

    ``kind`` is disabled, restricted, authentication, unavailable or another;
    ``status`` the HTTP status or null.
    """
    busy = F.coalesce(status == 429, F.lit(False))
    return (
        F.when(kind == "disabled", "unavailable").when((kind == "restricted") & (category == "robots"), "policy_blocked")
        .when(kind.isin("authentication", "restricted"), F.when(busy, "temporary_failure").otherwise("access_restricted"))
        .when(category.isin(*TEMPORARY) | busy | F.coalesce(status >= 500, F.lit(False)), "temporary_failure").when(category.isin(*PARSE), "parse_failure")
        .when(kind == "unavailable", "unavailable").otherwise("temporary_failure")
    )


def safe_failure(operation: Column, category: Column, status: Column) -> Column:
    """``operation:category`` of the fixed vocabulary, and the HTTP status where there is a real one."""
    known = lambda c, names, other: F.when(c.isin(*names), c).otherwise(other)
    suffix = F.when(status.between(100, 599), F.concat(F.lit(":http_"), status.cast("string"))).otherwise("")
    return F.concat(known(operation, OPERATIONS, "collect"), F.lit(":"), known(category, CATEGORIES, "collection_failure"), suffix)


def disabled(reason: Column) -> Column:
    return F.when(reason.isin("robots", "terms"), "policy_blocked").otherwise("unavailable")


def readiness(unavailable: Column, missing: dict[str, Column], schedule: Column) -> tuple[Column, Column]:
    """(status, reasons): unavailable before enrichment before schedule before ready; reasons in the given order."""
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in missing.items()), F.when(schedule, F.lit("schedule_unresolved"))))
    lacking = F.lit(False)
    for c in missing.values():
        lacking = lacking | c
    status = F.when(unavailable, "UNAVAILABLE").when(lacking, "ENRICHMENT").when(schedule, "SCHEDULE").otherwise("READY")
    return status, reasons
