"""What may be shown of an event: values that its source states, in order, and titles that are real and attributed.

Ordered parts are found by a scan with a moving position: the state of an
aggregate is where the last part ended, so no part is found before another's end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import analysis
from tessera.functions import text as texts
from tessera.functions import vocabulary as v
from tessera.functions.phrases import tokenized
from tessera.functions.temporal import bound

# Where a title may come from.
ORIGINS = ("explicit_website", "explicit_caption", "explicit_media_ocr", "extracted_from_description")


def scanned(parts: Column, found: Column) -> Column:
    """Are all parts in ``found``, a text, one after another without overlap?"""
    step = lambda at, p: F.when(at < 0, at).otherwise(bound(F.position(p, found, at + 1), lambda i: F.when(i > 0, i - 1 + F.char_length(p)).otherwise(-1)))
    return F.aggregate(parts, F.lit(0), step) >= 0


def subsequence(words: Column, source: Column) -> Column:
    """Do the words occur in the source's words in this order, others between them allowed?"""
    ahead = lambda at, w: F.when(at < 0, at).otherwise(bound(F.array_position(F.slice(source, at + 1, F.greatest(F.size(source) - at, F.lit(0))), w), lambda i: F.when(i > 0, at + i.cast("int")).otherwise(-1)))
    return F.aggregate(words, F.lit(0), ahead) >= 0


def source_slice(value: Column, text: Column, parts: Column | bool = False) -> Column:
    """Is a value an exact slice of a text?  Where ``parts`` holds, it may be blank-line separated parts that are, in order."""
    several = F.lit(parts) if isinstance(parts, bool) else parts
    split = F.split(value, "\n\n")
    in_order = several & F.contains(value, F.lit("\n\n")) & F.forall(split, lambda p: F.trim(p) != "") & scanned(split, text)
    return F.coalesce(F.contains(text, value) | in_order, F.lit(False))


def title_key(title: Column) -> Column:
    """The words of a title: compatible forms, lower case, marks and control characters dropped, all else but letters and digits a blank."""
    plain = F.when(title.rlike(r"^\p{ASCII}*$"), title).otherwise(texts.compatible(title))
    low = F.lower(F.translate(plain, "يك‌", "یک "))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[\p{P}\p{S}\p{Z}\s]", " "), r"[\p{C}\p{M}]", ""), " +", " "))


def exclusion(event: Column, key: Column) -> Column:
    """Why an event is not shown; null for one with a real title that its sources state.  ``key`` is the ``title_key`` of its title.

    ``event`` has detection_reason, description_text, title, origin,
    title_evidence_text, title_evidence_ids, fragment_ids, candidate_ids,
    source_ids, source_url and provenance (field, candidate_ids).  A title with an
    origin needs a span of a fragment of the event that has its words in order.
    Titles derived from a description are not supported: nothing derives them.
    """
    none = F.array().cast("array<string>")
    ids = lambda c: F.coalesce(event[c], none)
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    placeholders = sorted({" ".join(t.text for t in tokenized(p)) for p in v.PLACEHOLDERS})
    span = F.coalesce(event["title_evidence_text"], F.lit(""))
    spanned = (span != "") & (F.size(ids("title_evidence_ids")) > 0) & inside(ids("title_evidence_ids"), ids("fragment_ids")) & event["origin"].isin(*ORIGINS) & subsequence(texts.tokens(event["title"]), texts.tokens(span))
    stated = F.exists(F.coalesce(event["provenance"], F.array()), lambda p: (p["field"] == "title") & (F.size(F.coalesce(p["candidate_ids"], none)) > 0) & inside(F.coalesce(p["candidate_ids"], none), ids("candidate_ids")))
    guarded = event["detection_reason"].rlike("^(non_event|needs_evidence):") | analysis.guard(event["description_text"]).isNotNull()
    return (
        F.when(F.coalesce(guarded, F.lit(False)), "not_established_event").when(key.isNull() | ~key.rlike(r"[\p{L}\p{N}]"), "missing_title").when(key.isin(*placeholders), "placeholder_title")
        .when((F.coalesce(event["origin"], F.lit("")) != "") & ~F.coalesce(spanned, F.lit(False)), "unsupported_title")
        .when((F.size(ids("source_ids")) == 0) | (F.coalesce(event["source_url"], F.lit("")) == "") | ~stated, "unsupported_title")
    )
