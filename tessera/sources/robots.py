"""Robots rules as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


RULES = 2_000  # rules of one file at most


def allows(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, allowed): the longest matching rule decides, a tie allows, and so does no rule.

    ``rules`` (rule, allow) are those of one agent group, from one file: * stands
    for any characters, and $ at the end for the end of the path.  They become a
    constant of the plan, so a file with more than 2,000 of them is refused.
    """
    form = F.regexp_replace(F.regexp_replace("rule", r"([.+?()\[\]{}|^\\])", r"\\$1"), r"\*", ".*")
    rows = rules.select(F.char_length("rule").alias("n"), "allow", F.concat(F.lit("^"), form).alias("form")).limit(RULES + 1).collect()
    if len(rows) > RULES:
        raise ValueError(f"more than {RULES} rules")
    path = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit(""))
    if not rows:
        return pages.select("page_id", F.lit(True).alias("allowed"))
    group = F.array(*(F.struct(F.lit(r["n"]).alias("n"), F.lit(r["allow"]).alias("allow"), F.lit(r["form"]).alias("form")) for r in rows))
    best = F.array_max(F.transform(F.filter(group, lambda r: F.rlike(F.col("_path"), r["form"])), lambda r: F.struct(r["n"], r["allow"])))
    return pages.select("page_id", path.alias("_path")).select("page_id", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))
