"""How filters of a corpus interact, from joint-failure counts by inclusion and exclusion.

For every set S of filters one number is counted: the rows that fail all of S,
as the sum of the product of their flags.  These 2**n sums a part are all that
is read from the rows; what any order of the filters keeps, removes and finds
removed already follows from them.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[\x20\x09-\x0D]+"


def subsets(n: int) -> list[int]:
    return list(range(1 << n))


def joint_failures(rows: DataFrame, filters: list[str], weights: dict[str, Column], part: str) -> DataFrame:
    """(part, one array a weight): entry S is the weight of the rows that fail every filter of S, whose bits number ``filters``.

    Partial sums are made where the rows are; a part sends 2**n numbers a weight
    from each task.  A null flag counts as not failed, a null weight as 0.
    """
    flag = [F.coalesce(F.col(f).cast("long"), F.lit(0).cast("long")) for f in filters]
    flat = rows.select(part, *(x.alias(f"_f{i}") for i, x in enumerate(flag)), *(F.coalesce(w.cast("long"), F.lit(0).cast("long")).alias(f"_w{j}") for j, w in enumerate(weights.values())))
    product = lambda s, w: functools.reduce(Column.__mul__, (F.col(f"_f{i}") for i in range(len(filters)) if s >> i & 1), w)
    sums = [F.sum(product(s, F.col(f"_w{j}"))).alias(f"_{j}_{s}") for j in range(len(weights)) for s in subsets(len(filters))]
    counted = flat.groupBy(part).agg(*sums)
    return counted.select(part, *(F.array(*(f"_{j}_{s}" for s in subsets(len(filters)))).alias(name) for j, name in enumerate(weights)))


def _over(within: Column, n: int, term) -> Column:
    """The sum of (-1)**|S| * term(S) over the sets S inside ``within``."""
    signed = lambda s: F.when(F.bit_count(s) % 2 == 0, term(s)).otherwise(-term(s))
    inside = lambda s: s.bitwiseAND(within) == s
    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda acc, s: acc + F.when(inside(s), signed(s)).otherwise(0))


def failing(joint: Column, f: Column, none_of: Column, n: int) -> Column:
    """What fails the filter of bit ``f`` (all rows, where it is 0) and none of ``none_of``: Moebius inversion of the joint failures."""
    return _over(none_of, n, lambda s: F.element_at(joint, s.bitwiseOR(f) + 1))


def shapley(joint: Column, f: Column, n: int) -> Column:
    """What a filter removes, summed over all orders.

    A set's Harsanyi dividend in the game "rows removed" is its joint failures,
    with alternating sign; its members share it alike, n! / |S| each.
    """
    shares = F.array(*(F.lit(math.factorial(n) // max(s.bit_count(), 1)).cast("long") for s in subsets(n)))
    rest = F.lit((1 << n) - 1).bitwiseXOR(f)
    return _over(rest, n, lambda s: F.element_at(joint, s.bitwiseOR(f) + 1) * F.element_at(shares, s.bitwiseOR(f) + 1))


def interaction_audit(rows: DataFrame, filters: dict[str, str], part: str, lost: dict[str, Column] | None = None) -> DataFrame:
    """Per part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, one column of ``lost`` each, shapley).

    ``filters`` maps a letter to its flag column (true: fails), ``lost`` names
    0/1 weights of the rows whose sum over the removed ones is given too.  All
    orders of the letters are audited; up to eight filters.  Null flags count as
    passed, null parts as the empty string, repeated rows as rows each; an empty
    table gives no rows.  No part is grouped with its rows: they become sums
    before they are shuffled, then each part's sums become n! * n rows.
    """
    letters, n = list(filters), len(filters)
    if not 0 < n <= 8:
        raise ValueError("one to eight filters")
    lost = lost or {}
    named = rows.withColumn("_part", F.coalesce(F.col(part).cast("string"), F.lit("")))
    joint = joint_failures(named, list(filters.values()), {"_all": F.lit(1), **{f"_{name}": w for name, w in lost.items()}}, "_part")
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(letters[i] for i in order), step, 1 << f, before))
            before |= 1 << f
    flat = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(f).alias("f"), F.lit(b).alias("b")) for o, s, f, b in steps))
    each = joint.withColumn("_step", F.explode(flat))
    f, before, rest = F.col("_step.f"), F.col("_step.b"), F.lit((1 << n) - 1).bitwiseXOR(F.col("_step.f"))
    removed = failing(F.col("_all"), f, before, n)
    return each.select(
        F.col("_part").alias("part"), F.col("_step.o").alias("filter_order"), F.col("_step.s").alias("step"),
        failing(F.col("_all"), F.lit(0), before.bitwiseOR(f), n).alias("kept"), removed.alias("removed"),
        (F.element_at("_all", f + 1) - removed).alias("redundant"), failing(F.col("_all"), f, rest, n).alias("unique_fails"),
        *(failing(F.col(f"_{name}"), f, before, n).alias(name) for name in lost), shapley(F.col("_all"), f, n).alias("shapley"),
    )


def text_flags(docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, short, repetitive, shouting, marked, copied) of every row.

    ``copied``: the text equals that of a row with a smaller id anywhere in the
    table.  Null texts are empty ones; a row without an id is no copy and no
    original; rows with one id and text are no copies of each other.  Texts are
    told apart by their SHA-256, so that no text is shuffled; only hashes that
    occur twice are joined, and a hot one is split by adaptive execution.
    """
    own = docs.select(F.col(id_column).alias("_id"), F.col(part).alias("_part"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    words = F.filter(F.split("_t", WORDS), lambda w: w != "")
    measured = own.select("_id", "_part", F.unhex(F.sha2("_t", 256)).alias("_h"), words.alias("_w"), "_t").select(
        "_id", "_part", "_h", (F.size("_w") < 200).alias("short"), (100 * F.size(F.array_distinct("_w")) < 50 * F.size("_w")).alias("repetitive"),
        (100 * F.length(F.regexp_replace("_t", "[^A-Z]+", "")) > 3 * F.length("_t")).alias("shouting"), F.col("_t").rlike("[#$%&*|]").alias("marked"),
    )
    hashes = own.where("_id is not null").select("_id", F.unhex(F.sha2("_t", 256)).alias("_h"))
    first = hashes.groupBy("_h").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    return measured.join(first, "_h", "left").select(F.col("_id").alias(id_column), F.col("_part").alias(part), "short", "repetitive", "shouting", "marked", F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)).alias("copied"))


FILTERS = {"A": "short", "B": "repetitive", "C": "shouting", "D": "marked", "E": "copied"}


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interaction_audit`` of the five text filters over whole documents, by language, with good and toxic documents lost.

    A document is good (toxic) if any of its labels says so; one without a label
    is neither.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max(F.expr("int(quality = 1)")).alias("_good"), F.max(F.expr("int(toxic = 1)")).alias("_toxic"))
    flags = text_flags(docs.select("doc_id", "text", "lang"))
    joined = flags.join(said, F.col("doc_id") == F.col("_labelled"), "left")
    return interaction_audit(joined, FILTERS, "lang", {"good_lost": F.col("_good"), "toxic_lost": F.col("_toxic")})


ORACLE = r"""
with words as materialized (
  select row_number() over () rid, doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
firsts as (select t, min(doc_id) first from words group by t),
said as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
flags as materialized (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 3 * length(words.t),
     regexp_matches(words.t, '[#$%&*|]'), coalesce(doc_id > first, false)] fails
  from words left join firsts using (t) left join said using (doc_id)),
counted as materialized (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from flags group by all),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) x(l, i)),
orders as (
  select a.l || b.l || c.l || d.l || e.l filter_order, [a.i, b.i, c.i, d.i, e.i] f from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select filter_order, f, s::int step from orders, range(1, 6) t(s)),
judged as (
  select part, filter_order, step, f[step] own, n, good, toxic, fails[f[step]] failed,
    len(list_filter(f[1:step - 1], lambda i: fails[i])) > 0 earlier, len(list_filter(fails, lambda x: x)) = 1 alone
  from counted, steps),
summed as (
  select part, filter_order, step, own, sum(n) filter (not failed and not earlier) kept, sum(n) filter (failed and not earlier) removed,
    sum(n) filter (failed and earlier) redundant, sum(n) filter (failed and alone) unique_fails,
    sum(good) filter (failed and not earlier) good_lost, sum(toxic) filter (failed and not earlier) toxic_lost
  from judged group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant,
  coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, own))::bigint shapley
from summed
"""
