"""Relational building blocks: revisions, survivorship, tolerant and interval joins, islands, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last revision of each key: one combining aggregate, no sort."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(last).select(*keys, "_v.*")


def change_class(df: DataFrame, key: str, order: list[str], content: str, alias: str = "change") -> DataFrame:
    """new, changed or existing against the key's previous revision; a return to older content is changed."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(alias, F.when(before.isNull(), "new").when(before == F.col(content), "existing").otherwise("changed"))


def insert_if_absent(incoming: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose key is not stored; of several with one key, the first."""
    first = Window.partitionBy(key).orderBy(*order)
    fresh = incoming.join(stored.select(key), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def alone(df: DataFrame, keys: list[str], flag: str = "accepted") -> DataFrame:
    """Marks rows whose key no other row has; of an ambiguous key all copies are refused."""
    return df.withColumn(flag, F.count("*").over(Window.partitionBy(*keys)) == 1)


def unanimous(value: Column, anchor: Column) -> Column:
    """The value if all non-null ones of a group agree, else null; what agrees is one value, so ``anchor`` does not matter."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def compatible(a: Column, b: Column) -> Column:
    """Equal, or one side unknown."""
    return a.isNull() | b.isNull() | (a == b)


def every_pair(rows: DataFrame, key: str, a: str = "a", b: str = "b", blocks: int = 32) -> DataFrame:
    """(a, b, columns ending in _x and _y): every two rows of a unique number as key, once; ``a`` and x are the row of the lesser key.

    Blocks are ranges of keys, about equal, by ends found first (one number for
    each), and two blocks meet in a cell of their own: a shuffled join whose tasks hold one block, whatever the table's
    file layout.  A row travels ``blocks`` + 1 times; the pairs are all there
    are.  One row meets a whole block at a time, always in the same order, so
    written pairs are runs of ``a`` beside one repeated list of ``b``.
    """
    ends = rows.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 10_000)).first()[0]
    block = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col(key))) if ends else F.lit(0)
    own = rows.where(F.col(key).isNotNull()).withColumn("_u", block)
    names = [c for c in rows.columns if c != key]
    cell = lambda i, j: i * blocks + j
    x = own.select(F.col(key).alias("_a"), "_u", *(F.col(c).alias(f"{c}_x") for c in names), F.explode(F.sequence(F.col("_u"), F.lit(blocks - 1))).alias("_j"))
    y = own.select(F.col(key).alias("_b"), F.col("_u").alias("_v"), *(F.col(c).alias(f"{c}_y") for c in names), F.explode(F.sequence(F.lit(0), F.col("_u"))).alias("_i"))
    x = x.withColumn("_c", cell(F.col("_u"), F.col("_j"))).drop("_j").repartition(blocks * blocks, "_c")
    y = y.withColumn("_c", cell(F.col("_i"), F.col("_v"))).drop("_i").repartition(blocks * blocks, "_c")
    met = x.join(y.hint("shuffle_hash"), "_c").where((F.col("_u") < F.col("_v")) | (F.col("_a") < F.col("_b")))
    return met.select(F.col("_a").alias(a), F.col("_b").alias(b), *(f"{c}_x" for c in names), *(f"{c}_y" for c in names))


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, alias: str = "island") -> DataFrame:
    """Numbers runs: a row where ``breaks`` holds, or the first, begins a new one."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(alias, F.sum("_b").over(own)).drop("_b")


def zero_filled(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Counts of a fixed vocabulary of labels; those that do not occur count 0."""
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{column} string")
    return every.join(df.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def interval_relation(start: Column, stop: Column, outer_start: Column, outer_stop: Column) -> Column:
    known = start.isNotNull() & stop.isNotNull() & outer_start.isNotNull() & outer_stop.isNotNull()
    inside = (start >= outer_start) & (stop <= outer_stop)
    apart = (stop <= outer_start) | (start >= outer_stop)
    return F.when(~known, "unknown").when(inside, "within").when(apart, "disjoint").otherwise("overlapping")


def three_way(baseline: Column, current: Column, incoming: Column) -> Column:
    """skipped if the incoming value brings nothing, conflict if the current one moved meanwhile, else apply."""
    return F.when(incoming.eqNullSafe(baseline) | incoming.eqNullSafe(current), "skipped").when(~current.eqNullSafe(baseline), "conflict").otherwise("apply")


def compared(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(missing, extra): how many expected rows are not there, and how many are that are not expected; equal rows count each, and nulls are equal.

    One aggregate over both, so nothing is compared pairwise.
    """
    names = expected.columns
    both = expected.withColumn("_n", F.lit(1)).unionByName(actual.withColumn("_n", F.lit(-1)))
    left = both.groupBy(*names).agg(F.sum("_n").alias("_n"))
    side = lambda n, name: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).cast("long").alias(name)
    return left.agg(side(F.col("_n"), "missing"), side(-F.col("_n"), "extra"))
