"""Numbering and pages over a total order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], alias: str = "n") -> DataFrame:
    """Rows numbered from 1 in a total order: sorted by ranges, numbered within each, and moved by the sizes before.

    Only one count a partition meets in a single place.
    """
    from tessera.operators.storage import settled

    # The ranges must stay as they are between the counts and the rows.
    ranged = settled(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_p", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_n", local).join(sizes, "_p").withColumn(alias, (F.col("_n") + F.col("_before")).cast("long")).drop("_p", "_n", "_before")
