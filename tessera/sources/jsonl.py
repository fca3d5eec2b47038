"""Observation logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_ITEM = (
    "id string, source_id string, source_type string, external_id string, content_type string, content_url string, raw_text string, captured_at timestamp, "
    "published_at timestamp, author string, image_url string, content_hash string, raw_metadata string, seq long"
)


def read(spark: SparkSession, path: str, schema: str = RAW_ITEM, strict: bool = False) -> DataFrame:
    """All lines; ``_bad`` holds what could not be read, or, with ``strict``, a bad line ends the query."""
    reader = spark.read.schema(schema if strict else f"{schema}, _bad string")
    return reader.option("mode", "FAILFAST").json(path) if strict else reader.option("columnNameOfCorruptRecord", "_bad").json(path)


def latest_items(log: DataFrame) -> DataFrame:
    """The last valid line of each id, with ``first_seen``."""
    good = log.where("_bad is null and id is not null") if "_bad" in log.columns else log.where("id is not null")
    columns = [c for c in good.columns if c not in ("_bad", "id")]
    return good.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("_v"), F.min("captured_at").alias("first_seen")).select("id", "_v.*", "first_seen")


def append(items: DataFrame, path: str) -> None:
    """New lines for the log; the commit protocol shows all of them or none."""
    items.write.mode("append").json(path)
