"""Exports: guarded CSV, JSON lines, chunks for cells of bounded size, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import csv_guard


def media(df: DataFrame, root: str, kind: str, content: str = "content") -> DataFrame:
    """(path, content, n): each different content once, at a path that its hash gives, and how many rows have it; null and empty ones have none."""
    path = F.concat(F.lit(f"{root.rstrip('/')}/"), F.lit(f"{kind}-"), F.substring(F.sha2("content", 256), 1, 12))
    return df.where(F.length(content) > 0).groupBy(F.col(content).alias("content")).agg(F.count("*").alias("n")).select(path.alias("path"), "content", "n")


def write_media(df: DataFrame, root: str, kind: str, content: str = "content") -> DataFrame:
    """Write each content that is not there yet, in a file of its own, and return (path, created) of all."""
    from collections.abc import Iterator
    from pathlib import Path

    import pyarrow as pa

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            created = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = Path(path)
                at.parent.mkdir(parents=True, exist_ok=True)
                created.append(not at.exists())
                if created[-1]:
                    fresh = at.with_suffix(f".{id(batch)}")
                    fresh.write_bytes(data if isinstance(data, bytes) else data.encode())
                    fresh.replace(at)
            yield pa.record_batch([batch.column("path"), pa.array(created, pa.bool_())], names=["path", "created"])

    return media(df, root, kind, content).select("path", "content").mapInArrow(store, "path string, created boolean")


def chunks(df: DataFrame, key: str, text: str, size: int = 32_000) -> DataFrame:
    """(key, part, chunk): a text cut to parts of ``size`` characters; an empty one has one part."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length(text) / size).cast("int"))
    parts = F.sequence(F.lit(0), n - 1)
    return df.select(key, F.col(text).alias("_text"), F.explode(parts).alias("part")).select(key, "part", F.expr(f"substring(_text, part * {size} + 1, {size})").alias("chunk"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): how many rows each exported table has."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that spreadsheets open safely: strings guarded, nested values as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else csv_guard(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
