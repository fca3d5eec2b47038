"""Saved pages as a data source: ``spark.read.format("saved_pages").load(folder)``."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: a page's size, in bytes, beyond which it is refused.
LARGEST = 3_000_000


class SavedPages(DataSource):
    """Files of a shared folder, a row each: (path, status, html).

    Option ``each`` is how many files a partition reads.  A page that is too
    large, or is not UTF-8, has a status that says so and no text.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "path string, status string, html string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"].removeprefix("file:"), int(self.options.get("each", 100)))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, each: int):
        self.folder, self.each = folder, each

    def partitions(self) -> list[InputPartition]:
        names = sorted(str(p) for p in Path(self.folder).iterdir() if p.suffix in (".html", ".htm"))
        return [InputPartition(names[a : a + self.each]) for a in range(0, len(names), self.each)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, str | None]]:
        for name in partition.value:
            at = Path(name)
            if at.stat().st_size > LARGEST:
                yield name, "too_large", None
                continue
            try:
                yield name, "ok", at.read_bytes().decode("utf-8")
            except UnicodeDecodeError:
                yield name, "encoding", None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SavedPages)
