"""Exports as a bundle of hashed parts: ``df.write.format("hashed_bundle").mode("append").save(folder)``.

Every task writes one part under a name of its own and reports its rows and
SHA-256 with its commit; the driver then puts the parts in place and writes
``manifest.json`` last.  A bundle without a manifest is no bundle, so a failed
task or driver leaves nothing that a reader would take for one.
"""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    sha256: str


class Taken(FileExistsError):
    """The folder already holds a bundle."""


class HashedBundle(DataSource):
    """Rows as JSON lines; the folder must be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "hashed_bundle"

    def schema(self) -> str:
        raise NotImplementedError("a bundle is read with spark.read.json, after verified()")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"].removeprefix("file:"), [f.name for f in schema], uuid.uuid4().hex)


def plain(value):  # noqa: ANN001, ANN201
    """A value as JSON has it: dates and decimals as text, bytes as hex, rows and maps as objects."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, names: list[str], run: str):
        self.folder, self.names, self.run = folder, names, run

    @property
    def staging(self) -> Path:
        return Path(self.folder) / f"_staging-{self.run}"

    def write(self, rows: Iterator) -> Part:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05}-{self.run[:8]}.jsonl"
        self.staging.mkdir(parents=True, exist_ok=True)
        digest, n = hashlib.sha256(), 0
        attempt = self.staging / f"{name}.{context.taskAttemptId()}"  # two attempts of a task do not meet
        with attempt.open("wb") as out:
            for row in rows:
                line = json.dumps({k: plain(v) for k, v in zip(self.names, row, strict=True)}, ensure_ascii=False, sort_keys=True).encode() + b"\n"
                digest.update(line)
                out.write(line)
                n += 1
            out.flush()
            os.fsync(out.fileno())
        return Part(f"{name}.{context.taskAttemptId()}", n, digest.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [m for m in messages if m is not None]
        home = Path(self.folder)
        home.mkdir(parents=True, exist_ok=True)
        if (home / MANIFEST).exists():
            self.abort(messages)
            raise Taken(self.folder)
        listed = []
        for p in sorted(parts, key=lambda p: p.name):
            final = p.name.rpartition(".")[0]
            if not p.rows:
                continue  # it goes with the staging folder
            (self.staging / p.name).replace(home / final)
            listed.append({"name": final, "rows": p.rows, "sha256": p.sha256})
        self._clear()
        body = {"parts": listed, "rows": sum(p.rows for p in parts), "columns": self.names, "sha256": hashlib.sha256("".join(x["sha256"] for x in listed).encode()).hexdigest()}
        draft = home / f".{MANIFEST}.{self.run}"
        draft.write_text(json.dumps(body, indent=1))
        draft.replace(home / MANIFEST)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        with contextlib.suppress(FileNotFoundError):
            for left in self.staging.iterdir():
                left.unlink()
            self.staging.rmdir()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HashedBundle)


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows, intact) of a bundle's parts: each is hashed again where it is read; a part that is gone is not intact."""
    place = folder.rstrip("/")
    listed = spark.read.json(f"{place}/{MANIFEST}", multiLine=True, schema="parts array<struct<name:string,rows:long,sha256:string>>").select(F.inline("parts"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.jsonl").load(place)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("_hash"))
    return listed.join(found, "name", "left").select("name", "rows", F.coalesce(F.col("_hash") == F.col("sha256"), F.lit(False)).alias("intact"))
