"""State as versions in a shared folder: a commit names its data and the version it replaces, and only one writer can make it.

A version is a data folder and, written after it, a commit file whose name is the
next number and which must not exist yet: of two writers that started from one
version, one creates the file and the other is refused and leaves nothing behind.
A commit with a schema newer than this library knows is refused by readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import keys

SCHEMA = 2  # the layout of commits that this library writes
#: Changes of older layouts on reading, by the layout they lead to: each is applied to what an older commit holds.
MIGRATIONS: dict[int, Callable[[DataFrame], DataFrame]] = {2: lambda df: df if "revision" in df.columns else df.withColumn("revision", F.lit(0).cast("long"))}


class Stale(RuntimeError):
    """Another writer has replaced the version that a commit started from."""


class NewerSchema(RuntimeError):
    """A folder holds state in a layout that this library does not know."""


def _files(spark: SparkSession, root: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _named(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/commits/{version:012}.json"


def latest(spark: SparkSession, root: str) -> int:
    """The number of the newest version; 0 where there is none."""
    path, fs = _files(spark, f"{root.rstrip('/')}/commits")
    if not fs.exists(path):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return max((int(n[:12]) for n in names if n.endswith(".json")), default=0)


def _commit_of(spark: SparkSession, root: str, version: int) -> dict:
    path, fs = _files(spark, _named(root, version))
    stream = fs.open(path)
    try:
        found = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    if not isinstance(found.get("schema"), int):
        raise NewerSchema(f"version {version} of {root} does not say its schema")
    if found["schema"] > SCHEMA:
        raise NewerSchema(f"version {version} of {root} has schema {found['schema']}, known are those up to {SCHEMA}")
    return found


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The state of a version, the newest if none is named, in today's layout; nothing where there is none."""
    number = latest(spark, root) if version is None else version
    if number == 0:
        return None
    commit = _commit_of(spark, root, number)
    df = spark.read.parquet(f"{root.rstrip('/')}/{commit['data']}")
    for layout in range(commit["schema"] + 1, SCHEMA + 1):
        df = MIGRATIONS[layout](df)
    return df


def commit(spark: SparkSession, root: str, df: DataFrame, expected: int, schema: int = SCHEMA) -> int:
    """Writes the version after ``expected`` and returns its number; ``Stale`` if there is one already."""
    if latest(spark, root) != expected:
        raise Stale(f"version {expected} of {root} has been replaced")
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root.rstrip('/')}/{data}")
    path, fs = _files(spark, _named(root, expected + 1))
    try:
        stream = fs.create(path, False)  # the one step that decides: no file of this name may exist
    except Exception as e:  # noqa: BLE001  whatever the store says, what counts is whether the name is taken
        gone, _ = _files(spark, f"{root.rstrip('/')}/{data}")
        fs.delete(gone, True)
        if fs.exists(path):
            raise Stale(f"version {expected} of {root} has been replaced") from e
        raise
    try:
        stream.write(json.dumps({"version": expected + 1, "schema": schema, "data": data, "replaces": expected}).encode())
    finally:
        stream.close()
    return expected + 1


def token(*values: Column | str) -> Column:
    """Names a state that someone has seen."""
    return keys.digest(*values)


def decisions(stored: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, decision, *values) of rows that were edited outside, each with the ``token`` of the state it was edited from.

    apply: the state is still the one seen.  unchanged: it already is what the row
    says.  conflict: it is neither.  duplicate: rows of one key that say different
    things, all refused; equal ones count once.  unknown: no such key.
    """
    now = stored.select(F.col(key).alias("_key"), F.struct(*values).alias("_now"), token(key, *values).alias("_token"))
    own = Window.partitionBy(key)
    said = F.struct(*values)
    rows = incoming.select(key, "token", *values).distinct().withColumn("_several", F.count("*").over(own) > 1)
    joined = rows.join(now, F.col(key) == F.col("_key"), "left")
    decision = (
        F.when(F.col("_key").isNull(), "unknown").when(F.col("_several"), "duplicate").when(said.eqNullSafe(F.col("_now")), "unchanged").when(F.col("token") == F.col("_token"), "apply").otherwise("conflict")
    )
    return joined.select(key, decision.alias("decision"), *values)


def applied(stored: DataFrame, decided: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The state with the rows to apply in it, their ``revision`` counted up."""
    new = decided.where("decision = 'apply'").select(F.col(key).alias("_key"), F.struct(*values).alias("_new"))
    rows = stored.join(new, F.col(key) == F.col("_key"), "left")
    changed = F.col("_key").isNotNull()
    kept = [c for c in stored.columns if c not in values and c != "revision"]
    revision = (F.col("revision") + F.when(changed, 1).otherwise(0)).cast("long").alias("revision")
    return rows.select(*kept, *(F.when(changed, F.col(f"_new.{v}")).otherwise(F.col(v)).alias(v) for v in values), *([revision] if "revision" in stored.columns else []))


def import_edits(spark: SparkSession, root: str, incoming: DataFrame, key: str, values: list[str], tries: int = 3) -> tuple[int, DataFrame]:
    """(version, decisions): edits judged against the newest state and committed over it.

    If another writer commits meanwhile, the edits are judged anew against what
    it left, up to ``tries`` times: a row it changed is a conflict then.
    """
    for left in range(tries - 1, -1, -1):
        version = latest(spark, root)
        state = read(spark, root, version)
        if state is None:
            raise ValueError(f"no state in {root}")
        decided = decisions(state, incoming, key, values)
        try:
            return commit(spark, root, applied(state, decided, key, values), version), decisions(state, incoming, key, values)
        except Stale:
            if not left:
                raise
    raise Stale(root)
