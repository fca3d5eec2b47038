"""The registry of sources: a YAML base, an overlay of states and local sources, and changes to that overlay."""

from __future__ import annotations

import json
import os
from collections import Counter
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# States of a source, and reasons that lock one.
STATES = ("active", "disabled", "archived")
LOCKS = ("robots", "terms")
SOURCE = "id string, identity string, url string, type string, enabled boolean, disabled_reason string"


def load(path: str) -> list[dict]:
    """The sources of a YAML file, each over the file's ``defaults``; an id twice, or none, is refused."""
    with open(path, encoding="utf-8") as f:
        spec = yaml.safe_load(f) or {}
    rows = [(spec.get("defaults") or {}) | row for row in spec.get("sources") or []]
    twice = [k for k, n in Counter(row.get("id") for row in rows).items() if n > 1 or not k]
    if twice:
        raise ValueError(f"ids missing or given twice: {twice}")
    return rows


def table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Sources as rows: enabled unless they say otherwise, identified by their address unless they name an identity."""
    names = [c.split()[0] for c in SOURCE.split(", ")]
    made = [{"enabled": True, "identity": row.get("url")} | row for row in rows]
    return spark.createDataFrame([tuple(row.get(c) for c in names) for row in made], SOURCE)


def overlay(base: DataFrame, states: DataFrame, local: DataFrame) -> DataFrame:
    """The effective sources, with ``origin`` and ``archived``.

    ``states`` (id, enabled, archived) change base sources: the base's own
    reasons that lock a source can't be cleared, and an archived one is disabled.
    ``local`` sources come after the base's, but those that share an id or an
    identity with a base source are shadowed.  States of unknown ids do nothing.
    """
    s = states.select(F.col("id"), F.col("enabled").alias("_on"), F.coalesce("archived", F.lit(False)).alias("archived"))
    locked = F.coalesce(F.col("disabled_reason").isin(*LOCKS), F.lit(False))
    merged = base.join(s, "id", "left").withColumn("archived", F.coalesce("archived", F.lit(False)))
    merged = merged.withColumn("enabled", ~locked & ~F.col("archived") & F.coalesce("_on", "enabled")).drop("_on").withColumn("origin", F.lit("base"))
    own = local.join(base.select("id"), "id", "left_anti").join(base.select("identity"), "identity", "left_anti")
    return merged.unionByName(own.select(*base.columns).withColumn("archived", F.lit(False)).withColumn("origin", F.lit("local")))


class Registry:
    """The overlay of one writer, a JSON file: changes are validated as a whole, then replace the file, and the file before is kept as .bak."""

    def __init__(self, base: list[dict], path: str):
        self.base, self.path = {row["id"]: row for row in base}, Path(path)
        self.overlay = json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {"states": {}, "local": {}}

    def state(self, key: str) -> str:
        row = self.overlay["local"].get(key) or self.base.get(key)
        if row is None:
            raise KeyError(key)
        own = self.overlay["states"].get(key, "active" if row.get("enabled", True) else "disabled")
        return "disabled" if row.get("disabled_reason") in LOCKS and own == "active" else own

    def add(self, row: dict) -> None:
        rows = [*self.base.values(), *self.overlay["local"].values()]
        if not row.get("id") or not row.get("url") or any(row["id"] == r["id"] or row["url"] == r.get("url") for r in rows):
            raise ValueError("a source needs an id and an address that no other has")
        self._write({**self.overlay, "local": {**self.overlay["local"], row["id"]: row}})

    def move(self, key: str, to: str) -> None:
        """enable, disable, archive or restore: archived sources can only be restored, which leaves them disabled; locked ones not enabled."""
        now = self.state(key)
        wanted = {"enable": "active", "disable": "disabled", "archive": "archived", "restore": "disabled"}[to]
        if (now == "archived") != (to == "restore"):
            raise ValueError(f"{key} is {now}")
        if to == "enable" and (self.overlay["local"].get(key) or self.base[key]).get("disabled_reason") in LOCKS:
            raise ValueError(f"{key} is locked")
        self._write({**self.overlay, "states": {**self.overlay["states"], key: wanted}})

    def _write(self, new: dict) -> None:
        if set(new["states"]) - set(self.base) - set(new["local"]) or set(new["states"].values()) - set(STATES):
            raise ValueError("states of unknown sources, or unknown states")
        if self.path.exists():
            Path(f"{self.path}.bak").write_bytes(self.path.read_bytes())
        fresh = Path(f"{self.path}.new")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(new, f, ensure_ascii=False, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(fresh, self.path)
        self.overlay = new

    def states(self, spark: SparkSession) -> DataFrame:
        """The overlay's states as ``overlay`` reads them."""
        return spark.createDataFrame([(k, v == "active", v == "archived") for k, v in self.overlay["states"].items()], "id string, enabled boolean, archived boolean")
