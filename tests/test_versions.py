"""Versions of state: races, layouts, and edits judged by the state they were made from."""

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import versions as vs


def state(spark, rows=((1, "a", 0), (2, "b", 0), (3, None, 0))):
    return spark.createDataFrame(list(rows), "id int, note string, revision long")


def test_commits_and_reads(spark, tmp_path):
    root = f"file:{tmp_path}/s"
    assert vs.latest(spark, root) == 0 and vs.read(spark, root) is None
    assert vs.commit(spark, root, state(spark), 0) == 1 and vs.commit(spark, root, state(spark).limit(1), 1) == 2
    assert vs.read(spark, root).count() == 1 and vs.read(spark, root, 1).count() == 3
    with pytest.raises(vs.Stale):
        vs.commit(spark, root, state(spark), 1)
    assert len(list(Path(tmp_path, "s").glob("data-*"))) == 2  # the refused one left nothing


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    """Both have looked at the newest version before either has made its commit."""
    root = f"file:{tmp_path}/s"
    vs.commit(spark, root, state(spark), 0)
    both, plain = threading.Barrier(2), vs.latest

    def together(spark_, root_):
        found = plain(spark_, root_)
        both.wait(60)
        return found

    monkeypatch.setattr(vs, "latest", together)
    out = []

    def write(note):
        try:
            out.append(vs.commit(spark, root, state(spark).withColumn("note", F.lit(note)), 1))
        except vs.Stale as e:
            out.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    [w.start() for w in writers]
    [w.join() for w in writers]
    monkeypatch.undo()
    assert sorted(type(x).__name__ for x in out) == ["Stale", "int"] and vs.latest(spark, root) == 2
    assert vs.read(spark, root).select("note").distinct().count() == 1 and len(list(Path(tmp_path, "s").glob("data-*"))) == 2


def test_layouts(spark, tmp_path):
    root = f"file:{tmp_path}/s"
    vs.commit(spark, root, state(spark).drop("revision"), 0, schema=1)
    assert [r.revision for r in vs.read(spark, root).collect()] == [0, 0, 0]
    vs.commit(spark, root, state(spark), 1, schema=vs.SCHEMA + 1)
    with pytest.raises(vs.NewerSchema):
        vs.read(spark, root)
    commits = Path(tmp_path, "s", "commits")
    (commits / f"{3:012}.json").write_text(json.dumps({"data": "x"}))
    with pytest.raises(vs.NewerSchema):
        vs.read(spark, root)


def edits(spark, rows):
    """(id, the note it was edited from, the new note)"""
    made = spark.createDataFrame(rows, "id int, seen string, note string")
    return made.select("id", vs.token("id", F.col("seen")).alias("token"), "note")


def test_edits(spark, tmp_path):
    root = f"file:{tmp_path}/s"
    vs.commit(spark, root, state(spark), 0)
    rows = [(1, "a", "A"), (2, "old", "B"), (3, None, None), (9, None, "x")]
    version, decided = vs.import_edits(spark, root, edits(spark, rows), "id", ["note"])
    assert version == 2 and {r.id: r.decision for r in decided.collect()} == {1: "apply", 2: "conflict", 3: "unchanged", 9: "unknown"}
    assert {tuple(r) for r in vs.read(spark, root).select("id", "note", "revision").collect()} == {(1, "A", 1), (2, "b", 0), (3, None, 0)}
    again = vs.decisions(vs.read(spark, root), edits(spark, [(1, "a", "A"), (2, "b", "B"), (2, "b", "C"), (3, None, "c"), (3, None, "c")]), "id", ["note"])
    assert sorted((r.id, r.decision) for r in again.collect()) == [(1, "unchanged"), (2, "duplicate"), (2, "duplicate"), (3, "apply")]


def test_edits_of_two_writers(spark, tmp_path, monkeypatch):
    """A commit in between: what it changed is a conflict, the rest is applied over it."""
    root = f"file:{tmp_path}/s"
    vs.commit(spark, root, state(spark), 0)
    plain, once = vs.commit, []

    def late(spark_, root_, df, expected, **more):
        if not once:
            once.append(1)
            plain(spark_, root_, state(spark, [(1, "other", 1), (2, "b", 0), (3, None, 0)]), expected)
        return plain(spark_, root_, df, expected, **more)

    monkeypatch.setattr(vs, "commit", late)
    version, decided = vs.import_edits(spark, root, edits(spark, [(1, "a", "A"), (2, "b", "B")]), "id", ["note"])
    assert version == 3 and {r.id: r.decision for r in decided.collect()} == {1: "conflict", 2: "apply"}
    assert {tuple(r) for r in vs.read(spark, root).select("id", "note", "revision").collect()} == {(1, "other", 1), (2, "B", 1), (3, None, 0)}
