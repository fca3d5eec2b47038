"""Hashed bundles: parts and manifest, failed tasks, and hashes read back."""

import datetime as dt
import decimal
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import bundle


def rows(spark, n=50):
    made = [(i, None if i % 7 == 0 else f"متن {i}", dt.date(2026, 1, 1), decimal.Decimal("1.50"), [i, None], (i, "x")) for i in range(n)]
    return spark.createDataFrame(made, "id int, text string, day date, price decimal(9,2), tags array<int>, inner struct<a:int,b:string>").repartition(4)


def test_bundle(spark, tmp_path):
    bundle.register(spark)
    folder = f"{tmp_path}/out"
    rows(spark).write.format("hashed_bundle").mode("append").save(folder)
    manifest = json.loads((tmp_path / "out" / bundle.MANIFEST).read_text())
    assert manifest["rows"] == 50 and len(manifest["parts"]) == 4 and manifest["columns"][:2] == ["id", "text"]
    assert {p.name for p in (tmp_path / "out").iterdir()} == {bundle.MANIFEST, *(p["name"] for p in manifest["parts"])}
    back = {r.id: r for r in spark.read.json(f"{folder}/part-*.jsonl").collect()}
    assert len(back) == 50 and back[7].text is None and (back[8].text, back[8].day, back[8].price, back[8].tags, back[8].inner.b) == ("متن 8", "2026-01-01", "1.50", [8, None], "x")
    checked = bundle.verified(spark, f"file:{folder}").collect()
    assert len(checked) == 4 and all(r.intact for r in checked) and sum(r.rows for r in checked) == 50
    first, second = (tmp_path / "out" / p["name"] for p in manifest["parts"][:2])
    first.write_bytes(first.read_bytes().replace(b"1.50", b"1.51", 1))
    second.unlink()
    assert sorted(r.intact for r in bundle.verified(spark, f"file:{folder}").collect()) == [False, False, True, True]
    with pytest.raises(Exception, match="Taken"):
        rows(spark).write.format("hashed_bundle").mode("append").save(folder)
    assert json.loads((tmp_path / "out" / bundle.MANIFEST).read_text()) == manifest


def test_a_failed_task_leaves_no_bundle(spark, tmp_path):
    bundle.register(spark)
    folder = f"{tmp_path}/out"
    broken = rows(spark).select("id", F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception, match="broken row"):
        broken.write.format("hashed_bundle").mode("append").save(folder)
    assert not (tmp_path / "out" / bundle.MANIFEST).exists() and not list((tmp_path / "out").glob("part-*"))


def test_empty_bundle(spark, tmp_path):
    bundle.register(spark)
    rows(spark).where("id < 0").write.format("hashed_bundle").mode("append").save(f"{tmp_path}/out")
    assert json.loads((tmp_path / "out" / bundle.MANIFEST).read_text())["rows"] == 0
    assert all(r.intact for r in bundle.verified(spark, f"file:{tmp_path}/out").collect())
