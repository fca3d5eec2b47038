"""Every query with SQL gives the rows that DuckDB gives."""

import compare
import pytest

from tessera.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, name):
    got = compare.spark(QUERIES[name](spark, FOLDER))
    if name in ORACLES:
        assert got == compare.oracle(ORACLES[name], FOLDER)
    assert got[0]


def test_a_title_conflict_needs_no_distinct_count(spark):
    """Whether titles differ follows from the least and the greatest, so no row is dealt out by its title first."""
    from tessera.plans.queries import QUERIES

    plan = QUERIES["x_unique_preferred_title"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.split("Project")[0]


def test_a_title_key_is_made_once(spark):
    from tessera.functions import signals

    rows = spark.createDataFrame([("event", "Night A", "the night a", 0), ("event", None, "x", 1), ("event", "?!", "x", 2), ("event", "Untitled", "untitled", 3), ("event", "Elsewhere", "x", 4), ("other", None, None, 5), ("event", "A", None, 6)], "kind string, title string, txt string, n int")
    got = rows.select("n", signals.admission(rows["kind"], rows["title"], rows["txt"]).alias("why"))
    assert [r.why for r in got.orderBy("n").collect()] == [None, "missing_title", "missing_title", "placeholder_title", "unsupported_title", "not_established_event", None]
    assert got._jdf.queryExecution().analyzed().toString().count("translate(title") == 1
