"""What larger tables cost: how often a value is computed, and how often rows are shuffled."""

from tessera.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", str(2**30))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_a_session_is_read_once(spark):
    assert plan(spark, "n_schedule_driver").count("[0-9]{4}") <= 2  # its start and its end


def test_members_are_dealt_by_group_once_for_each_rule(spark):
    text = plan(spark, "e_resolution")
    assert text.count("Exchange") <= 5 and text.count("Join") <= 2


def test_sessions_are_judged_without_patterns(spark):
    text = plan(spark, "e_relevance_occurrences")
    assert "RLIKE" not in text and text.count("concat_ws") <= 12
