"""Every pair of rows once, in tasks of two blocks."""

from tessera.operators import relational


def test_every_pair_once_in_many_tasks(spark):
    n = 300
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i * i) for i in range(n)], "k long, v long").coalesce(1)
    pairs = relational.every_pair(rows, "k", blocks=8)
    got = pairs.collect()
    value = lambda i: None if i % 7 == 0 else i * i
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert all({r.v_x, r.v_y} == {value(r.a), value(r.b)} for r in got)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    sizes = pairs.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert max(sizes) < n * (n - 1) // 2 / 8
    assert relational.every_pair(rows.limit(0), "k").count() == 0 and relational.every_pair(rows.limit(1), "k").count() == 0


def test_pairs_come_as_runs(spark):
    """A row meets a whole block at a time, as the lesser key: written pairs are runs, which files hold in few bytes."""
    n, blocks = 300, 8
    rows = spark.createDataFrame([(None, -1), *((i * 7 % n, i) for i in range(n))], "k long, v long").repartition(5)
    parts = relational.every_pair(rows, "k", blocks=blocks).rdd.mapPartitions(lambda part: [[r.a for r in part]]).collect()
    runs = sum(sum(1 for i, a in enumerate(p) if i == 0 or p[i - 1] != a) for p in parts)
    assert sum(map(len, parts)) == n * (n - 1) // 2 and runs <= n * (blocks + 1)


def test_membership_gathers_no_customer_in_one_row(spark):
    from tessera.plans.queries import QUERIES

    plan = QUERIES["j_membership_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan


def test_judged_pairs_do_not_travel_and_come_once(spark):
    from tessera.operators import entities
    from tessera.plans import announcements
    from tessera.plans.registry import Tables

    made = entities.prepared(announcements.walks(Tables(spark, "/root/testdata/sf0.001"))).localCheckpoint()
    pairs = entities.sure_pairs(made)
    got = pairs.select("a.candidate_id", "b.candidate_id").collect()
    assert got and len(got) == len({tuple(r) for r in got}) and all(a < b for a, b in got)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 5  # on either side frequencies and contexts to their tokens, then blocks; none on pairs
    assert set(entities.same_events(made).columns) == {"candidate_id_a", "candidate_id_b", "kind"}


def test_a_clique_shrinks_to_a_star(spark):
    from tessera.operators import entities

    edges = [(f"{g}{i:02}", f"{g}{j:02}") for g in "ab" for i in range(20) for j in range(i + 1, 20)]
    rows = spark.createDataFrame(edges, "x string, y string").coalesce(1)
    few = [tuple(r) for r in entities.spanning(rows, "x", "y").collect()]
    assert len(few) == 38 and {v for _, v in few} == {"a00", "b00"}
    again = entities.spanning(rows.union(spark.createDataFrame([("b19", "a05")], "x string, y string")).repartition(7), "x", "y", nodes=3)
    assert {r.root for r in entities.components(again, "u", "v").collect()} == {"a00"}
