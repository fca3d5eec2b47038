"""Sort-means, the n-gram Jaccard join and the filter audit: odd rows, plain versions, and DuckDB on the small tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import brute
import compare
import numpy as np
import pytest

from tessera.llm import clustering, interactions, jaccard_join
from tessera.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_sort_means", "op12_jaccard_join", "op13_filter_interactions"])
def test_rows_of_sql(spark, name):
    got = compare.spark(QUERIES[name](spark, FOLDER))
    assert got == compare.oracle(ORACLES[name], FOLDER)
    assert got[1]


# ---- sort-means


def nearest(points, centres):
    d = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def test_scan_finds_the_nearest_from_any_start():
    rng = np.random.default_rng(5)
    for spread in (2, 3, 40):
        points, centres = rng.integers(-spread, spread, (400, 3)), rng.integers(-spread, spread, (12, 3))
        centres[7] = centres[2]  # two in one place: the smaller number has both's vectors
        want = nearest(points, centres)
        for before in (np.zeros(400, np.int32), rng.integers(0, 12, 400).astype(np.int32)):
            got = clustering.scan(points.astype(np.int32), before, centres)
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [max(-(1 << 20), min(1 << 20, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres, points = np.array([v for _, v in order[:k]], dtype=object), np.array([v for _, v in kept], dtype=object)
    for _ in range(rounds):
        at, _d = nearest(points, centres)
        centres = np.array([[sum(col) // len(col) for col in zip(*points[at == c], strict=True)] if (at == c).any() else centres[c] for c in range(len(centres))], dtype=object)
    at, d = nearest(points, centres)
    return sorted((str(i), int(c), int(x), int(sum(d[at == c])), int(sum(d))) for (i, _v), c, x in zip(kept, at, d, strict=True))


def test_clusters_of_odd_rows(spark):
    rng = random.Random(3)
    f32 = lambda x: float(np.float32(x))
    made = [(i, [f32(rng.gauss(i % 3, 0.4)) for _ in range(4)]) for i in range(60)]
    made += [(5, made[5][1]), (5, made[5][1]), (None, made[7][1]), (None, None), (70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0, None, 2.0, 3.0]), (74, [1.0, math.nan, 2.0, 3.0]), (75, [1.0, math.inf, 2.0, 3.0]), (76, [3e38, -3e38, 0.0, 0.0]), (77, [0.0] * 4), (78, [-0.0] * 4)]
    made = [(i, None if v is None else [None if x is None else f32(x) for x in v]) for i, v in made]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in made], "vec_id long, embedding array<float>, cluster int, distance long, _vec int").repartition(3)
    for k in (5, 100):  # with 100 there are fewer vectors than centroids, and repeated rows start two
        rows, centres = clustering.cluster_vectors(table, k=k, rounds=3, dims=4)
        got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"]) for r in rows.collect())
        assert got == plain_clusters(made, k, 3, 4)
        assert len(centres) == min(k, sum(1 for i, v in made if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)))
    rows, centres = clustering.cluster_vectors(table.where("vec_id < 0"), dims=4)
    assert rows.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"] and not rows.collect() and centres.shape == (0, 4)
    with pytest.raises(ValueError, match="no vector has an id"):
        clustering.cluster_vectors(table.where("vec_id is null"), dims=4)


def test_empty_query_tables(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id < 0").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").where("doc_id < 0").write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("op11_sort_means", "op12_jaccard_join", "op13_filter_interactions"):
        got = QUERIES[name](spark, str(tmp_path))
        assert got.columns == QUERIES[name](spark, FOLDER).columns and not got.collect()


# ---- the n-gram Jaccard join


def test_prefixes_share_what_links_need():
    """For sets at the threshold the smaller of two l is reached within the places that the join looks at."""
    rng = random.Random(8)
    for _ in range(300):
        n, percent = rng.randint(1, 60), rng.choice([50, 80, 85, 100])
        a = set(rng.sample(range(200), n))
        b = set(a) - set(rng.sample(sorted(a), rng.randint(0, max(0, n // 5)))) | set(rng.sample(range(200, 220), rng.randint(0, n // 6)))
        if not b or 100 * len(a & b) < percent * len(a | b):
            continue
        order = list(range(220))
        rng.shuffle(order)
        ranks = [sorted(x, key=order.index) for x in (a, b)]
        need = -(-percent * (len(a) + len(b)) // (100 + percent))
        for l in range(1, need + 1):  # noqa: E741
            heads = [set(r[: len(r) - need + l]) for r in ranks]
            assert len(heads[0] & heads[1]) >= l


@pytest.fixture(scope="module")
def made_texts():
    rng = random.Random(21)
    base = [f"w{k}" for k in range(90)]
    hot = " ".join(f"common{k}" for k in range(30))
    out = []
    for i in range(90):  # near copies of one text, of growing strength
        own = list(base)
        for _ in range(i // 12):
            own[rng.randrange(90)] = f"x{rng.random()}"
        out.append(" ".join(own))
    out += [hot + " " + " ".join(f"u{rng.random()}" for _ in range(rng.randint(0, 12))) for _ in range(60)]  # a passage many share
    out += ["One two", "one TWO", "one", None, "", " \n\t", "a b c d", "a b c d", "É é É é É", "é é é é é", "long " * 30_000, "long " * 30_001]
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "percent", "rounds"), [(4, 85, 2), (4, 85, 0), (2, 60, 1)])
def test_join_against_all_pairs(spark, made_texts, width, percent, rounds):
    table = spark.createDataFrame([(i, t, 7, "clash", 1) for i, t in made_texts], "doc_id long, text string, node int, token string, n long").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked(table, width, percent, rounds).collect()}
    assert got == brute.near(made_texts, width, percent)


def test_join_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "quite other words than these"), (None, None), (2, "a b c d e f"), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_join.linked(table, 4, 85).collect())
    assert got == Counter([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, 1), (None, 2, None), (None, 0, None), (3, 0, 3)])


def test_costly_lists_ask_for_more_matches():
    assert jaccard_join.matches(np.zeros(100), 100, 85) == 1
    even = jaccard_join.matches(np.full(100, 1000.0), 100, 85)
    rising = jaccard_join.matches(np.concatenate([np.full(16, 10.0), np.full(84, 1e6)]), 100, 85)
    assert even > rising == 1


# ---- the filter audit


def plain_audit(rows, labels):
    flags = []
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        good, toxic = (any(x == i and i is not None and y[k] == 1 for x, *y in labels) for k in (0, 1))
        flags.append((lang or "", fails, good, toxic))
    out = set()
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        removed = {}
        for order in orders:
            for step, x in enumerate(order, 1):
                before = order[: step - 1]
                gone = [f for f in own if f[1][x] and not any(f[1][y] for y in before)]
                removed[order, step] = (gone, sum(1 for f in own if not any(f[1][y] for y in order[:step])), sum(1 for f in own if f[1][x] and any(f[1][y] for y in before)), sum(1 for f in own if f[1][x] and sum(f[1].values()) == 1))
        totals = Counter()
        for (order, step), (gone, *_rest) in removed.items():
            totals[order[step - 1]] += len(gone)
        for (order, step), (gone, kept, redundant, unique) in removed.items():
            out.add((part, order, step, kept, len(gone), redundant, unique, sum(f[2] for f in gone), sum(f[3] for f in gone), totals[order[step - 1]]))
    return out


def test_audit_of_odd_rows(spark):
    rng = random.Random(2)
    words = lambda n, kinds: " ".join(rng.choice("abcdefghij") * rng.randint(1, kinds) for _ in range(n))
    rows = [(i, rng.choice([words(250, 40), words(250, 2), words(20, 9), "SHOUTED " * 210, "a # b"]), rng.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(3, rows[3][1], "en"), (90, rows[3][1], "fr"), (91, rows[3][1], "en"), (None, rows[3][1], "en"), (None, None, None), (92, None, "en"), (93, "", "en"), (94, None, "xx"), (95, "\x0b\x0c é É ñ", "en"), (96, "W " * 100_000, "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(60)] + [(4, 1, 1), (4, 0, 0), (91, 1, None), (92, None, 1), (None, 1, 1), (999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame([(*r, 1, "clash", 5) for r in rows], "doc_id long, text string, lang string, part int, filter_order string, shapley long").repartition(3)
    marks = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = interactions.audit_documents(docs, marks)
    assert {tuple(r) for r in got.collect()} == plain_audit(rows, labels)


def test_audit_of_general_flags(spark):
    rows = spark.createDataFrame([(True, None, "a"), (True, True, "a"), (False, True, "a"), (None, None, None)], "x boolean, y boolean, g string")
    got = {tuple(r) for r in interactions.interaction_audit(rows, {"X": "x", "Y": "y"}, "g").collect()}
    assert got == {("a", "XY", 1, 1, 2, 0, 1, 3), ("a", "XY", 2, 0, 1, 1, 1, 3), ("a", "YX", 1, 1, 2, 0, 1, 3), ("a", "YX", 2, 0, 1, 1, 1, 3)} | {("", o, s, 1, 0, 0, 0, 0) for o in ("XY", "YX") for s in (1, 2)}
    with pytest.raises(ValueError, match="one to eight"):
        interactions.interaction_audit(rows, {}, "g")
