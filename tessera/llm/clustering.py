"""Centroid clustering of integer vectors by sort-means.

Each round orders, for every centroid, the other centroids by their distance
from it.  A vector is compared with the centroid it had and then with the others
in that order, until one lies strictly beyond twice the vector's distance from
the centroid it had: by the triangle inequality no later one is as near, and
none at all is both as near and numbered lower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean

LIMIT = 1 << 20  # components are held to +-LIMIT, so that squared distances are exact in 64 bits
LONGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, dims: int, scale: int, vector: str) -> DataFrame:
    """All columns of the vectors that have exactly ``dims`` finite components; ``_vec`` holds floor(scale * x) of each as 32-bit numbers."""
    x = F.col(vector)
    whole = (F.size(x) == dims) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    kept = vectors.where(F.coalesce(whole, F.lit(False)))
    return kept.withColumn("_vec", F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(scale * v.cast("double")))).cast("int")))


def seeds(kept: DataFrame, k: int, salt: str, id_column: str) -> np.ndarray:
    """The first k vectors by the hash of salt and id; rows without an id come never, rows with one hash in the order of their components."""
    hashed = kept.where(F.col(id_column).isNotNull()).select(F.sha2(F.concat(F.lit(salt), F.col(id_column).cast("string")), 256).alias("h"), "_vec")
    return np.array([r["_vec"] for r in hashed.orderBy("h", "_vec").limit(k).collect()], np.int64)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = points.astype(np.int64) - centre
    return np.einsum("ij,ij->i", apart, apart)


def scan(points: np.ndarray, before: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each point, scanning from the cluster it had; equally near ones: the smaller number."""
    cluster, distance = before.copy(), np.empty(len(points), np.int64)
    for c in np.unique(before):
        own = np.flatnonzero(before == c)
        between = squared(centres, centres[c])
        first = squared(points[own], centres[c])
        best, number = first.copy(), np.full(len(own), c)
        for j in np.lexsort((np.arange(len(centres)), between)):
            near = np.flatnonzero(between[j] <= 4 * first)  # the others are done: later centroids are farther still
            if not len(near):
                break
            if j == c:
                continue
            d = squared(points[own[near]], centres[j])
            better = (d < best[near]) | ((d == best[near]) & (j < number[near]))
            best[near[better]], number[near[better]] = d[better], j
        cluster[own], distance[own] = number, best
    return cluster, distance


def _points(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("_vec").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def assigned(table: DataFrame, centres: np.ndarray) -> DataFrame:
    """``table`` with ``cluster`` and ``distance`` renewed."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = scan(_points(batch), batch.column("cluster").to_numpy(zero_copy_only=False), centres)
                held = [batch.column(c) for c in batch.schema.names[:-2]]
                yield pa.record_batch([*held, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=batch.schema.names)

    return table.mapInArrow(lean(assign), table.schema)


def means(table: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Each centroid as floor(sum / count) of its vectors, empty ones as they were: a batch is summed in its task, Spark adds k rows a batch."""
    dims = centres.shape[1]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, points = batch.column("cluster").to_numpy(zero_copy_only=False), _points(batch) if batch.num_rows else None
            found = np.unique(cluster)
            sums = [points[cluster == c].sum(axis=0, dtype=np.int64) for c in found]
            yield pa.record_batch([pa.array(found, pa.int32()), pa.array([int((cluster == c).sum()) for c in found], pa.int64()), pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = table.select("_vec", "cluster").mapInArrow(lean(total), "cluster int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims)]
    out = centres.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # k rows
        out[row["cluster"]] = [int(row[f"s{j}"]) // row["n"] for j in range(dims)]
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1:", id_column: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): per vector (id, cluster, distance, cluster_inertia, inertia) and the final centroids, k x dims integers.

    Vectors are kept if they have ``dims`` components, all finite and not null,
    and are taken as floor(scale * x).  The centroids start as the k vectors
    whose ``salt`` and id hash lowest; ``rounds`` times every vector goes to the
    nearest (ties: the smaller number) and each centroid with vectors to the
    floor of their mean; then vectors are assigned once more.  ``distance`` is
    squared, the inertias are its sums over the cluster and over all.

    Each round writes the table of vectors with their clusters; only centroids
    and their sums, k x dims numbers, pass through the driver.  Null vectors and
    those of other lengths are left out; a row without an id is assigned, but is
    no seed; repeated rows each count, and may be seeds each; with fewer than k
    vectors there are fewer centroids, with none no rows; components beyond
    +-2**20 after scaling count as that; an inertia beyond 64 bits is the
    largest number; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    kind = vectors.schema[id_column].dataType.simpleString()
    named = vectors.select(F.col(id_column).alias("_id"), F.col(vector).alias("_x"))
    kept = quantised(named, dims, scale, "_x").select("_id", "_vec", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    table = scratch.save(kept, "vectors")
    centres = seeds(table, k, salt, "_id")
    if not len(centres):
        if table.isEmpty():
            return vectors.sparkSession.createDataFrame([], f"`{id_column}` {kind}, cluster int, distance long, cluster_inertia long, inertia long"), np.empty((0, dims), np.int64)
        raise ValueError("no vector has an id, so there is nothing to start from")
    last = "vectors"
    for turn in range(rounds + 1):
        table = scratch.save(assigned(table, centres), f"round-{turn}")
        scratch.drop(last)
        last = f"round-{turn}"
        if turn < rounds:
            centres = means(table, centres)
    sums = table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    of, total = {r["cluster"]: min(int(r["s"]), LONGEST) for r in sums}, min(sum(int(r["s"]) for r in sums), LONGEST)
    inertia = F.array(*(F.lit(of.get(c, 0)).cast("long") for c in range(len(centres))))
    return table.select(F.col("_id").alias(id_column), "cluster", "distance", inertia[F.col("cluster")].alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia")), centres


def _rounds(n: int) -> str:
    """SQL of n rounds: r0 ... rn are assignments with the centroids c0 ... cn."""
    parts = []
    for i in range(n + 1):
        if i:
            parts.append(f"""m{i} as (select cluster, d, sum(v[d]) s, count(*) n from r{i - 1}, range(1, 65) t(d) group by all),
c{i} as (select c.num, coalesce(m.vec, c.vec) vec from c{i - 1} c left join (
  select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by d) vec from m{i} group by cluster) m on m.cluster = c.num)""")
        parts.append(f"""r{i} as materialized (select rid, vec_id, v, num as cluster, dist as distance from (
  select k.rid, k.vec_id, k.v, c.num, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.vec[i]) * (k.v[i] - c.vec[i])))::bigint dist from kept k, c{i} c)
  qualify row_number() over (partition by rid order by dist, num) = 1)""")
    return ",\n".join(parts)


ORACLE = f"""
with kept as materialized (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select (row_number() over (order by sha256('1:' || vec_id), v) - 1)::int num, v vec
  from kept where vec_id is not null qualify num < 16),
{_rounds(3)}
select r.vec_id, r.cluster, r.distance, (sum(distance) over (partition by cluster))::bigint cluster_inertia,
  (sum(distance) over ())::bigint inertia, sha256(array_to_string(c.vec, ',')) centroid_sha256
from r3 r join c3 c on c.num = r.cluster
"""
