"""MinHash near-duplicate groups by an inverted join of signature coordinates."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, Words, files_for, lean, mixed, slices, text_bytes, window_hashes

SHORT = 64  # members of a list up to which pairs are counted in the list's join; longer lists are joined by the rarest shingles
PLANES = 4  # bits of each coordinate that travel with a posting
SKETCH = [f"s{j}" for j in range(PLANES)]
COUNTERS = 1 << 20  # the frequency table that travels to the executors: 4 MB, however many documents


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; of fewer words, the whole sequence as one."""
    return np.unique(window_hashes(ids, min(width, len(ids)))) if len(ids) else np.empty(0, np.uint64)


def set_key(found: np.ndarray) -> bytes:
    """Names a shingle set: equal sets are one node of the graph."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def coordinates(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The signature: for each factor the least product over the set, as 32 mixed bits."""
    least = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[at : at + 4096, None] * factors).min(axis=0))
    return (mixed(least) >> np.uint64(32)).astype("<u4")


@functools.cache
def factors(k: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1 << 62, 1 << 63, k, dtype=np.uint64) | np.uint64(1)


def match_threshold(k: int, similarity: float, miss: float = 1e-6) -> int:
    """The largest number of equal coordinates that a pair at ``similarity`` fails to reach with probability ``miss`` at most."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return t
    return k


def elements(signatures: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs as 64-bit numbers, one row for each signature."""
    k = signatures.shape[1]
    return mixed((np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32)) ^ signatures.astype(np.uint64))


def signed(docs: DataFrame, width: int, k: int, id_column: str, text: str) -> DataFrame:
    """(doc, n_shingles, node, signature): the node names the set, null where it is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = factors(k)
        for batch in slices(batches, "_text"):
            n, node, sig = [], [], []
            for ids in Words(batch.column("_text"), lower=True).each():
                found = shingles(ids, width)
                n.append(len(found))
                node.append(set_key(found) if len(found) else None)
                sig.append(coordinates(found, own).tobytes() if len(found) else None)
            yield pa.record_batch([batch.column("_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["doc", "n_shingles", "node", "signature"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).mapInArrow(lean(sign), f"doc {kind}, n_shingles long, node binary, signature binary")


def keyed(docs: DataFrame, width: int, text: str) -> DataFrame:
    """All columns, and ``_node``, which names the set."""
    at = docs.columns.index(text)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            node = [set_key(shingles(ids, width)) for ids in Words(batch.column(at), lower=True).each()]
            yield pa.record_batch([*batch.columns, pa.array(node, pa.binary())], names=[*batch.schema.names, "_node"])

    return docs.mapInArrow(lean(key), docs.withColumn("_node", F.lit(None).cast("binary")).schema)


def sketched(nodes: DataFrame, k: int) -> DataFrame:
    """``nodes`` with the lowest bits of all coordinates: ``SKETCH[j]`` holds bit j of each, a long for k <= 64."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.zeros((batch.num_rows, 64), "<u4")
            low[:, :k] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, k)
            planes = [np.packbits((low >> j & 1).astype(np.uint8), axis=1).view("<i8").ravel() for j in range(PLANES)]
            yield pa.record_batch([*batch.columns, *map(pa.array, planes)], names=[*batch.schema.names, *SKETCH])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema] + [f"{c} long" for c in SKETCH])
    return nodes.mapInArrow(lean(cut), schema)


def collide(a: str, b: str, t: int, k: int) -> Column:
    """Do t coordinates at least agree, as far as their lowest bits tell?  Equal ones always count; others by chance, one in 2 ** PLANES.

    The columns of the two sides are named with ``a`` and ``b`` before or after
    the dot; the full sets decide about the pairs that are left.
    """
    unlike = functools.reduce(Column.bitwiseOR, (F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in SKETCH))
    return F.bit_count(unlike) <= k - t


def sized(n: str, m: str, percent: int) -> Column:
    """May sets of these sizes be as alike?"""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def frequencies(nodes: DataFrame, k: int) -> np.ndarray:
    """How often coordinate-value pairs occur, in a fixed number of counters; those rare in every batch count 0.

    Any order of the pairs gives the same links; this one keeps frequent pairs
    out of the prefixes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = elements(np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, k)).ravel()
            value, n = np.unique(found, return_counts=True)
            own = n > 2
            yield pa.record_batch([pa.array((value[own] % np.uint64(COUNTERS)).astype(np.int32)), pa.array(n[own].astype(np.int64))], names=["bucket", "n"])

    table = np.zeros(COUNTERS, np.int64)
    for row in nodes.select("signature").mapInArrow(lean(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        table[row["bucket"]] = row["n"]
    return np.minimum(table, 2**31 - 1).astype(np.int32)


def postings(nodes: DataFrame, k: int, t: int) -> DataFrame:
    """(pair, node) for the k - t + 1 rarest coordinate-value pairs of each node: two nodes with t in common share one of these."""
    table = nodes.sparkSession.sparkContext.broadcast(frequencies(nodes, k))
    take = k - t + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = elements(np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, k))
            often = table.value[(found % np.uint64(COUNTERS)).astype(np.int64)]
            order = np.lexsort((found, often), axis=1)[:, :take]
            kept = np.take_along_axis(found, order, axis=1).ravel().view(np.int64)
            owner = batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), take)))
            yield pa.record_batch([pa.array(kept), owner], names=["pair", "node"])

    return nodes.select("node", "signature").mapInArrow(lean(post), "pair long, node binary")


def full_sets(keys: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, id_column: str, text: str) -> DataFrame:
    """(node, found): the shingle sets of the nodes in ``keys``, from their documents' texts."""
    wanted = keys.distinct().join(nodes.select("node", "doc"), "node").select(F.col("doc").alias("_doc")).distinct()
    read = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    read = read.join(wanted, F.col("_id").eqNullSafe(F.col("_doc")), "left_semi")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [shingles(ids, width) for ids in Words(batch.column("_text"), lower=True).each()]
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)))
            yield pa.record_batch([pa.array([set_key(x) for x in found], pa.binary()), sets], names=["node", "found"])

    return read.mapInArrow(lean(collect), "node binary, found array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("fa")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b")
    both = both.withColumn("_common", F.size(F.array_intersect("fa", "fb")))
    return both.where(100 * F.col("_common") >= percent * (F.size("fa") + F.size("fb") - F.col("_common"))).select("a", "b").distinct()


def left_over(sets: DataFrame, nodes: DataFrame, percent: int, k: int, t: int) -> DataFrame:
    """Every pair (a, b) of different roots that may still be linked, from (node, root, found).

    A link needs ceil(percent / 100 * n) common shingles, so it needs one among
    the rarest n - that + 1 of either side.  Shingles that one node alone has
    come first in that order: a node with too many of them links with nothing
    and makes no pair.  Of two sets the first common shingle stands at n - need
    + 1 at most in either, with need common shingles for a link of sets of their
    sizes.
    """
    rows = sets.select("node", F.xxhash64("root").alias("root"), F.size("found").alias("n"), F.explode("found").alias("value"))
    often = rows.groupBy("value").agg(F.count("*").cast("int").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("df > 1").select("value", "df", (F.col("lo") != F.col("hi")).alias("open"))
    shared = rows.join(often, "value")
    own = Window.partitionBy("node")
    shared = shared.withColumn("_alone", F.col("n") - F.count("*").over(own)).withColumn("_room", F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    shared = shared.where("_alone < _room").withColumn("at", F.col("_alone") + F.row_number().over(own.orderBy("df", "value")))
    rare = shared.where("at <= _room and open").select("value", "node", "root", "n", "at")
    rare = rare.join(nodes.select("node", *SKETCH), "node")
    other = rare.select("value", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("at").alias("bt"), *(F.col(c).alias(f"b{c}") for c in SKETCH))
    need = F.ceil((F.col("n") + F.col("nb")) * percent / (100 + percent))
    both = rare.join(other, "value").where(F.col("node") < F.col("b")).where("root <> rb").where(sized("n", "nb", percent)).where(collide("", "b", t, k))
    both = both.where((F.col("at") <= F.col("n") - need + 1) & (F.col("bt") <= F.col("nb") - need + 1))
    return both.select(F.col("node").alias("a"), "b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every linked node, by alternating large-star and small-star rounds until nothing changes."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    state, turn, written = None, 0, [f"{name}-0"]
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        turn += 1
        large = scratch.save(large, f"{name}-{turn}")
        scratch.drop(written.pop())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        edges = scratch.save(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        written.append(f"{name}-{turn}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    found = scratch.save(roots.union(roots.select("root", "root").distinct()), f"{name}-roots")
    scratch.drop(*written)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, rounds: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: (id, n_shingles, component_id, kept).

    Documents whose sets of ``width``-word shingles have 100 * intersection >=
    percent * union are linked; ``component_id`` is the least id in the connected
    component, and ``kept`` marks the document that has it.

    Equal sets are one node.  A node posts the rarest k - t + 1 of its k
    signature coordinates; a pair at the similarity has t equal coordinates but
    for a probability of 1e-6, and then shares a posting.  ``rounds`` passes link
    each list to one member: at first the one whose postings are shared most, so
    that the lists of a large group agree on it, later one drawn for that list; lists whose members are all in
    one component are skipped from then on.  The last pass takes every pair left
    that shares a list and is not in one component, so no link between
    components is lost, and no list of near copies is expanded into its pairs.
    Pairs are retained by the count of equal coordinates and confirmed on full
    sets.

    Texts that are null or without words have an empty set, link with nothing
    and are kept; shorter texts than ``width`` words are one shingle; repeated
    rows share a component; null ids are never the least id, and such rows are
    kept only if no document of their component has an id; an empty table gives
    no rows; other columns are not read.
    """
    return marked(docs, width, percent, k, rounds, id_column, text).select(id_column, "n_shingles", "component_id", "kept")


def marked(docs: DataFrame, width: int, percent: int, k: int = 64, rounds: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``near_duplicates``, the key of each row's set, and ``part``, the key of its component; null for a text without words."""
    scratch = Scratch(docs.sparkSession, files_for(text_bytes(docs, text)))
    t = match_threshold(k, percent / 100)
    every = scratch.save(signed(docs, width, k, id_column, text), "signatures")
    nodes = every.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.any_value("signature").alias("signature"), F.any_value("n_shingles").alias("n"))
    nodes = scratch.save(sketched(nodes, k), "nodes")
    posted = scratch.save(postings(nodes, k, t), "postings")
    weight = F.sum("n").over(Window.partitionBy("node"))  # over the k - t + 1 postings of a node at most
    sizes = posted.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(sizes, "pair").select("pair", "node", weight.alias("weight"))
    posted = scratch.save(shared.join(nodes.select("node", "n", *SKETCH), "node"), "shared")
    scratch.drop("postings")
    links, roots = None, None
    carried = ["pair", "node", "weight", "n", *SKETCH]
    for turn in range(rounds + 1):
        rooted = posted.withColumn("root", F.col("node"))
        if roots is not None:  # skip lists that are merged, and after the first pass those of two, which it has judged
            rooted = posted.join(roots, "node", "left").select(*carried, F.coalesce("root", "node").alias("root"))
        if turn or turn == rounds:
            several = rooted.groupBy("pair").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("_members")).where(f"lo <> hi and _members > {2 if turn else 1}").select("pair", "_members")
            rooted = rooted.join(several, "pair")
        if turn < rounds:
            first = F.struct("weight", F.xxhash64("node")) if turn == 0 else F.struct(F.xxhash64("node", "pair", F.lit(turn)))
            middle = rooted.groupBy("pair").agg(F.max_by(F.struct("node", "root", "n", *SKETCH), first).alias("m"))
            pairs = rooted.join(middle, "pair").where("root <> m.root").where(sized("n", "m.n", percent)).where(collide("", "m.", t, k))
            pairs = scratch.save(pairs.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct(), f"close-{turn}")
            if pairs.isEmpty():
                continue
            sets = scratch.save(full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, nodes, width, id_column, text), f"sets-{turn}")
        else:
            rooted = scratch.save(rooted, "open")
            short = rooted.where(F.col("_members") <= SHORT)
            other = short.select("pair", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), *(F.col(c).alias(f"b{c}") for c in SKETCH))
            direct = short.join(other, "pair").where("node < b and root <> rb").where(sized("n", "nb", percent)).where(collide("", "b", t, k))
            direct = scratch.save(direct.select(F.col("node").alias("a"), "b").distinct(), "direct")
            still = scratch.save(rooted.where(F.col("_members") > SHORT).select("node", "root").distinct(), "still")
            wanted = direct.select(F.explode(F.array("a", "b")).alias("node")).union(still.select("node"))
            if wanted.isEmpty():
                break
            sets = scratch.save(full_sets(wanted, docs, nodes, width, id_column, text).dropDuplicates(["node"]), f"sets-{turn}")
            pairs = scratch.save(direct.union(left_over(sets.join(still, "node"), nodes, percent, k, t)).distinct(), "last")
        found = confirmed(pairs, sets, percent)
        links = scratch.save(found if links is None else links.union(found), f"links-{turn}")
        scratch.drop(f"sets-{turn}")
        if not links.isEmpty():
            roots = components(links, scratch, f"parts-{turn}")
            scratch.drop(f"parts-{turn - 1}-roots")
        scratch.release()
    scratch.drop("nodes", "shared", "open", "direct", "still", "last", *(f"{x}-{turn}" for turn in range(rounds + 1) for x in ("close", "links")))
    if roots is None:
        joined = every.withColumn("part", F.col("node"))
    else:
        joined = every.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    least = joined.where("part is not null").groupBy("part").agg(F.min("doc").alias("_least"))
    joined = joined.join(least, "part", "left").withColumn("component_id", F.when(F.col("part").isNull(), F.col("doc")).otherwise(F.col("_least")))
    return joined.select(F.col("doc").alias(id_column), "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"), "node", "part")


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, all columns, of each group: one with the kept id; every row whose text is null or without words.

    Rows are told by id and by a key of the set of shingles, so one that shares
    its id with the kept row of another group goes with its own group.  Of
    repeated rows one stays; null ids come after all others; very long texts are
    taken whole; an empty table gives no rows; other columns, of any names, are
    returned as they are.
    """
    names, schema = docs.columns, docs.schema
    id_column, text = (f"c{names.index(c)}" for c in (id_column, text))
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    found = marked(docs, width, percent, id_column=id_column, text=text)
    kept = found.where("kept and part is not null").groupBy("part").agg(F.min(F.struct(id_column, "node")).alias("x"))
    kept = kept.select(F.col(f"x.{id_column}").alias("_kept"), F.col("x.node").alias("_set"))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = keyed(docs.where(worded), width, text)
    own = Window.partitionBy(id_column, "_node").orderBy(F.xxhash64(text), *(c for c, f in zip(docs.columns, schema, strict=True) if c not in (id_column, text) and f.dataType.typeName() not in ("map", "variant")))
    one = rows.join(kept, F.col(id_column).eqNullSafe(F.col("_kept")) & (F.col("_node") == F.col("_set")), "left_semi")
    one = one.withColumn("_nth", F.row_number().over(own)).where("_nth = 1")
    return one.select(*docs.columns).union(docs.where(~worded)).toDF(*names)
