"""Similarity join of shingle sets with adaptive multi-match prefixes.

All shingles have one global order, rare ones first.  If two sets have o
shingles in common, the first l of these stand among the first n - o + l of
either set, for every l up to o.  A set therefore posts, for an l of its own,
its first n - need + l shingles, need being the least overlap of any link; two
sets are compared only if they share as many posted shingles as the smaller of
their two l.  A larger l costs longer lists and spares comparisons: each set
takes the l at which the estimated sum of both is least.

A meeting is not even counted where the parities of the two sets' shingles in
256 classes differ in more classes than linked sets have shingles apart: every
class that differs holds one such shingle at least, so this loses no link.  The
pairs that meet often enough are looked at in 1024 classes before their full sets
are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, Words, files_for, lean, slices, text_bytes
from tessera.llm.near_dedup import components, confirmed, set_key, shingles, sized

COUNTERS = 1 << 20  # the counts that order the shingles: 4 MB, however many documents
BITS = 1 << 26  # of the map of sets that are read again: 8 MB, however many
LONGEST = 16  # matches that a set may ask for
PARITY = [f"p{j}" for j in range(4)]  # a set's parities in 256 classes, 64 a column


def occurrences(texts: DataFrame, width: int) -> np.ndarray:
    """In how many documents shingles occur, in a fixed number of counters shared by hash.

    Every shingle of every set is counted: a task sends each of its counters
    once.  Shared counters blur the counts, and any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices([batch], "_text"):
                found = [places(shingles(ids, width)) for ids in Words(part.column("_text"), lower=True).each()]
                total += np.bincount(np.concatenate(found), minlength=COUNTERS)
        used = np.flatnonzero(total)
        for at in range(0, len(used), 1 << 16):
            own = used[at : at + (1 << 16)]
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["bucket", "n"])

    summed = texts.select("_text").mapInArrow(lean(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.int64)
    table[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return np.minimum(table, 2**31 - 1).astype(np.int32)


def places(found: np.ndarray) -> np.ndarray:
    return (found % np.uint64(COUNTERS)).astype(np.int64)


def matches(others: np.ndarray, n: int, need: int) -> int:
    """The l of a set of n shingles whose lists, in order, have about so many other members.

    For each l the lists of the prefix are read and, of the sets met, those met
    l times are compared, a l-th of all meetings at most; a comparison reads
    both sets.
    """
    read = np.cumsum(others)[n - need : n - need + min(LONGEST, need)]
    l = np.arange(1, len(read) + 1)  # noqa: E741
    return 1 + int(np.argmin(read * (1 + 2 * n / l) + l))


def parities(found: np.ndarray, classes: int = 256) -> np.ndarray:
    return np.packbits((np.bincount((found & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1).astype(np.uint8)).view("<i8")


def prefixed(texts: DataFrame, width: int, percent: int, table) -> DataFrame:
    """(doc, n, node, weight, l, parities, wide, prefix) per document: its set's name and size, how common its shingles are, and what it posts."""
    kind = texts.schema["_id"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = table.value
        noise = int(np.median(often))  # of a counter: what other shingles put in
        for batch in slices(batches, "_text"):
            sizes, node, weight, asked, odd, wide, prefix = [], [], [], [], [], [], []
            for ids in Words(batch.column("_text"), lower=True).each():
                found = shingles(ids, width)
                n = len(found)
                sizes.append(n)
                node.append(set_key(found) if n else None)
                odd.append(parities(found))
                wide.append(parities(found, 1024))
                if not n:
                    weight.append(0.0), asked.append(0), prefix.append(found)
                    continue
                count = often[places(found)]
                order = np.lexsort((found, count))
                need = -(-percent * n // 100)
                own = matches(np.maximum(count[order].astype(np.int64) - noise - 1, 0), n, need)
                weight.append(float(count.mean())), asked.append(own), prefix.append(found[order[: n - need + own]])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)), pa.array(np.concatenate(prefix).view(np.int64)))
            columns = [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(node, pa.binary()), pa.array(weight, pa.float64()), pa.array(asked, pa.int32()), *map(pa.array, np.stack(odd, axis=1)), pa.array([x.tolist() for x in wide], pa.list_(pa.int64())), lists]
            yield pa.record_batch(columns, names=["doc", "n", "node", "weight", "l", *PARITY, "wide", "prefix"])

    return texts.mapInArrow(lean(post), f"doc {kind}, n long, node binary, weight double, l int, {', '.join(f'{c} long' for c in PARITY)}, wide array<long>, prefix array<long>")


def near_enough(m: str, percent: int) -> Column:
    """May the shingle at hand be one of the first l that the row and the set ``m`` have in common, and the two be linked for all their parities tell?"""
    need = F.expr(f"({percent} * (n + {m}.n) + {99 + percent}) div {100 + percent}")
    l = F.least("l", f"{m}.l")  # noqa: E741
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{m}.{c}"))) for c in PARITY), F.lit(0))
    return (F.col("at") <= F.col("n") - need + l) & (F.col(f"{m}.at") <= F.col(f"{m}.n") - need + l) & (apart <= F.col("n") + F.col(f"{m}.n") - 2 * need)


def met(pairs: DataFrame, often: Column) -> DataFrame:
    """The distinct (a, b) of pairs of a row and a set ``m`` that meet as often as asked."""
    l = F.least("l", "m.l")  # noqa: E741
    counted = pairs.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b"), l.alias("l")).groupBy("a", "b").agg(F.count("*").alias("times"), F.max("l").alias("l"))
    return counted.where(F.col("times") >= often).select("a", "b")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs that may be linked for all that parities in 1024 classes tell."""
    for x in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")), x)
    need = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return pairs.where(apart <= F.col("na") + F.col("nb") - 2 * need).select("a", "b")


def full_sets(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, found): the shingle sets of the documents in ``ids`` (doc), from the texts, and perhaps of a few more, some more than once.

    A map of bits says which documents to read, so that no text is shuffled.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bit = F.shiftright(F.crc32(key("doc").cast("binary")), 6)
    words = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("bits")).toArrow()
    marks = np.zeros(BITS >> 6, np.uint64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    table = texts.sparkSession.sparkContext.broadcast(marks)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in slices(batches, "_text"):
            at = np.array([zlib.crc32(x.encode()) >> 6 for x in batch.column("_key").to_pylist()], np.int64)
            batch = batch.filter(pa.array((own[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            found = {set_key(x): x for ids in Words(batch.column("_text"), lower=True).each() if len(x := shingles(ids, width))}
            sizes = [len(x) for x in found.values()]
            values = np.concatenate(list(found.values())).view(np.int64) if found else np.empty(0, np.int64)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
            yield pa.record_batch([pa.array(list(found), pa.binary()), sets], names=["node", "found"])

    return texts.select(key("_id").alias("_key"), "_text").mapInArrow(lean(collect), "node binary, found array<long>")


def linked(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: (id, n_shingles, component_id), the least id that links reach from it, itself included.

    Documents link whose sets of ``width``-word shingles have 100 * intersection
    >= percent * union.  Equal sets are one node; a node is named by its set.
    Before all pairs are counted, ``rounds`` passes compare each list's members
    with one of them: first the one whose shingles are the most common, so that
    the lists of a large group agree on it, then one drawn for each list.  The
    last pass counts the meetings of every pair that is not in one component by
    then, so no link between components is lost, and a group of near copies is
    not expanded into its pairs.  Each comparison is made on full sets.

    Texts that are null or without words have an empty set and link with
    nothing; shorter texts than ``width`` words are one shingle; repeated rows
    share a component; null ids are never the least id; very long texts are
    taken whole; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, files_for(text_bytes(docs, text)))
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    table = docs.sparkSession.sparkContext.broadcast(occurrences(texts, width))
    every = scratch.save(prefixed(texts, width, percent, table), "prefixes")
    held = ["n", "weight", "l", *PARITY, "wide"]
    full = every.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.any_value(F.struct(*held, "prefix")).alias("x")).select("node", "doc", "x.*")
    full = scratch.save(full, "full")
    every = scratch.save(every.select("doc", F.col("n").alias("n_shingles"), "node"), "every")
    scratch.drop("prefixes")
    posted = full.select("node", F.posexplode("prefix").alias("at", "token")).withColumn("at", F.col("at") + 1)
    several = scratch.save(posted.groupBy("token").agg(F.count("*").alias("_members")).where("_members > 1").select("token"), "several")
    shared = scratch.save(posted.join(several, "token"), "shared")
    nodes = scratch.save(full.select("node", "doc", *held), "nodes")
    scratch.drop("full", "several")
    links, roots = None, None
    for turn in range(rounds + 1):
        rooted = shared.withColumn("root", F.col("node"))
        if turn:  # lists in one component are done
            if roots is not None:
                rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            rooted = scratch.save(rooted, f"rooted-{turn}")
            unlike = rooted.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("token")
            rooted = rooted.join(unlike, "token")
        rooted = scratch.save(rooted.join(nodes.drop("doc", "wide"), "node"), f"open-{turn}")
        scratch.drop(f"rooted-{turn}")
        member = F.struct("node", "root", "n", "l", "at", *PARITY)
        if turn < rounds:
            first = F.struct("weight", "node") if turn == 0 else F.struct(F.xxhash64("node", "token", F.lit(turn)))
            middle = rooted.groupBy("token").agg(F.max_by(member, first).alias("m"))
            pairs = rooted.join(middle, "token").where("root <> m.root")
        else:
            pairs = rooted.join(rooted.select("token", member.alias("m")), "token").where("root <> m.root and node < m.node")
        pairs = pairs.where(sized("n", "m.n", percent)).where(near_enough("m", percent))
        often = F.lit(1) if 0 < turn < rounds else F.col("l")  # a list's own member meets a set in that list alone
        pairs = scratch.save(likely(met(pairs, often), nodes, percent), f"pairs-{turn}")
        if not pairs.isEmpty():
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc"), "node")
            sets = scratch.save(full_sets(wanted, texts, width), f"sets-{turn}")
            found = confirmed(pairs, sets, percent)
            links = scratch.save(found if links is None else links.union(found), f"links-{turn}")
            roots = components(links, scratch, f"parts-{turn}")
            scratch.drop(*(f"{x}-{before}{y}" for before in range(turn) for x, y in (("links", ""), ("parts", "-roots"))))
        scratch.drop(f"open-{turn}", f"pairs-{turn}", f"sets-{turn}")
        scratch.release()
    scratch.drop("nodes", "shared")
    table.unpersist()
    joined = every.withColumn("part", F.col("node")) if roots is None else every.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    least = joined.where("part is not null").groupBy("part").agg(F.min("doc").alias("_least"))
    reached = joined.join(least, "part", "left").withColumn("component_id", F.when(F.col("part").isNull(), F.col("doc")).otherwise(F.col("_least")))
    return reached.select(F.col("doc").alias(id_column), "n_shingles", "component_id")


ORACLE = r"""
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) s from words),
rows as materialized (select doc_id, len(s) n, unnest(s) x from sets),
common as materialized (
  select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) c from rows a join rows b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from common where 100 * c >= 85 * (na + nb - c)),
both_ways as materialized (select a, b from links union all select b, a from links),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b)
select doc_id, len(s)::bigint n_shingles, coalesce(least(doc_id, (select min(b) from reach where a = doc_id)), doc_id) component_id from sets
"""
