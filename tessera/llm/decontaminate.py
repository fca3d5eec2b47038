"""Benchmark decontamination with suffix arrays over shards of the training documents."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, held, lean, slices

#: Words are runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case.
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
MATCH = "array<struct<item_id:string,item_start:int,start:int,length:int>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


class Tests:
    """A block of benchmark items: its vocabulary as codes from 1, and the window at every suffix as bytes that sort as words do."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width, self.code = width, {}
        self.names = [name for name, _ in items]
        low, owner, at, wide = [np.empty((0, width), np.int64)], [], [], []
        for k, (_, text) in enumerate(items):
            codes = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words(text)], np.int64)
            n = min(width, len(codes))
            if n:
                windows = np.zeros((len(codes) - n + 1, width), np.int64)
                windows[:, :n] = np.lib.stride_tricks.sliding_window_view(codes, n)
                low.append(windows)
                owner.append(np.full(len(windows), k))
                at.append(np.arange(len(windows)))
                wide.append(np.full(len(windows), n))
        self.owner, self.at, self.wide = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (owner, at, wide))
        self.least = int(self.wide.min()) if len(self.wide) else 0
        least = np.concatenate(low).astype(">u4")
        most = np.where(np.arange(width) < self.wide[:, None], least, np.uint32(0xFFFFFFFF)).astype(">u4")
        self.low, self.high = (np.ascontiguousarray(x).view(f"S{4 * width}").ravel() for x in (least, most))

    def search(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every window in a shard, as (window, place).

        ``stream`` holds the shard's words as codes, 0 for other words and
        between documents.  Its suffix array keeps the suffixes that begin with
        as many benchmark words as the shortest window has: no other can match.
        """
        if not len(self.low):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        zero = np.flatnonzero(np.append(stream, 0) == 0)
        known = np.repeat(zero, np.diff(zero, prepend=-1))[: len(stream)] - np.arange(len(stream))
        suffix = np.flatnonzero(known >= self.least)
        if not len(suffix):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        reach = np.arange(self.width)
        keys = np.append(stream, np.zeros(self.width, stream.dtype))[suffix[:, None] + reach]
        keys[reach >= known[suffix][:, None]] = 0
        keys = np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * self.width}").ravel()
        order = np.argsort(keys, kind="stable")
        suffix, keys = suffix[order], keys[order]
        first, last = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        found = np.flatnonzero(last > first)
        sizes = (last - first)[found]
        window = np.repeat(found, sizes)
        inner = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return window, suffix[np.repeat(first[found], sizes) + inner]

    def longest(self, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Merge occurrences that follow one another in both texts: (item, item start, place, length) of maximal matches."""
        item, at = self.owner[window], self.at[window]
        order = np.lexsort((at, place - at, item))
        item, at, place, wide = item[order], at[order], place[order], self.wide[window][order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | ((place - at)[1:] != (place - at)[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(item)))
        return item[head], at[head], place[head], n - 1 + wide[head]


def blocks_of(benchmark: DataFrame, item_column: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items with a text in blocks of about ``block_bytes`` of text; the driver holds one block at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row["t"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    yield block


class Shard:
    """A batch of documents searched for a block of the benchmark."""

    def __init__(self, texts: list[str | None], tests: Tests):
        found = [words(t) for t in texts]
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.matches: list[list[dict]] = [[] for _ in texts]
        get = tests.code.get
        stream = np.zeros(int((self.sizes + 1).sum()), np.int64)
        for begin, ws in zip(self.begin.tolist(), found, strict=True):
            stream[begin : begin + len(ws)] = np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws))
        for item, at, start, length in zip(*tests.longest(*tests.search(stream)), strict=True):
            doc = int(np.searchsorted(self.begin, start, "right")) - 1
            self.matches[doc].append({"item_id": tests.names[item], "item_start": int(at), "start": int(start - self.begin[doc]), "length": int(length)})


def hit(matches: list[dict]) -> int:
    """Words inside any match."""
    n, end = 0, 0
    for a, b in sorted((m["start"], m["start"] + m["length"]) for m in matches):
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


class Search:
    """One block, broadcast, and what ``mapInArrow`` does with it; a worker builds the block's windows once and keeps one block."""

    def __init__(self, spark: SparkSession, block: list[tuple[str, str]], width: int):
        self.key, self.width = uuid.uuid4().hex, width
        self.sent = spark.sparkContext.broadcast(block)

    def shard(self, texts: pa.Array) -> Shard:
        return Shard(texts.to_pylist(), held(self.key, lambda: Tests(self.sent.value, self.width)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: (id, n_words, n_hit, items, matches).

    A window is ``width`` consecutive words of an item, or all words of a
    shorter one.  Each batch of documents is a shard with a suffix array of its
    words; every suffix of the benchmark is binary-searched in every shard.
    ``matches`` are the longest verbatim matches with their places, ``n_hit``
    counts document words inside any, ``items`` are the ids found.

    The benchmark is broadcast in blocks of ``block_bytes`` of text (one item at
    least), one block a pass, so neither the driver nor a worker holds more than
    one, however large the benchmark is.  One block is one narrow pass without a
    shuffle; with more, each pass returns only the rows it finds something in,
    and these are joined to the documents at the end.

    Null and empty texts, of either side, have no words and no match; very long
    texts are a shard of their own; an empty benchmark matches nothing; a null
    item id counts as the empty string; items that repeat an id count once;
    repeated documents are searched each; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    read = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    blocks = blocks_of(benchmark, item_column, item_text, block_bytes)
    block, more = next(blocks), next(blocks, None)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            s = first.shard(batch.column("_text"))
            yield pa.record_batch([batch.column("_id"), pa.array(s.sizes), *counted(s.matches)], names=["_id", "n_words", "n_hit", "items", "matches"])

    def counted(matches: list[list[dict]]) -> tuple[pa.Array, ...]:
        return pa.array(list(map(hit, matches)), pa.int64()), pa.array([sorted({m["item_id"] for m in x}) for x in matches], pa.list_(pa.string())), pa.array(matches, _MATCH)

    first = Search(spark, block, width)
    schema = f"_id {kind}, n_words long, n_hit long, items array<string>, matches {MATCH}"
    if more is None:
        return read.mapInArrow(lean(every, first.key), schema).withColumnRenamed("_id", id_column)

    def some(search: Search) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text"):
                matches = search.shard(batch.column("_text")).matches
                own = [i for i, m in enumerate(matches) if m]
                yield pa.record_batch([batch.column("_row").take(pa.array(own, pa.int64())), pa.array([matches[i] for i in own], _MATCH)], names=["_row", "_matches"])

        return rows.select("_row", "_text").mapInArrow(lean(found, search.key), f"_row long, _matches {MATCH}")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            matches = [sum(x or [], []) for x in batch.column("_all").to_pylist()]
            n_words = [len(words(t)) for t in batch.column("_text").to_pylist()]
            yield pa.record_batch([batch.column("_id"), pa.array(n_words, pa.int64()), *counted(matches)], names=["_id", "n_words", "n_hit", "items", "matches"])

    scratch = Scratch(spark)
    rows = scratch.save(read.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts, search, n = [], first, 0
    while search is not None:
        parts.append(scratch.save(some(search), f"found-{n}"))
        search.sent.unpersist()
        n += 1
        search = None if more is None else Search(spark, more, width)
        more = next(blocks, None) if more is not None else None
    together = functools.reduce(DataFrame.union, parts).groupBy("_row").agg(F.collect_list("_matches").alias("_all"))  # of one row, its matches
    joined = rows.join(together, "_row", "left").select("_id", "_text", "_all")
    return joined.mapInArrow(lean(merged), schema).withColumnRenamed("_id", id_column)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The documents, all columns, in which no benchmark window occurs; cases as in ``find_leaks``.

    A pass a block: all but the last write what they leave.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text)
    schema = docs.schema

    def without(left: DataFrame, search: Search) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                yield batch.filter(pa.array([not m for m in search.shard(batch.column(at)).matches], pa.bool_()))

        return left.mapInArrow(lean(clean, search.key), schema)

    blocks = blocks_of(benchmark, item_column, item_text, block_bytes)
    block, more, n = next(blocks), next(blocks, None), 0
    while more is not None:
        scratch, search = Scratch(spark), Search(spark, block, width)
        docs = scratch.save(without(docs, search), f"left-{n}")
        search.sent.unpersist()
        block, more, n = more, next(blocks, None), n + 1
    return without(docs, Search(spark, block, width))
