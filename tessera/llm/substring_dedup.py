"""Exact removal of repeated passages: Rabin-Karp hashes of every window, counted in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, Scratch, Words, files_for, lean, mixed, slices, text_bytes, window_hashes

BUCKETS = 1 << 16  # of ids: those with an id that several rows have travel as a broadcast table, 65536 numbers at most
SECOND = 0xD6E8FEB86659FD93  # base of the second, independent window hash
WINDOWS, PLACES = 0, 1  # kinds of blocks


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as differences, byte by byte of their significance: bytes that hardly change compress to little."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        c = np.ascontiguousarray(c)
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes())
    return b"".join(out)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences, modulo 2**64, to the number before."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


class Windows:
    """Windows as rows: first hash, second hash, document id, key of the text (0 where the id is its row's alone), place."""

    KINDS = ("<u8", "u1", "<i8", "<u8", "<u4")

    def __init__(self, columns: list[np.ndarray]):
        self.columns = [np.asarray(c, k) for c, k in zip(columns, self.KINDS, strict=True)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, at: np.ndarray) -> Windows:
        return Windows([c[at] for c in self.columns])

    def block(self) -> bytes:
        h, c, d, k, p = self.columns
        return pack(h, c, steps(d), steps(k), p)

    @classmethod
    def read(cls, blocks: list[bytes]) -> Windows:
        """All rows of packed blocks; the list of blocks is emptied on the way."""
        columns = [np.empty(sum(int.from_bytes(b[:8], "little") for b in blocks), k) for k in cls.KINDS]
        at = 0
        while blocks:
            h, c, d, k, p = unpack(blocks.pop(), "<u8", "u1", "<u8", "<u8", "<u4")
            for column, x in zip(columns, (h, c, np.cumsum(d, dtype=np.uint64).view(np.int64), np.cumsum(k, dtype=np.uint64), p), strict=True):
                column[at : at + len(h)] = x
            at += len(h)
        return cls(columns)

    def judged(self) -> tuple[np.ndarray, np.ndarray]:
        """(later, first): windows whose words also start earlier, and one row for each (words, document) that may make others later.

        Earlier is a smaller id, or the same row and a smaller place.  Windows
        that are alone are ``first``; of equal ones the least place in each row
        with the least id is.
        """
        h, c, d, k, p = self.columns
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[1:] |= same
        again[:-1] |= same
        alone, own = order[~again], order[again]
        own = own[np.lexsort((p[own], k[own], d[own], c[own], h[own]))]
        h, c, d, k, p = (x[own] for x in self.columns)
        head = np.ones(len(own), bool)
        head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        row = head.copy()
        row[1:] |= (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        least = np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))
        start = np.maximum.accumulate(np.where(row, np.arange(len(own)), 0))
        later = (d != d[least]) | (p != p[start])
        return own[later], np.concatenate([alone, own[~later & row]])


def place_blocks(d: np.ndarray, k: np.ndarray, p: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """(partition, block) of windows to be removed, dealt by document."""
    part = (mixed(d.astype(np.uint64) ^ mixed(k)) % np.uint64(n)).astype(np.int32)
    order = np.lexsort((p, k, d, part))
    d, k, p, part = d[order], k[order], p[order], part[order]
    edge = np.flatnonzero(np.diff(part, prepend=np.int32(-1)) != 0)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True):
        yield int(part[a]), pack(steps(d[a:b]), steps(k[a:b]), p[a:b].astype("<u4"))


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "part", "block"])


def by_row(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, text, key): the key tells rows apart that share an id; 0 where no other row has the id.

    Which ids are shared is known up to their bucket, a table of bounded size;
    a key more does no harm.
    """
    bucket = F.pmod(F.xxhash64(F.col("_id")), F.lit(BUCKETS)).cast("int")
    read = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(id_column).alias("_own"), F.col(text).alias("_text")).withColumn("_bucket", bucket)
    several = read.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select(bucket.alias("_bucket")).distinct().withColumn("_shared", F.lit(True))
    read = read.join(F.broadcast(several), "_bucket", "left")
    return read.select("_own", "_id", "_text", F.when(F.col("_shared"), F.xxhash64("_text")).otherwise(F.lit(0).cast("long")).alias("_key"))


def repeated_windows(read: DataFrame, width: int, n: int) -> DataFrame:
    """(id, key, places): per row of ``by_row``, packed unsigned 32-bit starts of windows that also start earlier, sorted.

    Each batch of texts judges its own windows first, a partial aggregation: of
    equal windows only the first goes on, so a window that a third of all
    documents share is one row a batch.  The others are dealt out by hash and
    judged in one task with all of the same hash; what is found goes back by
    document.  Rows travel packed, in a block for each batch and partition:
    about 11 bytes a window, where a row of Spark's takes 40.

    Two windows are taken for equal if 72 bits of two independent hashes and the
    number of their partition, of further bits of the second, agree: over 30 GB
    (8e9 windows, 2000 partitions or more) less than 1e-5 false pairs are
    expected, over 100 TB about 0.01.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 4_000_000):
            found = Words(batch.column("_text"))
            owner, place = found.starts(width)
            if not len(owner):
                continue
            at = found.begins[owner] + place
            h = window_hashes(found.hashes, width)[at]
            g = window_hashes(mixed(found.hashes ^ np.uint64(SECOND)), width, SECOND)[at]
            ids, keys = batch.column("_id").fill_null(NO_ID).to_numpy(), batch.column("_key").to_numpy().view(np.uint64)
            all_of = Windows([h, g & np.uint64(255), ids[owner], keys[owner], place])
            later, first = all_of.judged()
            rows = [(PLACES, *x) for x in place_blocks(ids[owner[later]], keys[owner[later]], place[later], n)] if len(later) else []
            part = ((g[first] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
            order = np.lexsort((first, part))
            first, part = first[order], part[order]
            edge = np.flatnonzero(np.diff(part, prepend=np.int32(-1)) != 0)
            rows += [(WINDOWS, int(part[a]), all_of.take(first[a:b]).block()) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True)]
            yield batch_of(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            kind = batch.column("kind")
            yield batch.filter(pc.equal(kind, PLACES))
            blocks += batch.column("block").filter(pc.equal(kind, WINDOWS)).to_pylist()
        every = Windows.read(blocks)
        later = every.judged()[0] if len(every) else ()
        if len(later):
            _, _, d, k, p = (c[later] for c in every.columns)
            del every
            yield batch_of([(PLACES, *x) for x in place_blocks(d, k, p, n)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for b in batch.column("block").to_pylist():
                d, k, p = unpack(b, "<u8", "<u8", "<u4")
                parts.append((np.cumsum(d, dtype=np.uint64).view(np.int64), np.cumsum(k, dtype=np.uint64), p))
        if not parts:
            return
        d, k, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((p, k, d))
        d, k, p = d[order], k[order], p[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        first = new.copy()
        first[1:] |= p[1:] != p[:-1]  # equal rows find the same places
        d, k, p, new = d[first], k[first], p[first], new[first]
        edge = np.flatnonzero(new)
        stops = np.append(edge[1:], len(d))
        for at in range(0, len(edge), 20_000):
            own, stop = edge[at : at + 20_000], stops[at : at + 20_000]
            yield pa.record_batch([with_nulls(pa.array(d[own])), pa.array(k[own].view(np.int64)), pa.array([p[a:b].tobytes() for a, b in zip(own.tolist(), stop.tolist(), strict=True)], pa.binary())], names=["_id", "_key", "_places"])

    schema = "kind int, part int, block binary"
    dealt = read.select("_id", "_key", "_text").mapInArrow(lean(windows), schema).repartitionById(n, "part")
    met = dealt.mapInArrow(lean(meet), schema).repartitionById(n, "part")
    return met.mapInArrow(lean(gather), "_id long, _key long, _places binary")


def with_nulls(ids: pa.Array) -> pa.Array:
    """The number that stood for a missing id becomes null again."""
    return pc.if_else(pc.equal(ids, NO_ID), pa.scalar(None, pa.int64()), ids)


def intervals(places: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Window starts, sorted, to maximal word intervals that they cover."""
    if not len(places):
        return []
    new = np.flatnonzero(np.diff(places, prepend=-width - 1) > width)
    last = np.append(new[1:], len(places)) - 1
    return list(zip(places[new].tolist(), (places[last] + width).tolist(), strict=True))


def remove_repeats(docs: DataFrame, width: int = 20, id_column: str = "doc_id", text: str = "text", bytes_each: int = 8 << 20) -> DataFrame:
    """Per row: (id, n_words, n_removed, removed, kept).

    ``removed`` are the maximal intervals (start, stop) of words covered by a
    window of ``width`` words that also starts earlier, in a document with a
    smaller id or before in the same one; ``kept`` are the other words, joined
    by one space.  Windows are judged on the input.  Partitions of windows
    follow the size of the text, ``bytes_each`` of it.

    A null id sorts after all others.  Rows that share an id, or have none, are
    told apart by their texts and none is earlier than another, so they remove
    words from themselves and from documents with greater ids only; equal rows
    get equal results.  Null and empty texts have no words; a text of fewer than
    ``width`` words stays whole; a very long text is taken whole, in a batch of
    its own; an empty table gives no rows; other columns are not read.  Ids must
    be integers below 2**63 - 1, which stands for null.
    """
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    scratch = Scratch(spark, files_for(size))
    read = by_row(docs, id_column, text)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))
    found = scratch.save(repeated_windows(read, width, n), "repeats")
    scratch.release()
    same = F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_key") == F.col("_fkey"))
    joined = read.join(found.select(F.col("_id").alias("_fid"), F.col("_key").alias("_fkey"), "_places"), same, "left").select("_own", "_text", "_places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            n_words, n_removed, removed, kept = [], [], [], []
            for t, places in zip(batch.column("_text").to_pylist(), batch.column("_places").to_pylist(), strict=True):
                ws = t.encode().split() if t else []
                spans = intervals(np.frombuffer(places, "<u4").astype(np.int64), width) if places else []
                out, at = [], 0
                for a, b in spans:
                    out += ws[at:a]
                    at = b
                out += ws[at:]
                n_words.append(len(ws))
                n_removed.append(len(ws) - len(out))
                removed.append([{"start": a, "stop": b} for a, b in spans])
                kept.append(b" ".join(out).decode())
            yield pa.record_batch([batch.column("_own"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.string())], names=["_own", "n_words", "n_removed", "removed", "kept"])

    kind = docs.schema[id_column].dataType.simpleString()
    return joined.coalesce(files_for(size)).mapInArrow(lean(cut), f"_own {kind}, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept string").withColumnRenamed("_own", id_column)
