"""Helpers shared by the operators: scratch tables, Arrow batches, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: ASCII white space, the separators of "words" here: space, \t, \n, \v, \f, \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"
NO_ID = (1 << 63) - 1  # a null doc_id sorts after every other


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; where it is unset and all run in one process, as in tests, one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:" + tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Shuffle files of a finished query go with it, not when the driver next collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    ``save`` writes a frame and reads it back, ``drop`` deletes tables that no
    remaining plan reads.  A table that a returned plan reads stays as long as
    that plan may run: the driver deletes the folder when it ends.  No table is
    written in more than ``files`` files, where that is given: small tables in
    many files cost more than their rows.
    """

    def __init__(self, spark: SparkSession, files: int | None = None):
        self.spark, self.files = spark, files
        self.root = f"{scratch_root(spark)}/tables-{uuid.uuid4().hex}"
        _delete_at_exit(spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEAN, None)
        try:
            self.spark.conf.set(CLEAN, "true")
            (df.coalesce(self.files) if self.files else df).write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(CLEAN) if before is None else self.spark.conf.set(CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def release(self) -> None:
        """Let Spark delete shuffle files of finished jobs now rather than when the driver next collects garbage."""
        gc.collect()
        with contextlib.suppress(Exception):
            self.spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


_held: dict = {}


def held(key, build: Callable):
    """What a worker keeps between batches and tasks: one thing at a time, so that a worker's memory does not add up over operators."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def lean(step: Callable, key=None) -> Callable:
    """A function for ``mapInArrow`` that first forgets what other operators held, and gives freed memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(key)
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def forget_others(key) -> None:
    if key not in _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on with what its allocators keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a column: one pass over it, one number back."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def files_for(size: int, bytes_each: int = 16 << 20, least: int = 12) -> int:
    """Files that tables made from so many bytes of text may take."""
    return max(least, -(-size // bytes_each))


def slices(batches: Iterable[pa.RecordBatch], column: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``chars`` bytes of ``column`` at most, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, room = 0, 0
        for i, n in enumerate(sizes.tolist()):
            room += n
            if room > chars and i > at:
                yield batch.slice(at, i - at)
                at, room = i, n
        if batch.num_rows > at:
            yield batch.slice(at)


class Words:
    """The words of a batch of texts: 64-bit ``hashes`` of all words in order, ``sizes`` by text, ``begins`` of each.  No word becomes a Python object."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        found = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        self.hashes, full = word_hashes(found.flatten())
        ends = np.concatenate([[0], np.cumsum(full)])
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))])
        self.sizes = np.diff(ends[offsets])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def each(self) -> Iterator[np.ndarray]:
        for a, n in zip(self.begins.tolist(), self.sizes.tolist(), strict=True):
            yield self.hashes[a : a + n]

    def starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in it) of every window of ``width`` words."""
        n = np.maximum(self.sizes - width + 1, 0)
        owner = np.repeat(np.arange(len(n)), n)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def word_hashes(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings that are not empty, and which are not: eight bytes a step, mixed with what came before."""
    data = found.buffers()[2]
    edge = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, 4 * found.offset).astype(np.int64)
    sizes = np.diff(edge)
    full = sizes > 0
    at, left = edge[:-1][full], sizes[full]
    h = mixed(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bytes_ = np.concatenate([np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(bytes_) - 7,), "<u8", bytes_, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    own = np.arange(len(at))
    while len(own):
        h[own] = mixed(h[own] ^ (eight[at[own]] & keep[np.minimum(left[own], 8)]))
        own = own[left[own] > 8]
        at[own] += 8
        left[own] -= 8
    return h, full


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(ids: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of every ``width`` consecutive word hashes; none if there are fewer."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    b = np.uint64(base)
    for k in range(width):
        out = out * b + ids[k : k + n]
    return mixed(out)
