"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import machine
from tessera.llm.common import Scratch, files_for, lean, slices, text_bytes

PIECE = "_id {}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize each text, append ``end_id`` and cut what is longer than ``room``: the first piece takes the remainder.

    Returns (id, piece, start, length, ids_crc32); the crc is of the ids as
    little-endian unsigned 32-bit numbers.  Null texts count as empty: one piece
    that holds ``end_id`` alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        for batch in slices(batches, "_text"):
            found, each = m.split(batch.column("_text").to_pylist(), scan=False)
            ids = list(map(m.coded.__getitem__, found))
            out: list[list[int]] = [[], [], [], [], []]
            at = 0
            for row, k in enumerate(each):
                data = memoryview(b"".join(ids[at : at + k]) + end)
                at += k
                start, stop = 0, len(data) // 4
                take = (stop - 1) % room + 1
                piece = 0
                while start < stop:
                    for column, x in zip(out, (row, piece, start, take, zlib.crc32(data[4 * start : 4 * (start + take)])), strict=True):
                        column.append(x)
                    start, piece, take = start + take, piece + 1, room
            rows, *rest = out
            yield pa.record_batch([batch.column("_id").take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), *[pa.int64()] * 3), strict=True))], names=["_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).mapInArrow(lean(cut, tokenizer), PIECE.format(kind))


class Solution(NamedTuple):
    """``plan``: (copies, pieces of each length in one sequence); ``fractional``: size of the linear program's cover; ``bound``: no packing has fewer."""

    plan: list[tuple[int, dict[int, int]]]
    fractional: float
    bound: int


def knapsack(value: np.ndarray, room: int) -> tuple[float, list[int]]:
    """Knapsack pricing: what the best pattern is worth, and for each capacity a piece of its best pattern (0: a place stays empty).

    Dynamic programming over capacities; ``value[k]`` is what a piece of length
    k is worth, minus infinity where there is none.  With the picks, the best
    pattern that holds a given piece takes a few steps, so one program prices a
    pattern for every length.
    """
    best, pick = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    value = np.append(value[1:], 0.0)
    value[room:] = -np.inf
    back = np.zeros(room + 1)  # back[room - c] = best[c]
    for c in range(1, room + 1):
        worth = back[room - c + 1 :] + value[:c]
        k = int(worth.argmax())
        if worth[k] > best[c - 1]:
            best[c], pick[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
        back[room - c] = best[c]
    return float(best[room]), pick.tolist()


def pattern_with(length: int, pick: list[int], room: int) -> dict[int, int]:
    """The best pattern that holds a piece of ``length``, as pieces by length."""
    out, c = {length: 1}, room - length
    while c > 0:
        if k := pick[c]:
            out[k] = out.get(k, 0) + 1
        c -= k or 1
    return out


def relax(need: np.ndarray, room: int, rounds: int = 60, rate: float = 2.0) -> tuple[dict[tuple, float], float]:
    """The configuration linear program by multiplicative weights: (copies of each pattern, lower bound).

    The program asks for the least sum of copies so that every length is covered
    as often as it occurs.  In each round a knapsack program prices, for every
    length whose cover is behind the round's share, the best pattern that holds
    it, and copies of it are added until it is not.  The weight of a length
    falls exponentially with how far it is covered beyond its share, so that
    patterns turn to pieces that are short.  Weights divided by the worth of the
    best pattern are feasible for the dual program, so each round proves a bound.
    """
    lengths = np.flatnonzero(need)
    base = np.log(lengths * (1 + lengths / room / 4))  # long pieces, hard to place late, weigh a little more than their places
    covered, copies = np.zeros(room + 1), {}
    over, bound = np.zeros(len(lengths)), float(need @ np.arange(room + 1)) / room
    for turn in range(1, rounds + 1):
        log = base - rate * over
        value = np.full(room + 1, -np.inf)
        value[lengths] = np.exp(log - log.max())
        worth, pick = knapsack(value, room)
        bound = max(bound, float(need[lengths] @ value[lengths]) / worth)
        goal = need * (turn / rounds)
        for k in lengths[::-1].tolist():
            if (behind := goal[k] - covered[k]) > 1e-9:
                pattern = pattern_with(k, pick, room)
                n = behind / pattern[k]
                for j, a in pattern.items():
                    covered[j] += n * a
                key = tuple(sorted(pattern.items(), reverse=True))
                copies[key] = copies.get(key, 0.0) + n
        over = covered[lengths] / goal[lengths] - 1
    return copies, bound


def rounded(need: np.ndarray, room: int, copies: dict[tuple, float], least: int, batch: int = 8) -> dict[tuple, int]:
    """Whole copies that cover the histogram exactly.

    Of each pattern of the linear program that fills ``least`` places its copies
    are taken, rounded down, as far as there are pieces; the fullest first.  The
    pieces left are packed from the longest on: the best pattern that holds it
    at prices renewed after every ``batch`` lengths, of pieces that are there,
    filled with the longest that still fit.
    """
    rest, lengths = need.copy(), np.arange(room + 1)
    plan: dict[tuple, int] = {}

    def take(key: tuple, most: int) -> None:
        n = min(most, *(int(rest[k]) // a for k, a in key))
        if n > 0:
            plan[key] = plan.get(key, 0) + n
            for k, a in key:
                rest[k] -= n * a

    places = {key: sum(k * a for k, a in key) for key in copies}
    for key in sorted((k for k in copies if places[k] >= least), key=lambda k: (-places[k], -copies[k], k)):
        take(key, int(copies[key]))
    start, all_places = np.maximum(rest, 1), max(1, int(rest @ lengths))
    while rest.any():
        behind = rest / start - (rest @ lengths) / all_places
        price = lengths * (1 + lengths / room / 4) * np.exp(0.1 * behind)
        _, pick = knapsack(np.where(rest > 0, price, -np.inf), room)
        for k in np.flatnonzero(rest)[: -batch - 1 : -1].tolist():
            while rest[k]:
                pattern, space = {}, room
                for j, a in pattern_with(k, pick, room).items():
                    if a := min(a, int(rest[j])):
                        pattern[j] = a
                        space -= a * j
                for j in np.flatnonzero(rest[: space + 1])[::-1].tolist():
                    if j <= space and (a := min(space // j, int(rest[j]) - pattern.get(j, 0))) > 0:
                        pattern[j] = pattern.get(j, 0) + a
                        space -= a * j
                take(tuple(sorted(pattern.items(), reverse=True)), 1 << 62)
    return plan


def solve(counts: dict[int, int], room: int) -> Solution:
    """Sequences for a histogram of lengths, 1 to ``room``: the configuration program solved, then rounded.

    Rounding is done twice, from all patterns of the program and from its full
    ones only, and the smaller result taken.  The work depends on ``room``, not
    on how many pieces there are.
    """
    need = np.zeros(room + 1, np.int64)
    for k, v in counts.items():
        need[k] = v
    if not need.any():
        return Solution([], 0.0, 0)
    copies, bound = relax(need, room)
    plan = min((rounded(need, room, copies, least) for least in (room, 0)), key=lambda p: sum(p.values()))
    return Solution([(n, dict(key)) for key, n in plan.items()], sum(copies.values()), math.ceil(bound - 1e-6))


def slots(plan: list[tuple[int, dict[int, int]]], room: int) -> dict[int, np.ndarray]:
    """For each length, rows (first slot, pieces in a sequence, first sequence, offset): a piece's rank finds its place."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used = dict.fromkeys(range(room + 1), 0)
    first = 0
    for n, pattern in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            a = pattern[length]
            out.setdefault(length, []).append((used[length], a, first, offset))
            used[length] += n * a
            offset += a * length
        first += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(cut: DataFrame, room: int, rows_each: int = 100_000, files: int | None = None) -> DataFrame:
    """Give every piece (id, piece, length, ...) a sequence of at most ``room`` and its offset there.

    The histogram has ``room`` bins at most and is all that the driver sees; the
    plan's slot table is as bounded and travels with the task.  A piece's rank
    among those of its length comes from a row number within (length, salt) and
    the sizes of the salts before; there are as many salts as give a task about
    ``rows_each`` rows even of a length that all pieces share, and the table of
    sizes is joined on the keys by which the rows are dealt already.  Repeated
    rows are ranked apart; null ids are placed like any other; no rows give no
    rows.
    """
    spark = cut.sparkSession
    cut = Scratch(spark, files).save(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = -(-max(histogram.values(), default=1) // rows_each)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    places = spark.sparkContext.broadcast(slots(solve(histogram, room).plan, room))
    local = Window.partitionBy("length", "_salt").orderBy("_id", "piece", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(local) - 1).join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                runs = table[int(k)]
                run = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
                copy, nth = np.divmod(rank[own] - run[:, 0], run[:, 1])
                sequence[own], offset[own] = run[:, 2] + copy, run[:, 3] + nth * k
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(lean(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, room: int = 1024, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents to packed pieces: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are one piece that holds ``end_id``; a text of any
    length is tokenized whole and cut into pieces of ``room``; of equal lengths
    any order will do, and repeated rows and null ids are packed each; other
    columns are not read; an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, end_id, room, id_column, text), room, files=files_for(text_bytes(docs, text))).withColumnRenamed("_id", id_column)
