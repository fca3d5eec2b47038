"""Language identification: word frequencies first, then ever shorter character n-grams."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import Remembered
from tessera.llm.common import Scratch, files_for, held, lean, slices, text_bytes

LETTERS = re.compile(r"[^\W\d_]+")
SHARES = 64  # parts of a language's terms at the last count taken, ranked apart first
LONGEST = 5  # characters of the longest n-gram; "<" and ">" mark a word's ends


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def has_letter(found: list[str]) -> bool:
    return any(c.isalpha() for w in found for c in w)


def ngrams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


STEP = 2.0**32  # logarithms are whole multiples of 1 / STEP, so that sums do not depend on the order of their terms


def stepped(x: np.ndarray) -> np.ndarray:
    return np.rint(x * STEP) / STEP


class Model:
    """Log frequencies by language of words and n-grams: the most frequent here, all in ``tables``.

    ``word_norm`` and ``gram_norm`` are the totals by language and the number of
    terms, of all that were counted.  ``tables`` are (term, lang, n) of words
    and of n-grams; None if what is here is all.
    """

    def __init__(self, languages: list[str], known_words: dict[str, dict[str, int]], known_grams: dict[str, dict[str, int]], word_norm: tuple[np.ndarray, int], gram_norm: tuple[np.ndarray, int], tables: tuple[DataFrame, DataFrame] | None = None):
        self.languages, self.word_norm, self.gram_norm, self.tables = languages, word_norm, gram_norm, tables
        self.words, self.word_logs = dict(zip(known_words, range(len(known_words)), strict=True)), self.logs(list(known_words.values()), word_norm)
        self.grams, self.gram_logs = dict(zip(known_grams, range(len(known_grams)), strict=True)), self.logs(list(known_grams.values()), gram_norm)
        self.ready()

    def ready(self) -> None:
        self.known = pa.array(self.words, pa.string())
        self.unknown = Remembered(self._backoff, 200_000)

    def parts(self) -> tuple:
        """What workers need."""
        return self.languages, self.words, self.word_logs, self.grams, self.gram_logs, self.word_norm, self.gram_norm

    def logs(self, rows: list[dict[str, int]], norm: tuple[np.ndarray, int]) -> np.ndarray:
        """The log frequencies by language of terms, from their counts by language."""
        at = {x: i for i, x in enumerate(self.languages)}
        counts = np.zeros((len(rows), len(at)))
        for i, by in enumerate(rows):
            for lang, n in by.items():
                counts[i, at[lang]] = n
        total, terms = norm
        return stepped(np.log((counts + 0.5) / (total + 0.5 * (terms + 1))))

    def _backoff(self, word: str) -> np.ndarray:
        """The mean over a word's n-grams of the greatest length at which any is known here."""
        n, rows, _ = self.longest(word)
        return stepped(np.add.reduce(self.gram_logs[rows]) / len(rows)) if n else np.zeros(len(self.languages))

    def longest(self, word: str) -> tuple[int, list[int], list[tuple[int, str]]]:
        """The greatest length at which n-grams of a word are known here (or 0), these, and those of that length or more that are not."""
        missing = []
        for n in range(LONGEST, 0, -1):
            own = ngrams(word, n)
            rows = [r for g in own if (r := self.grams.get(g)) is not None]
            missing += [(n, g) for g in own if g not in self.grams]
            if rows:
                return n, rows, missing
        return 0, [], missing

    def sums(self, texts: list[str | None], whole: bool) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[int]]]:
        """By text: number of words (0 if no letter), summed log frequencies, and the words that are not here with their counts.

        The words of all texts are looked up together.  If the model is ``whole``,
        words that are not here are scored by their n-grams and none are left.
        """
        found = [words(t) for t in texts]
        sizes, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        terms: list[list[str]] = [[] for _ in texts]
        times: list[list[int]] = [[] for _ in texts]
        own = np.array([i for i, f in enumerate(found) if has_letter(f)] if self.languages else [], np.int64)
        if not len(own):
            return sizes, total, terms, times
        sizes[own] = [len(found[i]) for i in own]
        flat = pa.array([w for i in own for w in found[i]], pa.string())
        place = pc.index_in(flat, self.known)
        new = flat.filter(place.is_null()).dictionary_encode()
        at = place.fill_null(-1).to_numpy().astype(np.int64)
        away = at < 0
        names = new.dictionary.to_pylist()
        if whole:
            logs = np.vstack([self.word_logs, *(self.unknown[w] for w in names)])
        else:
            logs = np.vstack([self.word_logs, np.zeros((len(names), len(self.languages)))])
            if names:
                pairs, n = np.unique(np.repeat(own, sizes[own])[away] * len(names) + new.indices.to_numpy(), return_counts=True)
                for i, w, k in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist(), n.tolist(), strict=True):
                    terms[i].append(names[w])
                    times[i].append(k)
        at[away] = new.indices.to_numpy() + len(self.words)
        total[own] = np.add.reduceat(logs[at], np.concatenate([[0], np.cumsum(sizes[own])[:-1]]), axis=0)
        return sizes, total, terms, times

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text by the words and n-grams that are here alone."""
        sizes, total, _, _ = self.sums(texts, True)
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        odds = np.exp((total - total.max(axis=1, keepdims=True)) / np.maximum(1.0, sizes / 8)[:, None])  # neighbouring words are not independent
        scores = odds.max(axis=1) / odds.sum(axis=1)
        return [(self.languages[b], s) if n else ("und", 0.0) for n, b, s in zip(sizes.tolist(), total.argmax(axis=1).tolist(), scores.tolist(), strict=True)]


def learn(training: DataFrame, lang: str = "lang", text: str = "text", words_each: int = 40_000, grams_each: int = 40_000) -> Model:
    """Count every word of every row with a language, and every n-gram of these words.

    All counts stay in tables that ``predict`` joins with.  The most frequent
    words and n-grams, ``words_each`` and ``grams_each`` a language, are broadcast
    as well, so that only rarer ones are looked up by joins; how many does not
    change a score.  Ties go to the word that sorts first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            by: dict[str, list[str]] = {}
            for name, t in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                by.setdefault(name, []).extend(words(t))
            for name, found in by.items():
                terms, n = pa.array(found, pa.string()).value_counts().flatten()
                yield pa.record_batch([terms, pa.array([name] * len(terms), pa.string()), n], names=["term", "lang", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for w, name in zip(batch.column("term").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                c = by.setdefault(name, Counter())
                for n in range(1, LONGEST + 1):
                    c.update(ngrams(w, n))
            for name, c in by.items():
                yield pa.record_batch([pa.array(list(c), pa.string()), pa.array([name] * len(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["term", "lang", "n"])

    schema = "term string, lang string, n long"

    def most(df: DataFrame, k: int) -> dict[str, dict[str, int]]:
        # how often each count occurs decides where a language's first k end; only terms at that count are ranked
        many = Window.partitionBy("lang").orderBy(F.desc("n"))
        ends = df.groupBy("lang", "n").agg(F.count("*").alias("terms")).withColumn("upto", F.sum("terms").over(many))
        ends = ends.where((F.col("upto") >= k) & (F.col("upto") - F.col("terms") < k))
        end = ends.select("lang", F.col("n").alias("end"), (k - F.col("upto") + F.col("terms")).alias("room"))
        judged = df.join(F.broadcast(end), "lang", "left")  # one row a language
        share = F.pmod(F.xxhash64("term"), F.lit(SHARES))
        ties = judged.where("n = end").withColumn("r", F.row_number().over(Window.partitionBy("lang", share).orderBy("term"))).where("r <= room")
        ties = ties.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("term"))).where("r <= room")
        top = judged.where("end is null or n > end").select("term").union(ties.select("term")).distinct()
        out: dict[str, dict[str, int]] = {}
        for row in df.join(top, "term").orderBy("term", "lang").toLocalIterator():
            out.setdefault(row["term"], {})[row["lang"]] = row["n"]
        return out

    read = training.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    scratch = Scratch(training.sparkSession, files_for(text_bytes(training, text)))
    counted = scratch.save(read.mapInArrow(lean(count), schema).groupBy("term", "lang").agg(F.sum("n").alias("n")), "words")
    grams = scratch.save(counted.mapInArrow(lean(cut), schema).groupBy("term", "lang").agg(F.sum("n").alias("n")), "grams")
    def norm(df: DataFrame) -> tuple[dict[str, int], int]:
        return {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.sum("n").alias("n")).collect()}, df.select("term").distinct().count()

    (word_total, n_words), (gram_total, n_grams) = norm(counted), norm(grams)
    languages = sorted(word_total)
    top_words, top_grams = most(counted, words_each), most(grams, grams_each)
    whole = len(top_words) == n_words and len(top_grams) == n_grams
    totals = [np.array([t[x] for x in languages], float) for t in (word_total, gram_total)]
    model = Model(languages, top_words, top_grams, (totals[0], n_words), (totals[1], n_grams), None if whole else (counted, grams))
    if whole:
        scratch.drop("words", "grams")
    scratch.release()
    return model


def predict(docs: DataFrame, model: Model, columns: list[Column | str], text: str = "text") -> DataFrame:
    """``columns`` of every row, then lang_pred and score (0 to 1).

    Words beyond the broadcast ones are looked up by joins, each distinct word
    once, and so are the n-grams of words that training does not have: every
    counted word and n-gram takes part.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    every text if nothing was learned; a very long text is scored whole; of
    languages that tie the first in order is predicted; repeated rows and null
    ids are predicted each; an empty table gives no rows; columns that are not
    asked for are not read, and those asked for may have any names.
    """
    spark = docs.sparkSession
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(model.parts())
    whole, wide = model.tables is None, len(model.languages)
    vector = pa.list_(pa.float64())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(key, sent)
        for batch in slices(batches, "_text"):
            sizes, total, terms, times = m.sums(batch.column("_text").to_pylist(), whole)
            made = [pa.array(sizes), pa.array(total.tolist(), vector), pa.array(terms, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.record_batch([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "_size", "_total", "_terms", "_times"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Log frequencies of counted words; of others, those of the n-grams that were broadcast, and the n-grams to look up."""
        m = _received(key, sent)
        for batch in batches:
            found = [dict(zip(a, b, strict=True)) for a, b in zip(batch.column("langs").to_pylist(), batch.column("ns").to_pylist(), strict=True)]
            logs = m.logs(found, m.word_norm)
            rows = []
            for i, (w, by) in enumerate(zip(batch.column("term").to_pylist(), found, strict=True)):
                if by:
                    rows.append((w, LONGEST + 1, 1, logs[i].tolist(), [], []))
                else:
                    n, own, missing = m.longest(w)
                    rows.append((w, n, len(own), m.gram_logs[own].sum(axis=0).tolist(), [k for k, _ in missing], [g for _, g in missing]))
            kinds = (pa.string(), pa.int32(), pa.int64(), vector, pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["term", "length", "k", "logs", "lengths", "missing"])

    def rate_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(key, sent)
        for batch in batches:
            logs = m.logs([dict(zip(a, b, strict=True)) for a, b in zip(batch.column("langs").to_pylist(), batch.column("ns").to_pylist(), strict=True)], m.gram_norm)
            yield pa.record_batch([batch.column("gram"), pa.array(logs.tolist(), vector)], names=["gram", "logs"])

    def by_lang(df: DataFrame, name: str) -> DataFrame:
        pairs = F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "n")))
        return df.groupBy(name).agg(pairs.alias("_by")).select(name, F.col("_by.lang").alias("langs"), F.col("_by.n").alias("ns"))

    def added(logs: str, times: Column) -> Column:
        return F.array(*(F.sum(F.col(logs)[i] * times) for i in range(wide)))

    given = docs.select(*columns).columns
    read = docs.select(*columns, F.col(text)).toDF(*(f"a{i}" for i in range(len(given))), "_text")  # whatever they are called
    names = [f"a{i}" for i in range(len(given))]
    kept = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]] + ["_size long", "_total array<double>"])
    seen = read.mapInArrow(lean(look, key), f"{kept}, _terms array<string>, _times array<long>")
    if not whole:
        scratch = Scratch(spark, files_for(text_bytes(docs, text)))
        counted, grams = model.tables
        seen = scratch.save(seen.withColumn("_row", F.monotonically_increasing_id()), "seen")
        rare = seen.select("_row", F.explode(F.arrays_zip("_terms", "_times")).alias("x")).select("_row", F.col("x._terms").alias("term"), F.col("x._times").alias("times"))
        rated = by_lang(rare.select("term").distinct().join(counted, "term", "left"), "term").mapInArrow(lean(rate, key), "term string, length int, k long, logs array<double>, lengths array<int>, missing array<string>")
        rated = scratch.save(rated, "rated")
        ready = rated.where((F.size("missing") == 0) & (F.col("k") > 0)).select("term", "k", "logs")
        left = rated.where(F.size("missing") > 0)
        asked = left.select("term", F.explode(F.arrays_zip("lengths", "missing")).alias("x")).select("term", F.col("x.lengths").alias("length"), F.col("x.missing").alias("gram"))
        wanted = grams.withColumnRenamed("term", "gram").join(asked.select("gram").distinct(), "gram", "left_semi")
        wanted = by_lang(wanted, "gram").mapInArrow(lean(rate_grams, key), "gram string, logs array<double>")
        parts = asked.join(wanted, "gram").select("term", "length", F.lit(1).cast("long").alias("k"), "logs").union(left.where("k > 0").select("term", "length", "k", "logs"))
        parts = parts.groupBy("term", "length").agg(F.sum("k").alias("k"), added("logs", F.lit(1.0)).alias("logs"))
        parts = parts.groupBy("term").agg(F.max_by(F.struct("k", "logs"), "length").alias("x")).select("term", "x.k", "x.logs")
        mean = F.transform("logs", lambda x: F.rint(x / F.col("k") * STEP) / STEP)
        rates = scratch.save(ready.union(parts).select("term", mean.alias("logs")), "rates")
        more = rare.join(rates, "term").groupBy("_row").agg(added("logs", F.col("times")).alias("_more"))
        seen = seen.join(more, "_row", "left").withColumn("_total", F.when(F.col("_more").isNull(), F.col("_total")).otherwise(F.zip_with("_total", "_more", lambda a, b: a + b)))
    if not wide:
        return seen.select(*names, F.lit("und"), F.lit(0.0)).toDF(*given, "lang_pred", "score")
    top = F.array_max("_total")
    odds = F.transform("_total", lambda x: F.exp((x - top) / F.greatest(F.lit(1.0), F.col("_size") / 8)))  # neighbouring words are not independent
    best = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("_total", top).cast("int"))
    lettered = F.col("_size") > 0
    score = F.when(lettered, 1 / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)
    return seen.select(*names, F.when(lettered, best).otherwise("und"), score).toDF(*given, "lang_pred", "score")


def _received(key: str, sent) -> Model:
    """The broadcast model, kept by a worker between batches and tasks."""

    def build() -> Model:
        m = Model.__new__(Model)
        m.languages, m.words, m.word_logs, m.grams, m.gram_logs, m.word_norm, m.gram_norm = sent.value
        m.ready()
        return m

    return held(key, build)


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that no model learns from: the remainder of the crc of the id's digits is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
