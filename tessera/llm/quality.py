"""Quality rules in Spark's own functions: per-document counts and lines frequent across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def normal(line: Column) -> Column:
    """A line for comparison: A-Z in lower case, white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), BLANKS, " "))


def paired(df: DataFrame, name: str, a: str, b: str, shift: int, length: Column) -> DataFrame:
    """A column with the hashes of a[i] and b[i + shift], for ``length`` places."""
    n = F.greatest(length, F.lit(0)).cast("int")
    return df.withColumn(name, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y)))


def counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: id, host, key of the row's content, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Five-word windows are hashed by doubling (1, 2, 4, 5 words), sorted with
    their places, and the covered words summed from the distances of the places:
    linear but for the sort, all within the row.
    """
    df = docs.select(F.col(id_column).alias("_id"), F.col(host).cast("string").alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumn("_w", words(F.col("_text"))).withColumn("n_words", F.size("_w"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "_id", "_host", F.xxhash64("_text").alias("_key"), "n_words", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"),
        F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    n = F.col("n_words")
    df = paired(df, "_h2", "_h1", "_h1", 1, n - 1)
    df = paired(df, "_h4", "_h2", "_h2", 2, n - 3)
    df = paired(df, "_h5", "_h4", "_h1", 4, n - 4).drop("_h1", "_h2", "_h4")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    sorted_ = F.sort_array(F.transform("_h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h5")) < F.size("_h5"), sorted_).otherwise(empty)).drop("_h5")
    m = F.size("_s")
    df = df.withColumn("_eq", F.zip_with("_s", F.slice("_s", F.lit(2), F.greatest(m, F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    df = df.withColumn("_any", F.zip_with("_eq", F.concat(F.array(F.lit(False)), "_eq"), lambda a, b: F.coalesce(a, F.lit(False)) | b))
    df = df.withColumn("_p", F.sort_array(F.filter(F.zip_with("_s", "_any", lambda a, f: F.when(f, a["i"])), lambda i: i.isNotNull())))
    gaps = F.zip_with("_p", F.slice("_p", F.lit(2), F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    df = df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda s, x: s + x).cast("long"))
    return df.select("_id", "_host", "_key", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row for each line: id, host, key of the row's content, place, two hashes of the normalised line, and its words."""
    df = docs.select(F.col(id_column).alias("_id"), F.col(host).cast("string").alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.select("_id", "_host", F.xxhash64("_text").alias("_key"), F.posexplode(F.split("_text", "\n")).alias("_at", "_line"))
    df = df.withColumn("_line", normal(F.col("_line")))
    n = F.when(F.col("_line") == "", 0).otherwise(F.char_length("_line") - F.char_length(F.translate("_line", " ", "")) + 1)
    return df.select("_id", "_host", "_key", "_at", F.xxhash64("_line").alias("_h"), F.hash("_line").alias("_g"), n.alias("_n"))


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """(host, line) found in more than ``max_docs`` distinct documents of the host; lines without words are not counted."""
    seen = lines.where("_n > 0").groupBy("_host", "_h", "_g").agg(F.count_distinct(F.coalesce(F.col("_id").cast("string"), F.lit(""))).alias("_docs"))
    return seen.where(F.col("_docs") > max_docs).select("_host", "_h", "_g")


def judge(docs: DataFrame, max_docs: int = 100, depleted: float = 0.5, least_words: int = 10, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: id, the counts, base_failed, n_line_words (words in lines over the limit) and kept.

    A row fails the base rules with fewer than ``least_words`` words or with
    more than 20 of 100 words in repeated five-word windows.  Lines in more than
    ``max_docs`` documents of a host are boilerplate there; a row is rejected if
    without them fewer than ``least_words`` words, or less than the share
    ``depleted`` of its words, remain.

    Line counts are combined before each shuffle, and only hashes travel.  Null
    and empty texts have no words and fail; a null host is a host of its own and
    null ids one document of it; rows that share an id count once for a line;
    equal rows are judged alike; other columns are not read; an empty table
    gives no rows.
    """
    base = counts(docs, id_column, text, host)
    lines = line_rows(docs, id_column, text, host)
    often = frequent_lines(lines, max_docs).select(F.col("_host").alias("_oh"), F.col("_h").alias("_o"), F.col("_g").alias("_og"))
    marked = lines.join(often, F.col("_host").eqNullSafe(F.col("_oh")) & (F.col("_h") == F.col("_o")) & (F.col("_g") == F.col("_og")), "left_semi")
    gone = marked.groupBy("_id", "_host", "_key", "_at").agg(F.max("_n").alias("_n")).groupBy("_id", "_host", "_key").agg(F.sum("_n").alias("_gone"))
    gone = gone.select(*(F.col(c).alias(f"_g{c}") for c in ("_id", "_host", "_key")), "_gone")
    same = F.lit(True)
    for c in ("_id", "_host", "_key"):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{c}"))
    df = base.join(gone, same, "left").withColumn("n_line_words", F.coalesce("_gone", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~failed & (left >= least_words) & (left >= depleted * F.col("n_words")))
    return df.select(F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words")


ORACLE = r"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
w as (select doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
l as (select doc_id, source, unnest(string_split(t, chr(10))) line from d),
lw as (select doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') ws from l),
dup as (select doc_id, count(*) - count(distinct line) n_dup_lines from lw where len(ws) > 0 group by 1),
five as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from w where len(ws) >= 5)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from five) where n > 1),
cover as (select doc_id, count(distinct j) n_repeat_words from (select doc_id, unnest(range(i, i + 5)) j from again) group by 1),
norm as (select doc_id, source, array_to_string(list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') line, len(ws) n from lw where len(ws) > 0),
often as (select source, line from norm group by 1, 2 having count(distinct doc_id) > 100),
gone as (select doc_id, sum(n) n_line_words from norm semi join often using (source, line) group by 1),
b as (
  select w.doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
    coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(n_line_words, 0)::bigint n_line_words
  from w left join dup using (doc_id) left join cover using (doc_id) left join gone using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - n_line_words >= 10 and n_words - n_line_words >= 0.5 * n_words kept, n_line_words
from b
"""
