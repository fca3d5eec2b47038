"""Chat formatting in Spark's own functions: quotations linked to the messages they quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
KINDS = ("line", "sentence")
SENTENCE = r"(?<=[.!?…؟])\x20"  # between normalised sentences
BLOCK = 256  # root turns of a conversation that are numbered together


def level(line: Column) -> Column:
    """How many quotation marks a line begins with."""
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normal(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"[\x20\x09-\x0D]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, key, level, first, hash, bodies): runs of lines of one quote level without a blank line, hashed as normalised text, and their normalised lines."""
    lines = messages.select("_conv", "_turn", "_key", F.posexplode(F.split("_text", "\n")).alias("_at", "_line"))
    lines = lines.withColumn("_level", level(F.col("_line"))).withColumn("_body", normal(F.regexp_replace("_line", MARKS, "")))
    own = Window.partitionBy("_conv", "_turn", "_key").orderBy("_at")
    fresh = (F.col("_level") != F.lag("_level", 1, -1).over(own)) | (F.lag("_body", 1, "").over(own) == "")
    lines = lines.withColumn("_run", F.sum(fresh.cast("int")).over(own)).where("_body <> ''")
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_body"))), lambda x: x["_body"])
    runs = lines.groupBy("_conv", "_turn", "_key", "_run", "_level").agg(bodies.alias("_bodies"), F.min("_at").alias("_first"))
    return runs.select("_conv", "_turn", "_key", "_level", "_first", F.sha2(F.array_join("_bodies", " "), 256).alias("_hash"), "_bodies")


def units(bodies: Column, kind: str, quoted: bool) -> Column:
    """Hashes of lines or sentences: of a quotation, its only one or each two neighbours; of a message, every one and each two neighbours."""
    each = bodies if kind == "line" else F.split(F.array_join(bodies, " "), SENTENCE)
    two = F.transform(F.slice(F.arrays_zip(each.alias("a"), F.slice(each, 2, F.greatest(F.size(each), F.lit(1))).alias("b")), 1, F.greatest(F.size(each) - 1, F.lit(0))), lambda x: F.concat(x["a"], F.lit("\n"), x["b"]))
    every = F.when(F.size(each) == 1, each).otherwise(two) if quoted else F.concat(each, two)
    return F.array_distinct(F.transform(every, lambda x: F.sha2(F.concat(F.lit(kind + " "), x), 256)))


def by_parts(unfound: DataFrame, told: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, turn, key, level, first, part): the latest earlier turn that has all lines of a passage, else all its sentences, each beside the next.

    Each pass looks up, for every unit of a passage, the latest turn up to a
    bound; the least of these is the next bound, until all units agree, so that
    no pairs of repeated lines are made.
    """
    talks = unfound.select("_conv").distinct()
    own = F.filter(F.transform(F.filter(F.split("_text", "\n"), lambda x: ~x.rlike(MARKS)), normal), lambda x: x != "")
    wrote = told.join(talks, "_conv", "left_semi").select("_conv", "_turn", own.alias("_own")).where(F.size("_own") > 0)
    wrote = wrote.select("_conv", "_turn", F.explode(F.concat(*(units(F.col("_own"), k, False) for k in KINDS))).alias("_unit")).distinct()
    wrote = scratch.save(wrote.select("_conv", "_unit", F.col("_turn").alias("_below"), F.col("_turn").alias("_source")), "wrote")
    names = ["_conv", "_turn", "_key", "_level", "_first", "_kind"]
    asked = None
    for kind in KINDS:
        one = unfound.select(*names[:-1], F.lit(kind).alias("_kind"), F.explode(units(F.col("_bodies"), kind, True)).alias("_unit"), F.col("_turn").alias("_below"))
        asked = one if asked is None else asked.union(one)
    asked = scratch.save(asked, "asked-0")
    before = Window.partitionBy("_conv", "_unit").orderBy("_below").rangeBetween(Window.unboundedPreceding, -1)
    found, turn = None, 0
    while True:
        both = asked.unionByName(wrote, allowMissingColumns=True).withColumn("_said", F.max("_source").over(before)).where("_kind is not null")
        ends = both.groupBy(*names).agg(F.min("_said").alias("_least"), F.max("_said").alias("_most"), (F.count("_said") == F.count("*")).alias("_all")).where("_all")
        ends = scratch.save(ends, f"ends-{turn}")
        agreed = ends.where("_least = _most").select(*names, F.col("_least").alias("_part"))
        found = agreed if found is None else found.union(agreed)
        more = ends.where("_least < _most")
        if more.isEmpty():
            part = F.coalesce(*(F.max(F.when(F.col("_kind") == k, F.col("_part"))) for k in KINDS))
            return found.groupBy(*names[:-1]).agg(part.alias("_part"))
        turn += 1
        asked = scratch.save(asked.drop("_below").join(more.select(*names, (F.col("_least") + 1).alias("_below")), names), f"asked-{turn}")


def linked(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages without quotes, linked and ordered: (conv, turn, role, text, reply_to, thread, place, n_quotes, n_linked, content).

    Lines that begin with ">" marks are quotes of that nesting level.  Quoted
    passages, normalised and hashed, are looked up among the passages and whole
    texts that earlier turns of the conversation wrote themselves; the latest
    such turn is meant.  A passage that is not found so is looked up by its
    lines, then by its sentences: the latest earlier turn that wrote all of
    them, each beside the next, is meant.  ``reply_to`` is the latest message quoted at the
    outermost level at which any is found, ``thread`` the first message of the
    chain of replies, and ``place`` the message's number, from 0, in its
    conversation by thread and turn, so that replies follow what they answer.
    ``content`` is the message with its role's tag.

    Only messages with quotes, and the hashes of passages, are shuffled more
    than once; a passage that many turns repeat is matched in one ordered sweep,
    never as pairs, and numbering is by blocks of root turns, so a conversation
    of any length is dealt over tasks.

    Null texts count as empty and stay empty; a null turn or conversation links
    to nothing, and null turns come last in order; equal rows are numbered one
    after the other; a quote that no earlier turn wrote is removed without a
    link; other columns are not read; an empty table gives no rows.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark)
    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.col(role).cast("string").alias("_role"), text_.alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("_role", "_text"))
    quoting = rows.where(F.col("_text").rlike(r"(?m)^[ \t]*>") & F.col("_conv").isNotNull() & F.col("_turn").isNotNull())
    quotes = scratch.save(passages(quoting.dropDuplicates(["_conv", "_turn", "_key"])).where("_level > 0"), "quotes")
    talks = quotes.select("_conv").distinct()
    told = rows.where("_turn is not null").join(talks, "_conv", "left_semi").dropDuplicates(["_conv", "_turn", "_key"])
    own_text = normal(F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~x.rlike(MARKS)), " "))
    whole = told.select("_conv", "_turn", own_text.alias("_own")).where("_own <> ''").select("_conv", "_turn", F.sha2("_own", 256).alias("_hash"))
    written = passages(told).where("_level = 0").select("_conv", "_turn", "_hash").union(whole).distinct()
    both = quotes.select("_conv", "_turn", "_key", "_level", "_first", "_hash", "_bodies", F.lit(None).cast("long").alias("_source"))
    both = both.unionByName(written.withColumn("_source", F.col("_turn")), allowMissingColumns=True)
    before = Window.partitionBy("_conv", "_hash").orderBy("_turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_said", F.max("_source").over(before)).where("_level is not null")
    found = scratch.save(found, "found")
    unfound = found.where("_said is null")
    if not unfound.isEmpty():
        parts = by_parts(unfound, told, scratch)
        found = found.join(parts, ["_conv", "_turn", "_key", "_level", "_first"], "left").withColumn("_said", F.coalesce("_said", "_part"))
    links = found.groupBy("_conv", "_turn", "_key").agg(F.count("*").alias("n_quotes"), F.count("_said").alias("n_linked"), F.max_by("_said", F.when(F.col("_said").isNotNull(), F.struct(-F.col("_level"), F.col("_said")))).alias("reply_to"))
    links = scratch.save(links, "links")
    threads = roots(links.where("reply_to is not null").groupBy("_conv", "_turn").agg(F.min("reply_to").alias("_up")), scratch)
    done = rows.join(links, ["_conv", "_turn", "_key"], "left").join(threads, ["_conv", "_turn"], "left")
    done = done.withColumn("thread", F.coalesce("_root", "_turn"))
    clean = F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~x.rlike(MARKS)), "\n")
    done = done.withColumn("text", F.when(F.col("n_quotes").isNull(), F.col("_text")).otherwise(F.regexp_replace(F.regexp_replace(clean, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")))
    done = done.withColumn("_block", F.coalesce(F.floor(F.col("thread") / BLOCK), F.lit((1 << 62) - 1)))
    sizes = rows.join(threads, ["_conv", "_turn"], "left").groupBy("_conv", F.coalesce(F.floor(F.coalesce("_root", "_turn") / BLOCK), F.lit((1 << 62) - 1)).alias("_block")).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.where("_before > 0").select(F.col("_conv").alias("_sc"), F.col("_block").alias("_sb"), "_before")
    order = Window.partitionBy("_conv", "_block").orderBy(F.asc_nulls_last("thread"), F.asc_nulls_last("_turn"), "_role", "_text")
    done = done.withColumn("_nth", F.row_number().over(order) - 1).join(sizes, F.col("_conv").eqNullSafe(F.col("_sc")) & (F.col("_block") == F.col("_sb")), "left")
    place = (F.col("_nth") + F.coalesce("_before", F.lit(0))).cast("long")
    content = F.concat(F.lit("<|"), F.coalesce("_role", F.lit("")), F.lit("|>\n"), F.col("text"))
    zero = F.lit(0).cast("long")
    return done.select(F.col("_conv").alias(conv), F.col("_turn").alias(turn), F.col("_role").alias(role), "text", "reply_to", "thread", place.alias("place"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), content.alias("content"))


def roots(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, turn, root) of replies, by doubling: each pass follows twice as many steps; replies point to earlier turns, so it ends."""
    at = scratch.save(replies.withColumnRenamed("_up", "_root"), "roots-0")
    turn = 0
    while True:
        up = at.select(F.col("_conv").alias("_c"), F.col("_turn").alias("_t"), F.col("_root").alias("_next"))
        moved = at.join(up, (F.col("_conv") == F.col("_c")) & (F.col("_root") == F.col("_t")), "left").select("_conv", "_turn", F.coalesce("_next", "_root").alias("_root"), F.col("_next").isNotNull().alias("_moved"))
        turn += 1
        moved = scratch.save(moved, f"roots-{turn}")
        at = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return at
