"""Pages as rows of elements, numbered so that containment is an interval test.

``open`` and ``stop`` count the beginnings and ends of a page's elements and its
texts in order: one element is inside another if its ``open`` lies between the
other's two.  One pass parses the pages; what is chosen, left out and read from
them afterwards are joins, windows and aggregates over rows, of one page at most
in each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.pages import BLOCKS, DEPTH, ENDS, HIDDEN, VOID, ended

ELEMENT = "open int, stop int, depth int, parent int, nth int, tag string, attrs map<string,string>, own string, text string"
#: Parts of pages that are never about the page's own subject.
ASIDES = (".related", "#related", ".recommendations", "#recommendations", ".comments", "#comments", ".reviews", "#reviews", ".faq", "#faq", "aside")
ROWS, CHARACTERS = 4096, 1 << 20  # elements and characters of pages that are sent at once
LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


class _Rows(HTMLParser):
    """Collects one page's rows: [open, stop, depth, parent, nth, tag, attrs, own, text]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = 0
        self.rows: list[list] = []
        self.opened: list[list] = []
        self.deep = False

    def _row(self, tag: str | None, attrs: list, text: str | None) -> list:
        parent = self.opened[-1] if self.opened else None
        row = [self.at, self.at, len(self.opened), parent[0] if parent else None, 0, tag, attrs, "" if tag else None, text, 0]
        if parent and tag:
            row[4], parent[9] = parent[9], parent[9] + 1
        self.at += 1
        self.rows.append(row)
        return row

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            keep = ended(tag, [r[5] for r in self.opened])
            while len(self.opened) > keep:
                self._end()
        self.deep |= len(self.opened) >= DEPTH
        if not self.deep:
            row = self._row(tag, list({k: v or "" for k, v in attrs}.items()), None)
            if tag not in VOID:
                self.opened.append(row)

    def handle_endtag(self, tag: str) -> None:
        if any(r[5] == tag for r in self.opened):
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.deep:
            self._row(None, [], data)
            if self.opened:
                self.opened[-1][7] += data

    def _end(self) -> str:
        row = self.opened.pop()
        row[1], self.at = self.at, self.at + 1
        return row[5]

    def finished(self) -> list[list]:
        while self.opened:
            self._end()
        return [] if self.deep else [r[:9] for r in self.rows]


def parsed(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, open, stop, depth, parent, nth, tag, attrs, own, text): a row for each element and each text between tags.

    ``tag`` is null for a text; ``own`` is what an element holds directly and
    ``nth`` its place among its parent's elements.  Elements that a page leaves
    open end with it, a paragraph, item or cell where the next one begins; a page without text, or one that nests too deep, has none.
    """
    kind = pages.schema[key].dataType.simpleString()

    types = [pa.int32()] * 5 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]

    def made(ids: pa.Array, places: list[int], rows: list[list]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.record_batch([ids.take(pa.array(places)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["key", "open", "stop", "depth", "parent", "nth", "tag", "attrs", "own", "text"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list[int] = []
            rows: list[list] = []
            size = 0
            for i in range(len(batch)):
                page = batch.column(1)[i].as_py() or ""
                reader = _Rows()
                reader.feed(page)
                reader.close()
                found = reader.finished()
                places += [i] * len(found)
                rows += found
                size += len(page)
                if len(rows) >= ROWS or size >= CHARACTERS:
                    if rows:
                        yield made(batch.column(0), places, rows)
                    places, rows, size = [], [], 0
            if rows:
                yield made(batch.column(0), places, rows)

    return pages.select(F.col(key).alias("key"), html).mapInArrow(read, f"key {kind}, {ELEMENT}").withColumnRenamed("key", key)


class _Scripts(HTMLParser):
    """Collects what a page's scripts without an address hold, with the bounds and ends of ``_Rows``, without its rows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.opened: list[str] = []
        self.found: list[str] = []
        self.own: list[str] | None = None
        self.deep = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            del self.opened[ended(tag, self.opened) :]
        self.deep |= len(self.opened) >= DEPTH
        if tag not in VOID:
            self.opened.append(tag)
        if tag == "script" and not dict(attrs).get("src"):
            self.own = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.opened:
            while self.opened.pop() != tag:
                pass
        if tag == "script":
            self._end()

    def handle_data(self, data: str) -> None:
        if self.own is not None:
            self.own.append(data)

    def _end(self) -> None:
        if self.own is not None:
            self.found.append("".join(self.own).strip(" \t\n\x0b\f\r"))
        self.own = None

    def finished(self) -> list[str]:
        self._end()
        return [] if self.deep else self.found


def scripts(page: str) -> list[str]:
    """What each script of a page without an address holds, without blanks around it, in order; a page that nests too deep has none."""
    reader = _Scripts()
    reader.feed(page)
    reader.close()
    return reader.finished()


# ---- selectors


def attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def classes() -> Column:
    return F.split(attr("class"), r"\s+")


def matches(selector: str) -> Column:
    """Does an element match ``tag``, ``.class`` or ``#id``?"""
    if selector.startswith("."):
        hit = F.array_contains(classes(), selector[1:])
    else:
        hit = attr("id") == selector[1:] if selector.startswith("#") else F.col("tag") == selector
    return F.coalesce(F.col("tag").isNotNull() & hit, F.lit(False))


def one_of(selectors: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in selectors:
        out = out | matches(s)
    return out


def unseen() -> Column:
    """Is an element hidden from readers by its kind or its attributes?"""
    style = F.lower(F.regexp_replace(attr("style"), r"\s", ""))
    marks = F.map_contains_key("attrs", F.lit("hidden")) | (attr("role") == "status") | matches(".sr-only") | (attr("aria-hidden") == "true")
    return F.coalesce(F.col("tag").isin(*HIDDEN) | marks | style.contains("display:none") | style.contains("visibility:hidden"), F.lit(False))


def gapped() -> Column:
    """Does style alone set an element's children apart: a flex box with a gap?"""
    style = F.lower(F.regexp_replace(attr("style"), r"\s", ""))
    inline = style.rlike(r"(?:^|;)display:(?:inline-)?flex(?:;|$)") & style.rlike(r"(?:^|;)gap:[1-9]")
    named = F.exists(classes(), lambda c: c.isin("flex", "inline-flex")) & F.exists(classes(), lambda c: c.rlike(r"^gap(?:-[xy])?-(?:\[[1-9][^\]]*\]|[1-9][0-9.]*)$"))
    return inline | named


# ---- containment


def enclosed(rows: DataFrame, keys: list[str], by: Column) -> Column:
    """Is a row inside an element for which ``by`` holds?  Elements nest, so it is if one that began before ends after it."""
    before = Window.partitionBy(*keys).orderBy("open").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(by, F.col("stop"))).over(before) > F.col("open"), F.lit(False))


def within(elements: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """The rows of the subtrees of ``nodes`` (key, open, stop), each with the ``node`` it is in."""
    of = nodes.select(key, F.col("open").alias("node"), F.col("stop").alias("_end")).distinct()
    return elements.join(of, key).where(F.col("open").between(F.col("node"), F.col("_end"))).drop("_end")


def retained(rows: DataFrame, key: str, skip: Column) -> DataFrame:
    """Of ``within``, what is neither skipped nor inside a skipped element of the same subtree."""
    marked = rows.withColumn("_skip", skip)
    inside = enclosed(marked, [key, "node"], F.col("_skip"))
    return marked.withColumn("_in", inside).where("not _skip and not _in").drop("_skip", "_in")


def content(rows: DataFrame, key: str) -> DataFrame:
    """(key, node, text) of retained rows: a line for each block, blanks collapsed, flex gaps a blank; nodes without text have none."""
    block = F.col("tag").isin(*BLOCKS)
    set_apart = rows.where(gapped()).select(key, "node", F.col("open").alias("parent"), F.lit(True).alias("_gap"))
    piece = rows.join(set_apart, [key, "node", "parent"], "left").select(
        key, "node", F.explode(F.array(
            F.struct(F.col("open").alias("at"), F.concat(F.when(F.col("_gap"), " ").otherwise(""), F.when(block, "\n").otherwise(F.coalesce("text", F.lit("")))).alias("piece")),
            F.struct(F.col("stop").alias("at"), F.when(block, "\n").otherwise("").alias("piece")),
        )).alias("p"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p.at", "p.piece"))), lambda x: x["piece"]), "")
    lines = F.filter(F.transform(F.split(F.col("_whole"), LINE_END), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    return piece.where("p.piece <> ''").groupBy(key, "node").agg(whole.alias("_whole")).select(key, "node", F.array_join(lines, "\n").alias("text")).where("text <> ''")


def texts(elements: DataFrame, nodes: DataFrame, key: str, skip: Column) -> DataFrame:
    """(key, node, text) of the nodes."""
    return content(retained(within(elements, nodes, key), key, skip), key)


def regions(elements: DataFrame, key: str, selector: str, skip: Column) -> DataFrame:
    """The outermost elements that match and are neither skipped nor inside a skipped element."""
    marked = elements.withColumn("_m", matches(selector)).withColumn("_s", skip)
    return marked.withColumn("_in", enclosed(marked, [key], F.col("_m") | F.col("_s"))).where("_m and not _s and not _in").drop("_m", "_s", "_in")


def only(nodes: DataFrame, key: str) -> DataFrame:
    """The nodes of pages that have exactly one."""
    return nodes.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")
