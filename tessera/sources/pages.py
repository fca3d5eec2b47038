"""Saved web pages: links, marks and visible text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tags without an end, what readers do not see, and what ends a line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "svg", "nav", "header", "footer", "form", "button", "iframe"}
BLOCKS = {"div", "p", "section", "article", "main", "h1", "h2", "h3", "h4", "li", "ul", "ol", "dl", "tr", "br", "hr"}
DEPTH = 150  # a page with more open elements is refused as a whole
#: Elements that may be left open: each ends where the next of its kind begins, whatever inline elements are open in it.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}}
INLINE = {"a", "abbr", "b", "big", "cite", "code", "em", "font", "i", "mark", "nobr", "q", "s", "small", "span", "strike", "strong", "sub", "sup", "tt", "u"}
PASSED = {tag: INLINE | ({"p", "td", "th"} if tag == "tr" else {"p"}) for tag in ENDS}


class TooDeep(ValueError):
    """More elements are open at once than a page may have."""


def ended(tag: str, opened: list[str]) -> int:
    """How many of the open elements stay open where ``tag`` begins: of those left open, the nearest of its kind ends, with what is in it."""
    for i in range(len(opened) - 1, -1, -1):
        if opened[i] in ENDS.get(tag, ()):
            return i
        if opened[i] not in PASSED.get(tag, ()):
            break
    return len(opened)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"#]+)"'), 1)


def marked(text: Column, mark: str) -> Column:
    """The words after a mark, such as # or @."""
    return F.regexp_extract_all(text, F.lit(mark + r"(\w+)"), 1)


class _Reader(HTMLParser):
    """Counts open elements by tag; text is kept while no hidden element is open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.tags: list[str] = []
        self.hidden_from: int | None = None  # how many elements were open when the outermost hidden one began

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._keep(ended(tag, self.tags))
        if len(self.tags) >= DEPTH:
            raise TooDeep
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag in VOID:
            return
        if self.hidden_from is None and (tag in HIDDEN or unseen({k: v or "" for k, v in attrs})):
            self.hidden_from = len(self.tags)
        self.tags.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag in self.tags:
            self._keep(len(self.tags) - 1 - self.tags[::-1].index(tag))  # what was left open inside ends with it

    def _keep(self, n: int) -> None:
        del self.tags[n:]
        if self.hidden_from is not None and n <= self.hidden_from:
            self.hidden_from = None

    def handle_data(self, data: str) -> None:
        if self.hidden_from is None:
            self.parts.append(data)


def unseen(attributes: dict[str, str]) -> bool:
    """Do an element's attributes hide it from readers?"""
    style = "".join(attributes.get("style", "").split()).lower()
    marks = ("hidden" in attributes, attributes.get("role") == "status", attributes.get("aria-hidden") == "true", "sr-only" in attributes.get("class", "").split())
    return any(marks) or "display:none" in style or "visibility:hidden" in style


def visible(html: str | None) -> str | None:
    """The text a reader sees, a line for each block, blanks collapsed; a broken page gives what could be read, one that nests too deep nothing."""
    if html is None:
        return None
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except TooDeep:
        return None
    lines = (" ".join(line.split()) for line in "".join(reader.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def with_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with a column ``text``."""

    @F.pandas_udf(StringType())
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(visible)

    return pages.withColumn("text", read(F.col(html)))


def discovered(pages: DataFrame) -> DataFrame:
    """(page_id, link): absolute addresses a page links to, of its own host, each once."""
    from tessera.functions import keys

    base = F.concat(F.try_parse_url(F.col("url"), F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(F.col("url"), F.lit("HOST")))
    rows = pages.select("page_id", base.alias("_base"), F.explode(F.array_distinct(links(F.col("html")))).alias("_href"))
    whole = F.when(F.col("_href").rlike("^https?://"), F.col("_href")).when(F.col("_href").startswith("/"), F.concat("_base", "_href"))
    rows = rows.withColumn("link", keys.canonical_url(whole)).where("link is not null")
    return rows.where(keys.host(F.col("link")) == keys.host(F.col("_base"))).select("page_id", "link").distinct()
